"""Places of pattern matches in texts, as column expressions and as SQL.

Spark's functions return matched strings without their places. A match is therefore taken
together with the text between it and the one before, and lengths are summed up. ``\\G`` holds
each search to the end of the last match, so a text is read once per pattern whatever it holds.
Offsets count code points from 0; ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,place:int,kind:string,end:int,score:int>"
CONTEXT_CHARS = 48


@dataclass(frozen=True)
class Rule:
    """A kind of span.

    ``pattern`` is in Java's syntax, ``sql_pattern`` the same language for engines without
    lookaround and possessive repeats. ``needs`` must match somewhere in a text with a span. ``value``
    is the number of the pattern's group that ``valid`` looks at, 0 for the whole match; ``valid``
    and ``sql_valid`` decide on it. ``score`` (percent) rises by ``context_score`` if
    ``context`` matches the lower-cased surroundings; spans below ``least`` are dropped. Base
    kinds always stay. A changed rule gets a new ``version``.
    """

    kind: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column] = field(default=lambda value: F.lit(True))
    sql_valid: str = "true"
    value: int = 0
    sql_pattern: str | None = None
    base: bool = False
    version: int = 1
    score: int = 100
    context: str | None = None
    context_score: int = 0
    least: int = 0


def spans_of(rule: Rule, place: int, text: Column) -> Column:
    """Array of :data:`SPAN` of one rule; leftmost non-overlapping matches, the invalid dropped.

    What follows a match is taken by the search itself, so no match walks the text again, and ends are
    running sums made in two levels: the work grows with the text and its matches.
    """
    after = rf"(?=(.{{0,{CONTEXT_CHARS}}}))" if rule.context is not None else ""
    whole = rf"(?s)\G(.*?)({rule.pattern}){after}"
    gaps, found = (F.regexp_extract_all(text, F.lit(whole), F.lit(group)) for group in (1, 2))
    fields = [gaps.alias("gap"), found.alias("found")]
    if rule.value:
        fields.append(F.regexp_extract_all(text, F.lit(whole), F.lit(2 + rule.value)).alias("value"))
    if rule.context is not None:
        fields.append(F.regexp_extract_all(text, F.lit(whole), F.lit(re.compile(_plain(whole)).groups)).alias("after"))
    matches = F.arrays_zip(*fields)

    def span(match: Column, end: Column) -> Column:
        begin = end - F.length(match["found"])
        return F.struct(
            F.struct(
                begin.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), end.alias("end"), _score(rule, match).alias("score")
            ).alias("span"),
            match["value" if rule.value else "found"].alias("value"),
        )

    def kept(one: Column) -> Column:
        return rule.valid(one["value"]) if rule.base else rule.valid(one["value"]) & (one["span"]["score"] >= rule.least)

    def placed(all_: Column) -> Column:
        ends = running_sums(F.transform(all_, lambda match: F.length(match["gap"]) + F.length(match["found"])))
        return F.transform(F.filter(F.zip_with(all_, ends, span), kept), lambda one: one["span"])

    spans = let(matches, f"array<{SPAN}>", placed)
    return F.when(text.rlike(rule.needs), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _plain(pattern: str) -> str:
    """The pattern without what Python's syntax lacks, for counting its groups."""
    return re.sub(r"\\G", "", pattern)


def running_sums(numbers: Column, chunk: int = 256) -> Column:
    """Sums of the array's first 1, 2, ... elements.

    A fold that appends copies what it has; so chunks are summed on their own and then raised by
    what comes before them, which copies each element about ``chunk`` times at most.
    """
    nothing = F.array().cast("array<int>")

    def within(some: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), nothing.alias("sums"))
        return F.aggregate(
            some, first, lambda had, n: F.struct((had["at"] + n).alias("at"), F.concat(had["sums"], F.array(had["at"] + n)).alias("sums")), lambda had: had["sums"]
        )

    def raised(had: Column, sums: Column) -> Column:
        more = F.transform(sums, lambda one: one + had["at"])
        return F.struct((had["at"] + F.element_at(sums, -1)).alias("at"), F.concat(had["parts"], F.array(more)).alias("parts"))

    def summed(all_: Column) -> Column:
        size = F.size(all_)
        starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(chunk))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(starts, lambda at: within(F.slice(all_, at + F.lit(1), F.lit(chunk))))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts"))
        return F.flatten(F.aggregate(sums, first, raised, lambda had: had["parts"]))

    return let(numbers, "array<int>", summed)


def let(value: Column, kind: str, make: Callable[[Column], Column]) -> Column:
    """``make`` of the value, of type ``kind``, the value being evaluated once however often it is named."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, one: make(one))


def _score(rule: Rule, match: Column) -> Column:
    if rule.context is None:
        return F.lit(rule.score)
    before = F.substring(match["gap"], -CONTEXT_CHARS, CONTEXT_CHARS)
    near = F.lower(F.concat_ws(" ", before, match["after"]))
    return F.when(near.rlike(rule.context), F.lit(rule.score + rule.context_score)).otherwise(F.lit(rule.score))


def as_words(names: str) -> str:
    """A pattern for any of ``names`` (in lower case, joined by bars) that is no part of a longer word."""
    return f"(?:^|[^a-z0-9_])(?:{names})(?:$|[^a-z0-9_])"


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in the order of the array."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def digest(rules: Sequence[Rule], spans: str = "found") -> list[Column]:
    """n_<kind> of each base kind, base_sha256, spans, scores, from a sorted array of spans."""
    base = [rule.kind for rule in rules if rule.base]
    counts = [F.size(of_kind(spans, kind)).cast("long").alias(f"n_{kind}") for kind in base]
    of_base = F.filter(spans, lambda s: s["kind"].isin(base))
    scores = F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",")
    return [*counts, F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans"), scores.alias("scores")]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(rules: Sequence[Rule]) -> str:
    """The digest in SQL over ``documents``."""
    lists, names = [], []
    for place, rule in enumerate(rules):
        whole = _quoted(f"(?s)(.*?)({rule.sql_pattern or rule.pattern})")
        k = rule.kind
        names.append(f"s_{k}")
        score = str(rule.score)
        if rule.context is not None:
            near = f"lower(concat_ws(' ', g_{k}[i][-{CONTEXT_CHARS}:], substr(body, e_{k}[i] + 1, {CONTEXT_CHARS})))"
            score = f"CASE WHEN regexp_matches({near}, {_quoted(rule.context)}) THEN {rule.score + rule.context_score} ELSE {rule.score} END"
        lists.append(
            (
                f"regexp_extract_all(body, {whole}, 1) AS g_{k}, regexp_extract_all(body, {whole}, 2) AS m_{k}, "
                f"regexp_extract_all(body, {whole}, {2 + rule.value}) AS v_{k}",
                f"list_transform(range(1, len(g_{k}) + 1), lambda i: CAST(list_sum(list_transform(g_{k}[1:i], lambda x: length(x))) "
                f"+ list_sum(list_transform(m_{k}[1:i], lambda x: length(x))) AS BIGINT)) AS e_{k}",
                f"list_filter(list_transform(range(1, len(g_{k}) + 1), lambda i: {{'start': e_{k}[i] - length(m_{k}[i]), 'place': {place}, "
                f"'kind': '{k}', 'end': e_{k}[i], 'score': {score}, 'value': v_{k}[i]}}), "
                f"lambda s: ({rule.sql_valid}){'' if rule.base else f' AND s.score >= {rule.least}'}) AS s_{k}",
            )
        )
    base = [rule.kind for rule in rules if rule.base]
    counts = ", ".join(f"CAST(len(s_{k}) AS BIGINT) AS n_{k}" for k in base)
    joined = "array_to_string(list_transform(list_sort({}), lambda s: s.kind || ':' || s.start || ':' || s.end), ',')"
    of_base = "list_concat(" + ", ".join(f"s_{k}" for k in base) + ")"
    of_all = "list_concat(" + ", ".join(names) + ")"
    scores = f"array_to_string(list_transform(list_sort({of_all}), lambda s: CAST(s.score AS VARCHAR)), ',')"
    return f"""
WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
matches AS (SELECT *, {", ".join(x[0] for x in lists)} FROM bodies),
ends AS (SELECT *, {", ".join(x[1] for x in lists)} FROM matches),
spans AS (SELECT doc_id, {", ".join(x[2] for x in lists)} FROM ends)
SELECT doc_id, {counts}, sha256({joined.format(of_base)}) AS base_sha256, {joined.format(of_all)} AS spans, {scores} AS scores
FROM spans"""
