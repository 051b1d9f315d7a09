"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic. Target shares for each of the three are reached
together by raking: the cells' rates are scaled to one set of targets after another until all hold.
The rate of a cell is the probability at which its documents are sampled, so it stops at 1: a label with
fewer tokens than its target asks for is kept whole, and the others are raked to their own targets.

All labels are raked by name. While there are few cells, their table is raked in one place; a table
beyond ``CELLS_ON_DRIVER`` rows is raked where it lies, by sums and joins, to the same rates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import WORD, text_or_empty, whole_row
from parlance.operators.joins import attach
from parlance.storage import release, written

# Share of all tokens to keep, if no label has too few.
KEEP = 0.5
EXPONENT = 0.7
SEED = 20
# Raking ends when a round changes no rate by more than CLOSE.
ROUNDS = 200
CLOSE = 1e-7
CELLS_ON_DRIVER = 50_000
OTHER = "other"
_KINDS = ["source", "lang", "topic"]

# Topics in order; a text has the first whose pattern it matches, else the last.
TOPICS = (
    ("licence", "(?i)licen[cs]ed? |copyright|all rights reserved"),
    ("table", r" \| "),
    ("contact", r"@[A-Za-z0-9-]+\.|\+[0-9]"),
    ("figures", "[0-9]"),
    ("prose", ""),
)


def topic_of(text: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    found = F.lit(topics[-1][0])
    for name, pattern in reversed(topics[:-1]):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def rake(tokens: np.ndarray, labels: Sequence[np.ndarray], targets: Sequence[np.ndarray], keep: float = KEEP) -> np.ndarray:
    """Rates of cells with which the labels of each kind have the shares ``targets`` of ``keep`` of all tokens.

    ``labels[d]`` has each cell's label number in kind ``d``. Each round scales the rates to the targets
    of one kind after another; rates stop at 1.
    """
    rates = np.full(len(tokens), float(keep))
    goal = keep * tokens.sum()
    for _ in range(ROUNDS):
        before = rates.copy()
        for of_cell, target in zip(labels, targets, strict=True):
            now = np.bincount(of_cell, tokens * rates, len(target))
            factor = np.divide(goal * target, now, out=np.zeros_like(now), where=now > 0)
            rates = np.minimum(rates * factor[of_cell], 1.0)
        if np.abs(rates - before).max() <= CLOSE:
            break
    return rates


def tempered(shares: np.ndarray, exponent: float = EXPONENT) -> np.ndarray:
    """Shares drawn towards each other: raised to ``exponent`` and scaled to sum to 1."""
    raised = np.power(shares, exponent)
    return raised / raised.sum()


def _label(name: str) -> Column:
    """The label as text that tells null, empty and the rest apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("null"))


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    targets: Sequence[dict[str, float]] | None = None,
    exponent: float = EXPONENT,
    keep: float = KEEP,
    seed: int = SEED,
    topic: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: key, source, lang, topic, tokens, probability, kept.

    ``targets`` gives shares of sources, languages and topics (labels not named share the label
    ``other``, target 0 unless named); without them the natural shares of all labels raised to
    ``exponent`` are aimed at. ``keep`` is the share of all tokens to keep; where a label has fewer
    tokens than that asks for, its documents are kept whole and less is kept in all. ``topic`` is
    a column of the caller's, such as one fitted to the texts; without it a text has the first topic whose
    pattern it matches. A document is kept if a number drawn from its key is below its rate, so repeated
    rows, and rows without a key, are kept or dropped alike. A null label is a label of its own; a null or
    blank text has no tokens and counts for nothing, but its document is sampled with its cell, or kept if
    its cell has no tokens at all. An empty table gives an empty one.
    """
    rows = written(docs.select(F.col(key).alias("key"), *_labels(text, source, lang, topic), _tokens(text)))
    rated = _rated(rows, _rates(rows, targets, exponent, keep), targets)
    found = rated.select(F.col("key").alias(key), *_KINDS, "tokens", F.col("_rate").alias("probability"), (_draw(seed, "key") < F.col("_rate")).alias("kept"))
    return found


def sampled(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    targets: Sequence[dict[str, float]] | None = None,
    exponent: float = EXPONENT,
    keep: float = KEEP,
    seed: int = SEED,
    topic: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` that :func:`mixed` keeps, all columns as they are; texts are not shuffled while the rates fit a broadcast."""
    labels = _labels(text, source, lang, topic)
    rates = _rates(docs.select(*labels, _tokens(text)), targets, exponent, keep)
    rows = _rated(docs.select(whole_row(docs), F.col(key).alias("key"), *labels), rates, targets)
    return rows.where(_draw(seed, "key") < F.col("_rate")).select("row.*")


def _labels(text: str, source: str, lang: str, topic: Column | None) -> list[Column]:
    topic = topic_of(text_or_empty(text)) if topic is None else topic.cast("string")
    return [F.col(source).alias("source"), F.col(lang).alias("lang"), topic.alias("topic")]


def _tokens(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("tokens")


def _draw(seed: int, key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _named(kind: int, targets: Sequence[dict[str, float]] | None) -> Column:
    """The label by which a row is raked: its own, or ``OTHER`` if targets do not name it."""
    label = _label(_KINDS[kind])
    if targets is None:
        return label
    named = [f"={name}" for name in sorted(targets[kind]) if name != OTHER]
    return F.when(F.array_contains(F.array(*map(F.lit, named)).cast("array<string>"), label), label).otherwise(OTHER)


def _rated(rows: DataFrame, rates: DataFrame, targets: Sequence[dict[str, float]] | None) -> DataFrame:
    """Rows with the columns of ``_KINDS``, and their cell's rate as ``_rate``."""
    keyed = rows.withColumn("_cell", F.concat_ws("\u0000", *[_named(kind, targets) for kind in range(3)]))
    return attach(keyed, rates, "_cell", "_rows").withColumn("_rate", F.coalesce("_cell_rate", F.lit(1.0)))


def _rates(rows: DataFrame, targets: Sequence[dict[str, float]] | None, exponent: float, keep: float) -> DataFrame:
    """The rate of each cell with tokens, a written table: _cell, _cell_rate, _rows."""
    if not 0 < keep <= 1:
        raise ValueError(f"keep is a share above 0 and at most 1, not {keep}")
    named = rows.select(*[_named(kind, targets).alias(name) for kind, name in enumerate(_KINDS)], "tokens")
    sums = named.groupBy(*_KINDS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("_rows"))
    cells = written(sums.where("tokens > 0"))
    goals = [written(_goal(cells, kind, None if targets is None else targets[at], exponent)) for at, kind in enumerate(_KINDS)]
    for kind, goal in zip(_KINDS, goals, strict=True):
        if not cells.isEmpty() and goal.where("goal > 0").isEmpty():
            raise ValueError(f"nothing of {kind} with a target above 0 has tokens")
    if cells.count() <= CELLS_ON_DRIVER:
        raked = _raked_on_driver(cells, goals, keep)
    else:
        raked = _raked_where_it_lies(cells, goals, keep)
    cell = F.concat_ws("\u0000", *_KINDS)
    rates = written(raked.select(cell.alias("_cell"), F.col("rate").alias("_cell_rate"), "_rows"))
    release(cells, raked, *goals)
    return rates


def _goal(cells: DataFrame, kind: str, targets: dict[str, float] | None, exponent: float) -> DataFrame:
    """(label, goal): the target share of each label that has tokens."""
    sums = cells.groupBy(kind).agg(F.sum("tokens").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 1
    if targets is None:
        wanted = F.pow(F.col("n") / F.lit(float(total)), F.lit(exponent))
    else:
        wanted = F.lit(0.0)
        for name, share in targets.items():
            wanted = F.when(F.col(kind) == (name if name == OTHER else f"={name}"), F.lit(float(share))).otherwise(wanted)
    raised = sums.select(F.col(kind).alias("label"), wanted.alias("wanted"))
    whole = raised.agg(F.sum("wanted")).first()[0] or 1.0
    return raised.select("label", (F.col("wanted") / F.lit(whole)).alias("goal"))


def _raked_on_driver(cells: DataFrame, goals: Sequence[DataFrame], keep: float) -> DataFrame:
    """:func:`rake` of at most ``CELLS_ON_DRIVER`` cells."""
    table = cells.toPandas().sort_values(_KINDS, ignore_index=True)
    labels, targets = [], []
    for kind, goal in zip(_KINDS, goals, strict=True):
        wanted = dict(goal.collect())
        names = sorted(wanted)
        labels.append(np.searchsorted(np.array(names, dtype=object), table[kind].to_numpy(dtype=object)))
        targets.append(np.array([wanted[name] for name in names]))
    rates = rake(table["tokens"].to_numpy(dtype=float), labels, targets, keep) if len(table) else np.empty(0)
    found = [(*row, float(rate)) for row, rate in zip(table[[*_KINDS, "_rows"]].itertuples(index=False), rates, strict=True)]
    schema = "source string, lang string, topic string, _rows long, rate double"
    return cells.sparkSession.createDataFrame([(a, b, c, int(n), rate) for a, b, c, n, rate in found], schema)


def _raked_where_it_lies(cells: DataFrame, goals: Sequence[DataFrame], keep: float) -> DataFrame:
    """The same by sums and joins, for a table of any size; each round is written."""
    goal_tokens = keep * (cells.agg(F.sum("tokens")).first()[0] or 0)
    table = written(cells.withColumn("rate", F.lit(float(keep))))
    for _ in range(ROUNDS):
        # the first release is of this function's own copy, so the cells stay
        now, behind = table.withColumn("_before", F.col("rate")), []
        for kind, goal in zip(_KINDS, goals, strict=True):
            sums = now.groupBy(kind).agg(F.sum(F.col("tokens") * F.col("rate")).alias("now"), F.count("*").alias("_labelled"))
            factor = F.when(F.col("now") > 0, F.lit(goal_tokens) * F.col("goal") / F.col("now")).otherwise(0.0)
            factors = written(sums.join(goal, F.col(kind) == F.col("label")).select(kind, factor.alias("_factor"), "_labelled"))
            behind.append(factors)
            now = attach(now, factors, kind, "_labelled")
            now = now.withColumn("rate", F.least(F.col("rate") * F.col("_factor"), F.lit(1.0))).drop("_factor")
        after = written(now)
        change = after.agg(F.max(F.abs(F.col("rate") - F.col("_before")))).first()[0]
        release(table, *behind)
        table = after
        if change is None or change <= CLOSE:
            break
        table_path = table.written_path
        table = table.drop("_before")
        table.written_path = table_path
    return table
