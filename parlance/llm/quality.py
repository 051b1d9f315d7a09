"""Quality rules: statistics of texts and a decision list learned from labelled ones.

Rules for bad texts are learned one after another (sequential covering, as in RIPPER): a
conjunction of thresholds is grown on two thirds of the labelled texts, pruned on the rest, taken
if it is precise enough there, and the texts it covers are set aside for the next. The list becomes
one Spark expression, so each verdict can be traced to a rule that reads as a sentence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import slices

# Bound of the training sample: labelled documents.
SAMPLE_ROWS = 20_000
MOST_RULES = 12
MOST_CONDITIONS = 4
THRESHOLDS = 48
LEAST_PRECISION = 0.9
LEAST_COVERED = 5

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
LEAST_WORDS = 50
MOST_REPEATED = 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits", "n_upper"]

# What conditions look at: name and SQL over the counts.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
}


def counts_of(text: str | None) -> tuple[int, ...]:
    """The numbers of :data:`COUNTS` for one text; null counts as empty.

    Words are runs without ASCII white space. ``n_dup_lines`` counts lines with a word that equal
    an earlier line, ``n_lines`` lines with a word, ``n_repeat_words`` words in any window of
    three words that occurs twice or more.
    """
    text = text or ""
    stored = text.encode()
    words = stored.split()
    lines = [line for line in stored.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        len(set(words)),
        sum(map(text.count, "0123456789")),
        len(stored) - len(stored.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def _repeated(words: list[bytes]) -> int:
    seen: set[tuple] = set()
    again: set[tuple] = set()
    for window in zip(words, words[1:], words[2:], strict=False):
        if window in seen:
            again.add(window)
        else:
            seen.add(window)
    if not again:
        return 0
    inside = np.zeros(len(words) + 2, dtype=bool)
    places = [at for at, window in enumerate(zip(words, words[1:], words[2:], strict=False)) if window in again]
    for shift in range(3):
        inside[np.array(places) + shift] = True
    return int(inside.sum())


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Key, the columns ``more`` and :data:`COUNTS` of each row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                table = np.array([counts_of(t) for t in part.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
                found = [pa.array(table[:, i]) for i in range(len(COUNTS))]
                kept = [part.column(name) for name in ("key", *more)]
                yield pa.RecordBatch.from_arrays([*kept, *found], names=["key", *more, *COUNTS])

    rows = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text", *(f"`{name}`" for name in more))
    types = {field.name: field.dataType.simpleString() for field in rows.schema}
    schema = ", ".join([*(f"`{name}` {types[name]}" for name in ("key", *more)), *(f"{name} long" for name in COUNTS)])
    return rows.mapInArrow(measure, schema).withColumnRenamed("key", key)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        column = values[self.feature]
        return column > self.threshold if self.above else column <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covered(rule: Sequence[Condition], values: dict[str, np.ndarray]) -> np.ndarray:
    found = np.ones(len(next(iter(values.values()))), dtype=bool)
    for condition in rule:
        found &= condition.covers(values)
    return found


def learn_rules(values: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = LEAST_PRECISION) -> list[Rule]:
    """An ordered list of rules for the rows where ``bad`` is true; rows should come in no meaningful order."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    prune_part = np.arange(len(bad)) % 3 == 2
    while len(rules) < MOST_RULES and (bad & left).sum() >= LEAST_COVERED:
        grow, prune = left & ~prune_part, left & prune_part
        rule = _pruned(_grown(_rows(values, grow), bad[grow]), _rows(values, prune), bad[prune])
        hits = covered(rule, values) & left if rule else np.zeros(len(bad), dtype=bool)
        checked = hits & prune
        if hits.sum() < LEAST_COVERED or not checked.any():
            break
        if min(bad[hits].mean(), bad[checked].mean()) < least_precision:
            break
        rules.append(tuple(rule))
        left &= ~hits
    return rules


def _rows(values: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {name: column[which] for name, column in values.items()}


def _grown(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Conditions added while they gain information about the bad rows (FOIL's gain)."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MOST_CONDITIONS and (bad & inside).any() and (~bad & inside).any():
        held = np.log2(bad[inside].mean())
        best: tuple[float, Condition] | None = None
        for name, column in values.items():
            some = column[inside]
            for threshold in np.unique(np.quantile(some, np.linspace(0, 1, THRESHOLDS + 1)[:-1], method="lower")).tolist():
                above = some > threshold
                for side, hits in ((True, above), (False, ~above)):
                    p = int((bad[inside] & hits).sum())
                    if not p:
                        continue
                    gain = p * (np.log2(p / hits.sum()) - held)
                    if best is None or gain > best[0]:
                        best = (gain, Condition(name, side, threshold))
        if best is None or best[0] <= 0:
            break
        rule.append(best[1])
        inside &= best[1].covers(values)
    return rule


def _pruned(rule: list[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The rule without those last conditions that do not help on rows it was not grown on."""

    def worth(some: list[Condition]) -> float:
        hits = covered(some, values)
        return (2 * bad[hits].sum() - hits.sum()) / max(int(hits.sum()), 1)

    best = rule
    for size in range(len(rule) - 1, 0, -1):
        if worth(rule[:size]) >= worth(best):
            best = rule[:size]
    return best


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """Rules from at most ``rows`` labelled documents, those whose keys have the smallest hashes.

    ``label`` is 1 for good and 0 for bad; of contradicting labels the bad one holds. Documents
    that fail the base rules are not learned from. Without labels there are no rules.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).alias("_label"), F.xxhash64(key).alias("_draw")
    )
    sample = known.orderBy("_draw", "_key", "_label").limit(rows).groupBy("_key", "_draw").agg(F.min("_label").alias("_label"))
    # at most ``rows`` rows of three numbers
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("key") == F.col("_key"))
    measured = statistics(chosen, "key", "text", "_draw", "_label").where(~base_failed())
    features = [F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()]
    table = measured.select("_draw", "_label", *features).orderBy("_draw", "_label", *FEATURES).limit(rows).toArrow()
    values = {name: table.column(name).to_numpy() for name in FEATURES}
    return learn_rules(values, table.column("_label").to_numpy() == 0)


def verdict(rules: Sequence[Rule]) -> Column:
    """Number (from 1) of the first rule that covers a row, null if none does."""
    found = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        whole = rule[0].column()
        for condition in rule[1:]:
            whole &= condition.column()
        found = F.when(whole, F.lit(number)).otherwise(found)
    return found


def judged(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, :data:`COUNTS`, base_failed, rule, kept.

    A document goes if it fails the base rules (fewer than 50 words, or over half of its words in
    repeated windows) or if a learned rule covers it; ``rule`` is that rule's number. A null text
    counts as empty and goes. Repeated rows and null keys are judged like any other.
    """
    measured = statistics(docs, key, text).withColumn("base_failed", base_failed())
    ruled = measured.withColumn("rule", verdict(rules))
    return ruled.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
