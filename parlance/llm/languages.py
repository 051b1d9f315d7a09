"""Language by cross-parsing: the language whose text needs the fewest phrases to spell a document.

For each language a suffix automaton is built over a bounded sample of labelled text. A document is
parsed from left to right, from its start to its end, into the longest phrases that occur in that
sample (Ziv and Merhav's cross-parsing). In a longer sample phrases are longer, by its logarithm, so
phrases times the logarithm of the sample's length estimate the cross entropy, and the smallest wins.

Automata are walked for all documents of a batch and all languages at once, one step per position.
The moves of a language's most frequent letters are a table; those of all other letters of its sample,
of which a large script has thousands, are a sorted list that is searched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.tables import slices

# Bounds of the training sample: texts per language, characters of each, and languages.
SAMPLE_TEXTS = 50
SAMPLE_CHARS = 800
MOST_LANGUAGES = 100
# Letters of a language whose moves are in its table; the others' are in its list, to the same effect.
TABLE_LETTERS = 64
BATCH = 3_000_000
UNKNOWN_LANGUAGE = "und"
HELD_OUT = 2
_PARTS = 64


def held_out(key: str = "doc_id") -> Column:
    """Documents never learned from: crc32 of the key as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == HELD_OUT, F.lit(False))


@dataclass
class Automata:
    """Languages in alphabetic order and their automata.

    ``classes`` numbers the letters of all samples by code point: 0 for anything but a letter,
    ``unknown`` for a letter that no sample has. ``columns`` has a row per language: the column of
    its table for each number; the last column but one is for letters that its sample lacks, the last
    for letters that its list has. An entry of a table is twice the place of the next state's row, plus 1
    if the letter starts a new phrase; places count from the language's part of ``table``, which
    starts at ``base``. ``listed`` has per language the sorted keys (state's place times ``unknown``
    plus 1, plus the letter) of its list, ``moves`` their entries, and ``fresh`` per number the entry
    from the first state. ``scale`` is the logarithm of each sample's length.
    """

    languages: list[str]
    classes: np.ndarray
    unknown: int
    columns: np.ndarray
    table: np.ndarray
    base: np.ndarray
    widths: np.ndarray
    listed: list[np.ndarray]
    moves: list[np.ndarray]
    fresh: list[np.ndarray]
    scale: np.ndarray

    def folded(self, text: str) -> np.ndarray:
        """Numbers of the letters of the lower-cased text, each run of characters that are no letters made one."""
        return _folded(self.classes, text)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        total = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not len(texts) or not lengths.max():
            return total
        order = np.argsort(-lengths, kind="stable")
        letters = np.concatenate([texts[at] for at in order])
        starts = np.cumsum(lengths[order]) - lengths[order]
        rare = np.array([(self.columns[:, number] == self.widths - 1).any() for number in range(self.unknown + 1)])
        base = self.base[:, None]
        state = np.zeros((len(self.languages), len(texts)), dtype=np.int64)
        found = np.zeros(state.shape, dtype=np.int64)
        going = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max()) + 1), side="right")
        for step, n in enumerate(going.tolist()):
            now = letters[starts[:n] + step]
            entry = self.table.take(base + state[:, :n] + self.columns[:, now])
            if rare[now].any():
                self._search(entry, state[:, :n], now)
            found[:, :n] += entry & 1
            state[:, :n] = entry >> 1
        total[order] = found.T
        return total

    def _search(self, entry: np.ndarray, state: np.ndarray, now: np.ndarray) -> None:
        """Put in the entries of letters that are in a language's list."""
        for at, (keys, moves, fresh) in enumerate(zip(self.listed, self.moves, self.fresh, strict=True)):
            some = np.flatnonzero(self.columns[at, now] == self.widths[at] - 1)
            if len(some):
                wanted = state[at, some] * (self.unknown + 1) + now[some].astype(np.int64)
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                entry[at, some] = np.where(keys[place] == wanted, moves[place], fresh[now[some]])


def _folded(classes: np.ndarray, text: str) -> np.ndarray:
    found = classes[np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)]
    keep = np.ones(len(found), dtype=bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    return found[keep]


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the first."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in sequence:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = following[at][symbol]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and following[at].get(symbol) == target:
                    following[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return following


Samples = tuple[tuple[str, tuple[str, ...]], ...]


def sampled(samples: dict[str, list[str]]) -> Samples:
    return tuple((language, tuple(texts)) for language, texts in sorted(samples.items()))


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(code).isalpha() for code in range(0x110000)])


@lru_cache(maxsize=2)
def build(samples: Samples) -> Automata:
    """Automata of the sampled texts of each language; texts are kept apart by a sign of their own."""
    lowered = [(language, [text.lower() for text in texts]) for language, texts in samples]
    known = sorted({c for _, texts in lowered for text in texts for c in text if c.isalpha()})
    # numbers: 0 no letter, then the letters, one for all others
    unknown = len(known) + 1
    classes = np.where(_is_letter(), unknown, 0).astype(np.int16 if unknown < 32_767 else np.int32)
    classes[[ord(c) for c in known]] = np.arange(1, unknown)
    border = unknown + 1
    columns = np.zeros((len(lowered), unknown + 1), dtype=np.int64)
    tables, bases, widths, listed, moves, fresh, scale, rows = [], [], [], [], [], [], [], 0
    for at, (_, texts) in enumerate(lowered):
        sequence: list[int] = []
        for text in texts:
            sequence.extend(_folded(classes, text).tolist())
            sequence.append(border)
        uses = Counter(number for number in sequence if 0 < number < unknown)
        often = sorted(uses, key=lambda number: (-uses[number], number))[:TABLE_LETTERS]
        # columns: 0 no letter, the frequent letters, letters that the sample lacks, letters in the list
        width = len(often) + 3
        columns[at] = width - 2
        columns[at, [0, *often]] = np.arange(len(often) + 1)
        columns[at, [number for number in uses if number not in set(often)]] = width - 1
        column = {number: int(columns[at, number]) for number in [0, *uses]}
        following = suffix_automaton(sequence)
        first = np.full(width, 1, dtype=np.int32)
        entries = np.ones(unknown + 1, dtype=np.int64)
        keys: list[int] = []
        targets: list[int] = []
        for symbol, target in following[0].items():
            if symbol != border:
                entries[symbol] = 2 * target * width + 1
                if column[symbol] < width - 1:
                    first[column[symbol]] = entries[symbol]
        table = np.tile(first, (len(following), 1))
        for state, those in enumerate(following[1:], 1):
            for symbol, target in those.items():
                if symbol == border:
                    continue
                if column[symbol] < width - 1:
                    table[state, column[symbol]] = 2 * target * width
                else:
                    keys.append(state * width * (unknown + 1) + symbol)
                    targets.append(2 * target * width)
        del following
        order = np.argsort(np.array(keys, dtype=np.int64))
        listed.append(np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max))
        moves.append(np.append(np.array(targets, dtype=np.int64)[order], 0))
        tables.append(table.ravel())
        bases.append(rows)
        widths.append(width)
        fresh.append(entries)
        scale.append(np.log(max(len(sequence), 2)))
        rows += table.size
    table = np.concatenate(tables) if tables else np.empty(0, np.int32)
    return Automata(
        [language for language, _ in lowered], classes, unknown, columns, table, np.array(bases, dtype=np.int64),
        np.array(widths, dtype=np.int64), listed, moves, fresh, np.array(scale),
    )


def learn(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    texts: int = SAMPLE_TEXTS,
    chars: int = SAMPLE_CHARS,
    languages: int = MOST_LANGUAGES,
) -> Samples:
    """Samples of at most ``texts`` different texts of each of the ``languages`` most frequent labels.

    Only text and label of documents that are not :func:`held_out` are learned from. The texts
    with the smallest hashes are taken, and ``chars`` characters of each, so the driver gets at
    most ``texts * chars * languages`` characters. The rows are counted, hashed and picked
    without their texts.
    """
    usable = ~held_out(key) & F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
    labelled = docs.where(usable).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("draw"), F.col(text).alias("text"))
    each = labelled.groupBy("lang", "draw").agg(F.count("*").alias("n"))
    most = each.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    # first of parts of a language, then of what is left of it: a hot language is no one's task
    part = F.pmod("draw", F.lit(_PARTS))
    of_part = F.row_number().over(Window.partitionBy("lang", part).orderBy("draw"))
    best = each.join(F.broadcast(most), "lang").select("lang", "draw", of_part.alias("place")).where(F.col("place") <= texts)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    picked = best.select("lang", "draw", place.alias("place")).where(F.col("place") <= texts)
    excerpts = (
        labelled.join(F.broadcast(picked.select("lang", "draw")), ["lang", "draw"])
        .groupBy("lang", "draw")
        .agg(F.min(F.substring("text", 1, chars)).alias("excerpt"))
    )
    samples: dict[str, list[str]] = {}
    for row in sorted(excerpts.collect()):
        samples.setdefault(row["lang"], []).append(row["excerpt"])
    return sampled(samples)


def predict(texts: list[str | None], model: Automata) -> tuple[list[str], np.ndarray]:
    """The language of each text and how sure it is: 1 less the ratio of its normalised phrases to the runner-up's."""
    folded = [model.folded(t or "") for t in texts]
    spelled = np.array([bool(f.any()) for f in folded], dtype=bool)
    score = np.zeros(len(texts))
    if not model.languages or not len(texts):
        return [UNKNOWN_LANGUAGE] * len(texts), score
    phrases = model.phrases(folded) * model.scale
    best = phrases.argmin(axis=1)
    if len(model.languages) == 1:
        score[spelled] = 1.0
    else:
        two = np.partition(phrases, 1, axis=1)[:, :2]
        score[spelled] = 1 - two[spelled, 0] / two[spelled, 1]
    return [model.languages[b] if ok else UNKNOWN_LANGUAGE for b, ok in zip(best.tolist(), spelled.tolist(), strict=True)], score


def identified(docs: DataFrame, model: Samples, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, lang_pred, score.

    The prediction looks at the whole text and at nothing else. A null text or one without a
    letter is ``und`` with score 0, and so is everything if no label was learned; on a tie the
    first language by name wins, with score 0. A null key is not held out. Repeated rows stay.
    """
    rows = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    found = _parsed(rows, model, "key").withColumnRenamed("key", key)
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, model: Samples, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns in place, with the predicted language as ``lang``."""
    own = [c for c in docs.columns if c not in (text, lang)]
    # numbered names, so that no column of the caller's can clash with those added here
    rows = docs.select(F.col(text).alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    found = _parsed(rows, model, "text", *[f"c{i}" for i in range(len(own))])
    place = {text: "text", lang: "lang_pred"} | {c: f"c{i}" for i, c in enumerate(own)}
    return found.select(*[F.col(place[c]).alias(c) for c in docs.columns])


def _parsed(rows: DataFrame, model: Samples, *kept: str) -> DataFrame:
    """The columns ``kept`` of rows that have a column text, and lang_pred and score.

    What is broadcast is the sample, whose bounds :func:`learn` states; each Python worker builds its automata once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                found, score = predict(part.column("text").to_pylist(), build(shared.value))
                columns = [*(part.column(name) for name in kept), pa.array(found, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    schema = T.StructType([*(rows.schema[name] for name in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(parse, schema)
