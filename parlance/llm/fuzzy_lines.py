"""Repeated lines, small differences allowed: one occurrence of each group of like lines stays.

Lines are normalised and get a 64-bit SimHash of their words. Two fingerprints that differ in at
most 3 bits agree in two of five blocks of bits, so lines meet in a list for each pair of blocks.
Lists only give candidates: fingerprints are grouped over differences of at most 3 bits, then the
texts of groups of two or more lines are fetched, and a link is a pair with at most 3 differing
bits and an edit similarity of at least 0.8. Of the lines that links connect the first stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.links import close_pairs, forest, groups, linked, spread
from parlance.llm.near_texts import majority
from parlance.llm.tables import slices, whole_row
from parlance.storage import bucketed, release, written

LEAST_WORDS = 5
MOST_BITS = 3
LEAST_SIMILARITY = 0.8
BLOCK_BITS = (13, 13, 13, 13, 12)
AGREE = len(BLOCK_BITS) - MOST_BITS
LAST_KEY = (1 << 63) - 1
_LINE_FACTOR, _USE_FACTOR, _MIX_FACTOR = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_SPACES = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_PLAIN = bytes.maketrans(b"0123456789" + _SPACES, b"0" * 10 + b" " * len(_SPACES))


def normalised(text: str) -> list[list[bytes]]:
    """The words of each line: lower case, digits alike, ASCII punctuation taken for spaces."""
    return [line.split() for line in text.lower().encode().translate(_PLAIN).split(b"\n")]


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """(number, doc, row) of each row, written once: ``number`` is the row's own, ``doc`` the key, or the largest long if that is null.

    ``row`` has all columns. Rows lie in buckets by number, so that what is found about them, which is
    narrow, comes to them and no text is shuffled again.
    """
    number = F.monotonically_increasing_id().alias("number")
    rows = docs.select(number, _key_or_last(key).alias("doc"), whole_row(docs))
    return bucketed(rows, "number")


def lines_of(rows: DataFrame) -> DataFrame:
    """(place, h1, h2, print) of each line of ``LEAST_WORDS`` words or more of :func:`numbered` rows.

    ``place`` orders lines by key (null last), row and line number; h1 and h2 are the halves of a
    128-bit hash of the normalised line.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _measured(*(part.column(name).to_pylist() for name in ("doc", "number", "text")))

    found = rows.select("doc", "number", "text").mapInArrow(measure, "doc long, number long, line int, h1 long, h2 long, print long")
    return found.select(F.struct("doc", "number", "line").alias("place"), "h1", "h2", "print")


def _measured(keys: list[int], rows: list[int], texts: list[str | None]) -> pa.RecordBatch:
    docs, owners, numbers, digests, hashes, counts = [], [], [], [], [], []
    for key, row, text in zip(keys, rows, texts, strict=True):
        for number, words in enumerate(normalised(text or "")):
            if len(words) < LEAST_WORDS:
                continue
            docs.append(key)
            owners.append(row)
            numbers.append(number)
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            hashes.extend([xxhash.xxh64_intdigest(word) for word in words])
            counts.append(len(words))
    halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    prints = fingerprints(np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64))
    places = [pa.array(docs, pa.int64()), pa.array(owners, pa.int64()), pa.array(numbers, pa.int32())]
    columns = [*places, pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(prints)]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "number", "line", "h1", "h2", "print"])


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each run of ``counts`` words' hashes.

    Each further use of a word in a line is a feature of its own, so frequent words do not draw
    the fingerprints of all lines towards theirs.
    """
    line = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    order = np.argsort(hashes ^ line * _LINE_FACTOR, kind="stable")
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (line[order][1:] == line[order][:-1])
    places = np.arange(len(hashes))
    use = np.empty(len(hashes), dtype=np.uint64)
    use[order] = places - np.maximum.accumulate(np.where(same, 0, places))
    features = (hashes + use * _USE_FACTOR) * _MIX_FACTOR
    return majority(features ^ features >> np.uint64(32), counts).view(np.int64)


def _key_or_last(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY))


def index_lists(prints: DataFrame) -> DataFrame:
    """``block`` (names two blocks of bits and their values) and print, for each choice of blocks."""
    starts = np.cumsum([0, *BLOCK_BITS])
    masks = [sum(((1 << BLOCK_BITS[at]) - 1) << int(starts[at]) for at in chosen) for chosen in combinations(range(len(BLOCK_BITS)), AGREE)]
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in masks]
    chosen = spread(prints, "print").select("print", F.explode(F.array(*[F.lit(mask).cast("long") for mask in signed])).alias("mask"))
    return chosen.select(F.xxhash64("mask", F.col("mask").bitwiseAND(F.col("print"))).alias("block"), "print")


def _near(different: np.ndarray) -> np.ndarray:
    return np.bitwise_count(different.view(np.uint64)) <= MOST_BITS


def _near_prints(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    prints = rows.column("print").to_numpy()
    pairs = [(prints[i], prints[j]) for i, j in close_pairs(rows.column("block").to_numpy(), prints, _near) if len(i)]
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(*(np.concatenate(side) for side in zip(*pairs, strict=True)))


def _alike_lines(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in each list; a pair already joined by links is not compared."""
    block, prints, ids = (rows.column(name).to_numpy() for name in ("block", "print", "id"))
    texts = [words.decode() for words in rows.column("words").to_pylist()]
    label = np.arange(len(ids))
    a, b = [], []
    for first, second in close_pairs(block, prints, _near):
        apart = label[first] != label[second]
        for i, j in zip(first[apart].tolist(), second[apart].tolist(), strict=True):
            if label[i] != label[j] and alike(texts[i], texts[j]):
                label[label == label[j]] = label[i]
                a.append(ids[i])
                b.append(ids[j])
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def alike(a: str, b: str, least: float = LEAST_SIMILARITY) -> bool:
    """Whether 1 less the edit distance over the longer length is at least ``least``."""
    longest = max(len(a), len(b))
    most = int(longest * (1 - least) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    start = _common(a, b)
    a, b = a[start:], b[start:]
    end = _common(a[::-1], b[::-1])
    return distance(a[: len(a) - end], b[: len(b) - end]) <= most


def _common(a: str, b: str) -> int:
    """Length of the common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def distance(a: str, b: str) -> int:
    """Edit distance; the rows of the table as bits of whole numbers (Myers, 1999)."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, len(a) - 1
    up, down, found = full, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        steady = same | down
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(across | up)), up & across
        found += (rise >> top & 1) - (fall >> top & 1)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | (full & ~(steady | rise)), rise & steady
    return found


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(number, doc, removed): for each row with lines that go, an array of (line, first_doc, first_line), by line.

    ``line`` counts from 0; ``first_doc`` and ``first_line`` tell the occurrence that stays. ``number``
    is the row's own; ``doc`` is the key, or the largest long if that is null. Lines of fewer than five
    words always stay. The first occurrence is that of the smallest key (null last), row and line;
    rows that share a key, or have none, each keep and lose lines of their own.
    """
    rows = numbered(docs.select(F.col(key), F.col(text)), key)
    found = _removed(rows.select("number", "doc", F.col("row").getField(text).alias("text")))
    release(rows)
    return found


def _removed(rows: DataFrame) -> DataFrame:
    """The lines that go of :func:`numbered` rows, see :func:`repeated_lines`."""
    lines = written(lines_of(rows))
    different = written(
        lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("print").alias("print"), F.count("*").alias("n"))
    )
    members = _candidates(different)
    links = linked(_texts_of(members, rows), "id", _alike_lines)
    classes = groups(links)
    named = classes.withColumnRenamed("group", "class")
    of_class = members.join(named, F.col("id") == F.col("node"), "left").select(
        "h1", "h2", "first", F.coalesce("class", "id").alias("class")
    )
    least = of_class.groupBy("class").agg(F.min("first").alias("kept"))
    moved = of_class.join(least, "class").select("h1", "h2", "kept")
    placed = different.join(moved, ["h1", "h2"], "left").withColumn("kept", F.coalesce("kept", "first"))
    # written, so that the join below has plain exchanges on both sides and a hot line can be split
    keepers = written(placed.where((F.col("n") > 1) | (F.col("kept") != F.col("first"))).select("h1", "h2", "kept"))
    gone = lines.join(keepers, ["h1", "h2"]).where(F.col("place") != F.col("kept"))
    entry = F.struct(F.col("place.line").alias("line"), F.col("kept.doc").alias("first_doc"), F.col("kept.line").alias("first_line"))
    by_row = gone.select("place.number", "place.doc", entry.alias("entry")).groupBy("number")
    found = written(by_row.agg(F.first("doc").alias("doc"), F.array_sort(F.collect_set("entry")).alias("removed")))
    release(lines, different, members, links, classes, keepers)
    return found


def _candidates(different: DataFrame) -> DataFrame:
    """Different lines that another one may be like, numbered, with the group of their fingerprint."""
    links = linked(index_lists(different.select("print").distinct()), "print", _near_prints)
    prints = groups(links)
    near = different.join(prints, F.col("print") == F.col("node"), "left").select(
        "h1", "h2", "first", "print", F.coalesce("group", "print").alias("group")
    )
    shared = near.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("group")
    found = written(near.join(shared, "group").withColumn("id", F.monotonically_increasing_id()))
    release(links, prints)
    return found


def _texts_of(members: DataFrame, rows: DataFrame) -> DataFrame:
    """The normalised texts of the members, from the rows where they stand first; ``block`` is the group."""
    member = F.struct(F.col("first.line").alias("line"), "id", F.col("group").alias("block"), "print")
    wanted = members.select("first.number", member.alias("member"))
    types = {"block": pa.int64(), "id": pa.int64(), "print": pa.int64(), "words": pa.binary()}
    per_row = wanted.groupBy("number").agg(F.collect_list("member").alias("members"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: dict[str, list] = {name: [] for name in types}
                for body, some in zip(part.column("text").to_pylist(), part.column("members").to_pylist(), strict=True):
                    lines = (body or "").split("\n")
                    for member in some:
                        for name in ("block", "id", "print"):
                            out[name].append(member[name])
                        out["words"].append(b" ".join(normalised(lines[member["line"]])[0]))
                yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in types.items()], names=list(types))

    found = rows.join(per_row, "number").select("text", "members")
    return found.mapInArrow(read, "block long, id long, print long, words binary")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without their repeated lines; rows left without a word go, if they lost a line.

    All other columns stay as they are.
    """
    own = numbered(docs, key)
    found = _removed(own.select("number", "doc", F.col("row").getField(text).alias("text")))
    gone = found.select("number", F.transform("removed", lambda r: r["line"]).alias("gone"))
    rows = own.join(gone, "number", "left")
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - F.lit(1)), F.col("gone"))
    left = F.array_join(F.transform(numbers, lambda i: F.get(F.col("lines"), i)), "\n")
    texts = (
        rows.withColumn("lines", F.split(F.col("row").getField(text), "\n", -1))
        .withColumn("left", F.when(F.col("gone").isNull(), F.col("row").getField(text)).otherwise(left))
        .where(F.col("gone").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    )
    return texts.select(*[F.col("left").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_lines, n_removed, removed (array of (line, first_doc, first_line)).

    A null text has no lines; an empty one has one. See :func:`repeated_lines` for keys.
    """
    rows = numbered(docs.select(F.col(key), F.col(text)), key)
    body = F.col("row").getField(text)
    removed = _removed(rows.select("number", "doc", body.alias("text")))
    n_lines = F.coalesce(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + F.lit(1), F.lit(0)).cast("long")
    # without the texts, so that these can go
    sizes = written(rows.select("number", F.col("row").getField(key).alias(key), n_lines.alias("n_lines")))
    release(rows)
    nothing = F.array().cast(removed.schema["removed"].dataType)
    found = F.coalesce("removed", nothing)
    report = sizes.join(removed.drop("doc"), "number", "left")
    return report.select(key, "n_lines", F.size(found).cast("long").alias("n_removed"), found.alias("removed"))
