"""Best-fit packing of documents into sequences of a fixed room, planned on the histogram of lengths.

How full the sequences get depends only on how many pieces have each length, and a length is at
most the room, so the plan is made from at most ``ROOM`` counts. Longest first, each piece goes
where the least room is left that still holds it. Pieces of one length and sequences with the same
room left are taken many at a time: a row of the plan sends a stretch of ranks within a length to
a stretch of sequences. Each piece then finds its place by its rank among the pieces of its length.

A row of the plan that fills a sequence at least halves the room left in it, and each length makes
at most three new stretches of sequences, so the plan has at most ``3 * ROOM * log2(ROOM)`` rows
(147,456 for 4,096), however many documents there are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.tables import slices, text_or_empty
from parlance.llm.units import Kept, Stream, UnitIds, latin_and_marks, one_thread, spelled_out, stream
from parlance.operators.joins import fits_broadcast
from parlance.storage import release, written

ROOM = 4096
END_ID = 1
PIECE_COLUMNS = "piece int, start long, length long, ids binary"


BATCH = 4_000_000


@lru_cache(maxsize=4)
def _word_ids(path: str) -> UnitIds:
    """Ids of words between white space, where the tokenizer always starts anew.

    A lower-case word of Latin letters is what the tokenizer's normalisation and splitting make of
    it, so it goes to its merges at once, and so does such a word before a run of marks; any other goes
    through the whole tokenizer.
    """
    from tokenizers import Tokenizer

    one_thread()
    tokenizer = Tokenizer.from_file(path)
    merge = tokenizer.model.tokenize
    after = Kept(lambda marks: tokenizer.encode(marks, add_special_tokens=False).ids if marks else [])

    def encode(words: list[str]) -> list[Stream]:
        found: list[list[int] | None] = [None] * len(words)
        other = []
        for at, word in enumerate(words):
            split = latin_and_marks(word)
            if split is None or word != word.lower():
                other.append(at)
            else:
                found[at] = [token.id for token in merge(split[0])] + after[split[1]]
        for at, one in zip(other, tokenizer.encode_batch_fast([words[at] for at in other], add_special_tokens=False), strict=True):
            found[at] = one.ids
        return [stream(found)]

    return UnitIds(encode)


def _words(texts: pa.Array) -> pa.ListArray:
    """Words between ASCII white space; lower case as the tokenizer makes it, unless a special token may be written out."""
    as_they_are = pc.match_substring(texts, "<|")
    return pc.ascii_split_whitespace(pc.if_else(as_they_are, texts, pc.ascii_lower(texts)))


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each has; ``path`` is a lower-casing word-end vocabulary file."""
    words = _words(texts)
    flat = words.flatten().dictionary_encode()
    [found] = _word_ids(path).of(flat.dictionary.to_pylist())
    ids, per_word = spelled_out(found, flat.indices.to_numpy())
    ends = np.concatenate([[0], np.cumsum(per_word)])
    last = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
    return ids, np.diff(np.concatenate([[0], ends[last]]))


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", room: int = ROOM, end: int = END_ID) -> DataFrame:
    """Documents as token ids, cut only where they are longer than ``room``: key, piece, start, length, ids.

    A document's ids are those of its whole text, then ``end``; a null text is empty, so that every
    row, repeated ones too, gives at least one piece. ``ids`` are little-endian unsigned 32-bit
    numbers; ``start`` counts the document's ids before the piece. Other columns are left out.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, chars=BATCH):
                yield _cut(part, path, room, end)

    rows = docs.select(F.col(f"`{key}`").alias("key"), text_or_empty(f"`{text}`").alias("text"))
    found = rows.mapInArrow(cut, f"key {rows.schema['key'].dataType.simpleString()}, {PIECE_COLUMNS}")
    return found.withColumnRenamed("key", key)


def _cut(batch: pa.RecordBatch, path: str, room: int, end: int) -> pa.RecordBatch:
    ids, counts = encoded(batch.column("text"), path)
    ids = np.insert(ids, np.cumsum(counts), end)
    counts = counts + 1
    many = -(-counts // room)
    owner = np.repeat(np.arange(len(counts)), many)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = piece * room
    length = np.minimum(room, counts[owner] - start)
    stops = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
    data = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(stops), pa.py_buffer(ids.astype("<u4").tobytes())])
    arrays = [batch.column("key").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "piece", "start", "length", "ids"])


def best_fit(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int, int]]:
    """The plan for ``counts`` of pieces by length: (length, first, items, each, sequence, offset).

    The ``items`` pieces of ``length`` from rank ``first`` on go ``each`` to a sequence, from number
    ``sequence`` and place ``offset`` on. Longest first, and each piece where the least room
    is left that still holds it, as if they were placed one by one.
    """
    plan = []
    left: list[int] = []  # the different amounts of room left, sorted
    stretches: dict[int, list[tuple[int, int]]] = {}  # room left -> stretches of sequences (first, count)
    used = 0

    def put_back(rest: int, first: int, count: int) -> None:
        if rest and count:
            if rest not in stretches:
                insort(left, rest)
            stretches.setdefault(rest, []).append((first, count))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= room:
            raise ValueError(f"a piece of length {length} does not fit {room}")
        items, rank = counts[length], 0
        while items:
            at = bisect_left(left, length)
            if at < len(left):
                rest = left[at]
                first, count = stretches[rest].pop()
                if not stretches[rest]:
                    del stretches[rest], left[at]
            else:
                rest, first = room, used
                count = -(-items // (room // length))
                used += count
            each = rest // length
            full, over = divmod(items, each)
            full, over = (count, 0) if full >= count else (full, over)
            if full:
                plan.append((length, rank, full * each, each, first, room - rest))
                put_back(rest - each * length, first, full)
                rank, items = rank + full * each, items - full * each
            if over:
                plan.append((length, rank, over, over, first + full, room - rest))
                put_back(rest - over * length, first + full, 1)
                rank, items, full = rank + over, items - over, full + 1
            put_back(rest, first + full, count - full)
    return plan


def _ranked(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and the place of each row among the task's rows of its length."""
    part = TaskContext.get().partitionId()
    seen = np.zeros(room + 1, np.int64)
    for batch in batches:
        length = batch.column("length").to_numpy()
        if not len(length):
            continue
        order = np.argsort(length, kind="stable")
        values, starts, counts = np.unique(length[order], return_index=True, return_counts=True)
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.repeat(starts - seen[values], counts)
        seen[values] += counts
        names = [*batch.schema.names, "_part", "_rank"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)], names=names)


def placed(found: DataFrame, room: int = ROOM) -> DataFrame:
    """Adds sequence_id and offset to rows with a column ``length`` from 1 to ``room``.

    The rows are written once with their rank within task and length; only counts are shuffled.
    Lengths outside 1 to ``room``, or null, fail. Which of two equal lengths gets which place
    follows the order of the rows in the input. No rows give no rows.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema), "_part int", "_rank long"])
    checked = found.withColumn("length", F.when(F.col("length").between(1, room), F.col("length").cast("long")).otherwise(
        F.raise_error(F.lit(f"a length must be from 1 to {room}")).cast("long")
    ))
    rows = written(checked.mapInArrow(lambda batches: _ranked(batches, room), schema.replace("`length` int", "`length` long")))
    sizes = written(rows.groupBy("length", "_part").agg(F.count("*").alias("_n")))
    counts = {row["length"]: row["n"] for row in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = written(sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))
    names = ["length", "_first", "_items", "_each", "_sequence", "_offset"]
    plan = rows.sparkSession.createDataFrame(
        best_fit(counts, room) or [(0,) * 6], ", ".join(f"{name} long" for name in names)
    )
    release(sizes)
    ranked = rows.join(F.broadcast(shifts) if fits_broadcast(shifts) else shifts, ["length", "_part"])
    rank = F.col("_rank") + F.col("_shift")
    ranked = ranked.withColumn("_rank", rank).withColumnRenamed("length", "_length")
    slot = F.col("_rank") - F.col("_first")
    here = (F.col("_length") == F.col("length")) & (slot >= 0) & (slot < F.col("_items"))
    return ranked.join(F.broadcast(plan), here).select(
        *[F.col("_length").alias("length") if name == "length" else F.col(f"`{name}`") for name in found.columns],
        (F.col("_sequence") + F.floor(slot / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + slot % F.col("_each") * F.col("_length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", room: int = ROOM, end: int = END_ID) -> DataFrame:
    """Every document's ids, packed: key, piece, start, length, ids, sequence_id, offset (see :func:`pieces`, :func:`placed`)."""
    return placed(pieces(docs, path, key, text, room, end), room)
