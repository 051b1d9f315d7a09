"""Near-duplicate texts by SimHash fingerprints and an inverted index of their bytes.

Two fingerprints of 64 bits that differ in at most 4 bits agree in at least 4 of their 8 bytes.
A list of the index holds the fingerprints with given bytes at given positions. Lists of single
bytes would each hold a 256th of the corpus, so a list is kept for each choice of four positions
and their bytes: only the pairs in such a list can reach the count. In the lists the shared bytes
of each pair are tallied, pairs with 4 or more pass, and their differing bits are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.links import close_pairs, forest, groups, linked, spread
from parlance.llm.tables import slices
from parlance.storage import release, written

SHINGLE_WORDS = 4
MOST_BITS = 4
BYTES = 8
SHARED_BYTES = BYTES - MOST_BITS
SEED = 42
_LANES = np.uint64(0x0001000100010001)
_LANE_MOST = 65_535


def fingerprints(texts: list[str | None], size: int = SHINGLE_WORDS) -> np.ndarray:
    """SimHash of each text as int64: bit set if over half of the shingles' hashes have it; no word: 0."""
    hashes, counts = [], []
    for text in texts:
        words = (text or "").encode().lower().split()
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        ends = ends[min(size, len(words)) - 1 :].tolist() if words else []
        hashes.append(np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=False)], dtype=np.uint64))
        counts.append(len(ends))
    return majority(np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.array(counts, dtype=np.int64)).view(np.int64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the bits that more than half of them have.

    Bits are added up four at a time in the four 16-bit fields of a word.
    """
    found = np.zeros((len(counts), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for first in range(0, len(hashes), _LANE_MOST):
        part, own = hashes[first : first + _LANE_MOST], owner[first : first + _LANE_MOST]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for shift in range(16):
            sums = np.add.reduceat(part >> np.uint64(shift) & _LANES, starts)
            for lane in range(4):
                found[own[starts], shift + 16 * lane] += (sums >> np.uint64(16 * lane) & np.uint64(0xFFFF)).astype(np.int64)
    bits = (2 * found > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``print`` (long) of each row."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = pa.array(fingerprints(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("key"), found], names=["key", "print"])

    rows = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, print long"
    return rows.mapInArrow(prints, schema).withColumnRenamed("key", key)


def _near(different: np.ndarray) -> np.ndarray:
    """Pairs that share enough bytes, and then few enough different bits."""
    shared = (different.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    near = shared >= SHARED_BYTES
    near[near] = np.bitwise_count(different[near].view(np.uint64)) <= MOST_BITS
    return near


def _forest_of_list(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    prints = rows.column("print").to_numpy()
    pairs = [(prints[i], prints[j]) for i, j in close_pairs(rows.column("block").to_numpy(), prints, _near) if len(i)]
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(*(np.concatenate(side) for side in zip(*pairs, strict=True)))


def index_lists(prints: DataFrame) -> DataFrame:
    """The index over different fingerprints: ``block`` (names the chosen positions and their bytes) and print."""
    masks = [sum(0xFF << (8 * at) for at in chosen) for chosen in combinations(range(BYTES), SHARED_BYTES)]
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in masks]
    chosen = spread(prints, "print").select("print", F.explode(F.array(*[F.lit(mask).cast("long") for mask in signed])).alias("mask"))
    # two lists whose names fall together make one longer list: more is compared, nothing lost
    return chosen.select(F.xxhash64("mask", F.col("mask").bitwiseAND(F.col("print"))).alias("block"), "print")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest key reachable over links of at most 4 differing bits,
    the row's own included; equal fingerprints are one node, so copies make no pairs. A null or
    empty text has fingerprint zero and links like any other. Null keys are never the smallest; a
    group of null keys only has a null ``component_id``. Repeated rows fall into one group.
    """
    rows = written(with_fingerprint(docs, key, text))
    prints = rows.groupBy("print").agg(F.min(key).alias("least"))
    links = linked(index_lists(prints.select("print")), "print", _forest_of_list)
    found = groups(links)
    release(links)
    labelled = written(
        prints.join(found, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("group", "print").alias("group"))
    )
    least = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    placed = written(labelled.select("print", "group").join(least, "group").select("print", "component_id"))
    release(found, labelled)
    fingerprint = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return rows.join(placed, "print").select(key, fingerprint, "component_id")
