"""Links between fingerprints that differ in few bits, and the groups that links make.

Neither step emits the pairs of a group: a block of members passes on a spanning forest of its
links, and groups come from stars that are drawn to ever smaller centres.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.storage import release, written

# Members of a list of candidates that are compared with each other in one block; longer lists make several blocks.
CHUNK = 512
LINKS_PER_TASK = 500_000
FEW_LINKS = 50_000


def spread(prints: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all shuffle partitions: few bytes now, many rows once each is put into its lists."""
    return prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


Link = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


def linked(lists: DataFrame, member: str, link: Link, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that ``link`` finds among the rows of each list; ``lists`` has a long column ``block`` naming the list.

    ``link`` gets a table sorted by ``block`` with whole lists. Lists of up to twice ``chunk`` rows
    are handed over as they come out of the one shuffle. Longer ones only pass through that task,
    batch by batch, and are dealt anew: cut by the hash of the column ``member`` into parts of
    about ``chunk`` rows, each two of which make a block, so that any two rows meet in one block and
    no list, however long, comes into one task.
    """
    schema = ", ".join(["a long", "b long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema)])
    first = written(_by_block(lists).mapInArrow(lambda batches: _short_lists(batches, link, 2 * chunk), schema))
    long = first.where(F.col("block").isNotNull()).select(*lists.columns)
    second = _by_block(_dealt(long, member, chunk)).mapInArrow(lambda batches: _all_lists(batches, link), "a long, b long")
    found = written(first.where(F.col("block").isNull()).select("a", "b").unionByName(second))
    release(first)
    return found


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block")


def _dealt(rows: DataFrame, member: str, chunk: int) -> DataFrame:
    sizes = rows.groupBy("block").agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64(F.col(member)), F.col("_parts")).cast("int")
    meet = F.explode(F.sequence(F.lit(0), F.col("_parts") - F.lit(1)))
    dealt = rows.join(sizes, "block").withColumn("_parts", parts).withColumn("_own", own).withColumn("_other", meet)
    block = F.xxhash64("block", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return dealt.withColumn("block", block).drop("_n", "_parts", "_own", "_other")


def _runs(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted batches cut between lists, and whether a table is part of a list longer than ``most``."""
    held: list[pa.RecordBatch] = []
    long = None
    for batch in batches:
        key = batch.column("block").to_numpy()
        if long is not None and len(key):
            cut = int(np.searchsorted(key, long, side="right"))
            if cut:
                yield pa.Table.from_batches([batch.slice(0, cut)]), True
            batch, key = batch.slice(cut), key[cut:]
        if not len(key):
            continue
        long = None
        if held and held[-1].column("block")[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held), False
            held = []
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]), False
            held = []
        held.append(batch.slice(cut))
        if sum(part.num_rows for part in held) > most:
            yield pa.Table.from_batches(held), True
            held, long = [], int(key[-1])
    if held:
        yield pa.Table.from_batches(held), False


def _short_lists(batches: Iterator[pa.RecordBatch], link: Link, most: int) -> Iterator[pa.RecordBatch]:
    """Links of short lists (the rows' own columns null), and the rows of long ones (the links null)."""
    for rows, long in _runs(batches, most):
        _, at, counts = np.unique(rows.column("block").to_numpy(), return_inverse=True, return_counts=True)
        passed = (counts[at] > most) | long
        for part in rows.filter(pa.array(passed)).to_batches():
            nothing = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, *part.columns], names=["a", "b", *rows.column_names])
        kept = rows.filter(pa.array(~passed & (counts[at] > 1)))
        if kept.num_rows:
            a, b = link(kept)
            own = [pa.nulls(len(a), field.type) for field in rows.schema]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *own], names=["a", "b", *rows.column_names])


def _all_lists(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[pa.RecordBatch]:
    for rows, _ in _runs(batches, np.inf):
        a, b = link(rows)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def close_pairs(
    block: np.ndarray, prints: np.ndarray, near: Callable[[np.ndarray], np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of the same block for whose differing bits ``near`` holds, step by step of j - i."""
    rows = np.arange(len(block))
    for step in range(1, len(block)):
        rows = rows[rows + step < len(block)]
        rows = rows[block[rows] == block[rows + step]]
        if not len(rows):
            return
        close = rows[near(prints[rows] ^ prints[rows + step])]
        yield close, close + step


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its group, and that smallest node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rows = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rows], nodes[label[rows]]


def groups(links: DataFrame) -> DataFrame:
    """(node, group): each linked node with the smallest node it can be reached from.

    ``links`` has columns a and b. Large-star and small-star steps (Kiveris et al., 2014) in turn,
    until nothing changes; no step gathers the links of a node, which are only compared with
    their least.
    """
    edges = written(_in_tasks(_pairs(links.select("a", "b")).distinct(), links.count()))
    mark = _mark(edges)
    while True:
        large = written(_in_tasks(_large_star(edges).distinct(), mark[0]))
        small = written(_in_tasks(_small_star(large).distinct(), mark[0]))
        release(edges, large)
        edges, before = small, mark
        mark = _mark(edges)
        if mark == before:
            found = edges.select(F.col("a").alias("node"), F.col("b").alias("group"))
            found.written_path = edges.written_path
            return found


def _in_tasks(edges: DataFrame, count: int) -> DataFrame:
    """As many tasks, and files, as the number of links asks for: there are far fewer than the shuffles are set up for."""
    cores = edges.sparkSession.sparkContext.defaultParallelism
    return edges.coalesce(max(min(cores, 1 + count // FEW_LINKS), count // LINKS_PER_TASK))


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_least")).select("a", F.least("a", "_least").alias("_least"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("_least"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("_least")).select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return moved.unionByName(least.select("a", F.col("_least").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    checksum: Column = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(checksum)).first())
