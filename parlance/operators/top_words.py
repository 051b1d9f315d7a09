"""The most frequent words without a shuffle of the vocabulary, by thresholds in three phases.

Each task counts its own words, which are written down where they are counted. First the largest
counts of each task are added up: their sums are lower bounds, and the last place among them is
a total that any word in the result must reach. Such a word has at least that total's share per task
in some task, so next only counts of at least that share are added up; what a word can have in the
tasks it was not seen in bounds its total from above. Last, the words that can still be in the result
are counted exactly (Cao and Wang, 2004). The rows shuffled depend on how frequent the last
word of the result is, not on how many words there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.joins import fits_broadcast
from parlance.storage import release, written

# Different words that a task holds before it merges their counts with those of earlier batches.
_MERGE_ROWS = 2_000_000


def most_frequent(tokens: DataFrame, max_words: int = 500, min_freq: int = 3, word: str = "word") -> DataFrame:
    """:func:`~parlance.operators.counts.word_cloud` of the counts of ``tokens``: the ``max_words`` most frequent words.

    The same rows, ties going by word, null being a word; fewer if fewer have ``min_freq`` uses.
    """
    if max_words < 1:
        raise ValueError(f"max_words must be at least 1, not {max_words}")
    counts = written(local_counts(tokens, max_words, word))
    tasks = counts.select("part").distinct().count()
    order = [F.desc("n"), word]
    first = counts.where("top").groupBy(word).agg(F.sum("n").alias("n"))
    share = max(1, -(-_last(first, "n", max_words) // max(tasks, 1)))
    # written in the order of counts, so that a scan skips the row groups below the share
    second = written(counts.where(F.col("n") >= share).groupBy(word).agg(F.sum("n").alias("n"), F.count("*").alias("seen")))
    least = max(_last(second, "n", max_words), min_freq)
    most = F.col("n") + (F.lit(tasks) - F.col("seen")) * F.lit(share - 1)
    wanted = written(second.where(most >= least).select(F.col(word).alias("_wanted")))
    same = F.col(word).eqNullSafe(F.col("_wanted"))
    exact = counts.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, same, "left_semi")
    found = exact.groupBy(word).agg(F.sum("n").alias("n")).where(F.col("n") >= min_freq).orderBy(*order).limit(max_words)
    result = written(found)
    release(counts, second, wanted)
    return result.orderBy(*order)


def local_counts(tokens: DataFrame, top: int, word: str = "word") -> DataFrame:
    """Uses of each word within each task, most frequent first: part, word, n, and whether it is among the task's ``top``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            rows += len(found)
            if rows > _MERGE_ROWS:
                held = [_merged(held)]
                rows = len(held[0])
        if not held:
            return
        counts = _merged(held).sort_by([("n", "descending")])
        flags = np.arange(len(counts)) < top
        for start in range(0, len(counts), 100_000):
            some = counts.slice(start, 100_000).combine_chunks()
            arrays = [pa.array(np.full(len(some), part, np.int32)), *[one.combine_chunks() for one in some.columns], pa.array(flags[start : start + len(some)])]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", word, "n", "top"])

    return tokens.select(F.col(word).cast("string").alias(word)).mapInArrow(count, f"part int, `{word}` string, n long, top boolean")


def _merged(tables: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(tables)
    return both.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _last(counts: DataFrame, n: str, place: int) -> int:
    """The count in the given place from the largest down; 0 if there are fewer."""
    largest = counts.orderBy(F.desc(n)).limit(place).agg(F.count("*"), F.min(n)).first()
    return largest[1] if largest[0] == place else 0
