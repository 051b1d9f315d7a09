"""Ranks and positions that do not put a whole table or panel into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.storage import written


# Parts that a panel's rows are dealt into before any of them is ranked.
PARTS = 64


def top_n(rows: DataFrame, by: str, weight: str, n: int) -> DataFrame:
    """Rows with ``rank() <= n`` by descending ``weight`` within each value of ``by``, null among them, ties kept.

    The rows of a panel are dealt into ``PARTS`` parts by hash, each of which keeps its ``n`` largest
    weights; the survivors, at most ``PARTS * n`` of a panel however many rows it has, are
    ranked, and the weight of the last place picks every row that ties with it.
    """
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))
    of_part = Window.partitionBy(by, "_part").orderBy(F.desc(weight))
    best = Window.partitionBy(by).orderBy(F.desc(weight))
    survivors = (
        rows.select(by, weight, part.alias("_part"))
        .withColumn("_place", F.row_number().over(of_part))
        .where(F.col("_place") <= n)
    )
    # at most n weights of a panel; a panel with one row of a hot weight passes on n equal ones
    cut = (
        survivors.select(F.col(by).alias("_by"), F.col(weight).alias("_weight"), F.rank().over(best).alias("rank"))
        .where(F.col("rank") <= n)
        .select("_by", "_weight", F.col("rank").cast("long").alias("rank"))
        .distinct()
    )
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col(weight).eqNullSafe(F.col("_weight"))
    return rows.join(cut, same).select(*rows.columns, "rank")


def with_position(rows: DataFrame, *order: Column | str, name: str = "ord", start: int = 1) -> DataFrame:
    """Add the position of each row in a total ``order``, counted from ``start``.

    A range-partitioned sort numbers the rows of each partition; a table of partition sizes
    shifts them. The numbered rows are written down first, so both steps see the same partitions;
    that table can be released with the result.
    """
    local = F.monotonically_increasing_id()
    placed = written(
        rows.orderBy(*order)
        .withColumn("_part", F.shiftright(local, 33))
        .withColumn("_place", local.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    position = F.col("_place") + F.col("_shift") + F.lit(start)
    numbered = placed.join(F.broadcast(shifts), "_part").select(*rows.columns, position.alias(name))
    numbered.written_path = placed.written_path
    return numbered
