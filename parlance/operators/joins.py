"""Joins that stay whole and balanced when a key is hot or a lookup table is large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.storage import written

# A table is broadcast only when it is counted and measured to be below both bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 1024 * 1024

# A key is hot when it holds more than 1/HOT_KEYS of all rows, so there are at most HOT_KEYS hot keys.
HOT_KEYS = 100_000

# Number of buckets the rows of hot keys are dealt into when they pass through a shuffle they do not need.
DEALS = 100_000


def fits_broadcast(table: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Count and measure ``table``, in one job, against the bounds (or those given)."""
    found = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(_width(table)), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= (BROADCAST_ROWS if rows is None else rows) and found["bytes"] <= (
        BROADCAST_BYTES if size is None else size
    )


def anti_lookup(rows: DataFrame, lookup: DataFrame, *columns: str, word: str = "word") -> DataFrame:
    """Rows whose ``columns`` are all absent from ``lookup[word]``; a null matches a null.

    A lookup of checked size is broadcast, so the rows are not shuffled. A larger one takes a
    shuffle join per column, whose left side adaptive execution splits where a word is hot.
    """
    listed = lookup.select(F.col(word).alias("_listed"))
    if fits_broadcast(listed):
        for column in columns:
            rows = rows.join(F.broadcast(listed), F.col(column).eqNullSafe(F.col("_listed")), "left_anti")
        return rows
    for column in columns:
        rows = rows.join(listed.distinct(), F.col(column).eqNullSafe(F.col("_listed")), "left_anti")
    return rows


def inner_lookup(rows: DataFrame, lookup: DataFrame, word: str = "word") -> DataFrame:
    """Rows whose word is in ``lookup``, with its other columns; ``lookup`` has one row per word."""
    listed = lookup.withColumnRenamed(word, "_listed")
    if fits_broadcast(lookup):
        return rows.join(F.broadcast(listed), F.col(word).eqNullSafe(F.col("_listed"))).drop("_listed")
    listed = listed.withColumn("_hit", F.lit(True))
    return _attach_lookup(rows, listed, word).where("_hit").drop("_hit")


def _attach_lookup(rows: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Left join to a large lookup with unique ``_listed`` words; makes a second pass over ``rows``."""
    counted = rows.groupBy(column).agg(F.count("*").alias("_rows"))
    keyed = counted.join(listed, F.col(column).eqNullSafe(F.col("_listed")), "left").drop("_listed")
    return attach_split(rows, written(keyed), column, "_rows")


def attach(rows: DataFrame, keyed: DataFrame, key: str, weight: str) -> DataFrame:
    """Add the columns of ``keyed`` to ``rows``, whatever share of the rows one key holds.

    ``keyed`` has one row for each string key of ``rows`` (null counts as a key), and ``weight``
    says how many rows have that key; it is not added. If ``keyed`` is of checked size, it is
    broadcast, else see :func:`attach_split`. As it is measured first, pass a written table.
    """
    if not fits_broadcast(keyed):
        return attach_split(rows, keyed, key, weight)
    added = keyed.drop(weight).withColumnRenamed(key, "_key")
    return rows.join(F.broadcast(added), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def attach_split(rows: DataFrame, keyed: DataFrame, key: str, weight: str) -> DataFrame:
    """:func:`attach` for a ``keyed`` of any size.

    Hot keys, of which there are at most ``HOT_KEYS`` because each holds more than that share of
    all rows, and fewer if the rows of ``keyed`` are so wide that they would exceed
    ``BROADCAST_BYTES``, are broadcast; so is null. The other keys meet in an ordinary shuffle join, into
    which rows of hot keys are dealt evenly, as they need nothing from it. They are dealt by all
    their columns, not at random, so that a repeated task deals the same; rows should therefore
    still have a column that tells them apart, such as the message id.
    """
    added = [name for name in keyed.columns if name not in (key, weight)]
    hot = hot_keys(keyed, key, weight).select(F.col(key).alias("_hot_key"), F.struct(*added).alias("_hot"))
    cold = keyed.select(F.col(key).alias("_cold_key"), F.struct(*added).alias("_cold"))
    dealt = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*rows.columns), F.lit(DEALS)).cast("string"))
    meeting = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(dealt)
    both = F.coalesce(F.col("_hot"), F.col("_cold"))
    return (
        rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left")
        .withColumn("_meeting", meeting)
        .join(cold, F.col("_meeting") == F.col("_cold_key"), "left")
        .select(*rows.columns, *[both[name].alias(name) for name in added])
    )


def hot_keys(keyed: DataFrame, key: str, weight: str) -> DataFrame:
    """Keys holding more than a share of the rows, and null, within both bounds of a broadcast.

    The share is 1/HOT_KEYS, or a larger one if that many rows of the mean width would take more
    than ``BROADCAST_BYTES``.
    """
    found = keyed.agg(F.sum(weight).alias("all"), F.avg(_width(keyed)).alias("width")).first()
    most = max(1, min(HOT_KEYS, int(BROADCAST_BYTES / (found["width"] or 1))))
    return keyed.where(F.col(key).isNull() | (F.col(weight) * F.lit(most) > F.lit(found["all"] or 0)))


def _width(table: DataFrame) -> Column:
    """Bytes of a row: text at its length, lists at eight bytes an element, all else at eight."""
    width = F.lit(0)
    for field in table.schema:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + F.lit(16)
        elif isinstance(field.dataType, T.ArrayType):
            width = width + F.coalesce(F.size(field.name), F.lit(0)) * F.lit(8) + F.lit(32)
        else:
            width = width + F.lit(8)
    return width
