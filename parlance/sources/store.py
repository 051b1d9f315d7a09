"""Messages stored by group and month, so that one group's messages are read without the others'."""

from __future__ import annotations

from collections.abc import Sequence
from types import EllipsisType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.sources.messages import MESSAGES

# Longer names would not fit the name of a folder once its signs are escaped.
_LONGEST_NAME = 60

_STORED = T.StructType(
    [*MESSAGES.fields, T.StructField("in_group", T.StringType()), T.StructField("in_month", T.IntegerType())]
)


def store_messages(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the four message columns to ``path``, a folder for each group and month in it.

    Rows are brought together by folder, large folders being split over tasks and small ones merged
    when their sizes are known, so that a hot group is many files and a small one is few. Null and
    empty group names are kept apart; long names stand under their hash.
    """
    keyed = messages.select(*MESSAGES.names, _folder(F.col("Group_Name")).alias("in_group"), F.col("Month_Index").alias("in_month"))
    dealt = keyed.hint("rebalance", F.col("in_group"), F.col("in_month"))
    dealt.write.mode(mode).partitionBy("in_group", "in_month").parquet(path)


def read_stored(
    spark: SparkSession, path: str, group: str | None | EllipsisType = ..., months: Sequence[int] | None = None
) -> DataFrame:
    """Messages of a folder written by :func:`store_messages`; of one group (null is one) or months, if given.

    Only the folders of the group and months are listed and read.
    """
    rows = spark.read.schema(_STORED).parquet(path)
    if group is not ...:
        name = F.lit(group).cast("string")
        rows = rows.where(F.col("in_group") == _folder(name)).where(F.col("Group_Name").eqNullSafe(name))
    if months is not None:
        rows = rows.where(F.col("in_month").isin(*months))
    return rows.select(*MESSAGES.names)


def _folder(name: Column) -> Column:
    own = F.when(F.octet_length(name) <= _LONGEST_NAME, F.concat(F.lit("g-"), name)).otherwise(F.concat(F.lit("h-"), F.md5(name)))
    return F.when(name.isNull(), F.lit("null")).otherwise(own)
