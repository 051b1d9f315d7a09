"""The driver's tables as inputs of the analyses, and the small lookup tables that go with them.

The texts are invented syllables, so the polarity words are frequent syllables, not English.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources import LEXICONS, as_messages, lookup_table, spread_out

FOCUS_GROUP = "src0"

# "ha" has both polarities on purpose.
BING = [
    *[(word, "positive") for word in ("er", "ing", "ther", "thon", "ble", "ha")],
    *[(word, "negative") for word in ("nd", "re", "orre", "thatin", "th", "ha")],
]
AFINN = [("er", 3), ("ing", 1), ("nd", -2), ("th", -4)]
NRC = [("er", "joy"), ("er", "trust"), ("nd", "fear"), ("ha", "anger"), ("ha", "joy")]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as messages: the source is the group, and twelve months take turns."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = documents.select(
        F.col("doc_id").alias("Message_ID_int"),
        F.expr("CAST((doc_id DIV 20) % 12 + 1 AS INT)").alias("Month_Index"),
        F.col("source").alias("Group_Name"),
        F.col("text").alias("Message_Body"),
    )
    return spread_out(as_messages(named))


def bing(spark: SparkSession) -> DataFrame:
    return lookup_table(spark, LEXICONS["bing"], BING)


def afinn(spark: SparkSession) -> DataFrame:
    return lookup_table(spark, LEXICONS["afinn"], AFINN)


def nrc(spark: SparkSession) -> DataFrame:
    return lookup_table(spark, LEXICONS["nrc"], NRC)


def state(spark: SparkSession, sf_dir: str) -> tuple[str, int, int]:
    """The place of the documents, when they were last written, and their size."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.getFileStatus(place)
    return str(found.getPath()), found.getModificationTime(), system.getContentSummary(place).getLength()
