"""The message table: id, month index, body and group, bound by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("Message_ID_int", T.LongType(), False),
        T.StructField("Month_Index", T.IntegerType()),
        T.StructField("Group_Name", T.StringType()),
        T.StructField("Message_Body", T.StringType()),
    ]
)

# The month column is documented under one name and used under another.
ALIASES = {"Month_ID_int": "Month_Index"}


def as_messages(df: DataFrame) -> DataFrame:
    """Select the four message columns by name, checking that they exist and have the right kind of type.

    A null id fails when it is read. Ids are to be unique; counts per message check that.
    """
    for alias, name in ALIASES.items():
        if alias in df.columns and name not in df.columns:
            df = df.withColumnRenamed(alias, name)
    columns = []
    for field in MESSAGES:
        if field.name not in df.columns:
            raise ValueError(f"message table has no column {field.name}; found {df.columns}")
        found = df.schema[field.name].dataType
        whole_number = isinstance(field.dataType, T.IntegralType) and isinstance(found, T.IntegralType)
        if found != field.dataType and not whole_number:
            raise TypeError(f"{field.name} is {found.simpleString()}, expected {field.dataType.simpleString()}")
        column = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            missing = F.raise_error(F.lit(f"{field.name} must not be null")).cast(field.dataType)
            column = F.coalesce(column, missing)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def read_messages(spark: SparkSession, path: str, format: str = "parquet", multi_line: bool = False) -> DataFrame:
    """Read a message table from Parquet (or another self-describing format) or from CSV with a header.

    CSV columns are bound by the names in the header, which must be the same, in the same order, in
    every file: Spark binds a file's values to its columns by position, so a file with another header
    fails the read. So do values that do not fit their column. ``multi_line`` allows line breaks
    inside quoted bodies, at the price of one task per file.
    """
    if format != "csv":
        return as_messages(spark.read.format(format).load(path))
    reader = spark.read.option("header", True).option("multiLine", multi_line)
    types = {field.name: field.dataType for field in MESSAGES}
    schema = T.StructType(
        [
            T.StructField(name, types.get(ALIASES.get(name, name), T.StringType()))
            for name in reader.csv(path).columns
        ]
    )
    checked = reader.option("mode", "FAILFAST").option("escape", '"').option("enforceSchema", False)
    return as_messages(checked.schema(schema).csv(path))


def spread_out(messages: DataFrame) -> DataFrame:
    """Use every core on a small input of few files: tokenising works inside the scan's partitions.

    Only an input that makes fewer splits than there are cores is dealt out, by id. A plan on anything
    but files, or one that shuffles already, is left alone. Smaller
    ``spark.sql.files.maxPartitionBytes`` is the way for a large input of splittable files.
    """
    cores = messages.sparkSession.sparkContext.defaultParallelism
    plan = messages.select("*")._jdf.queryExecution()
    of_files = plan.optimizedPlan().collectLeaves().head().nodeName() == "LogicalRelation"
    if not of_files or "Adaptive" in plan.executedPlan().nodeName() or plan.toRdd().getNumPartitions() >= cores:
        return messages
    return messages.repartition(cores, "Message_ID_int")
