"""Lookup tables: sentiment lexicons and stop words."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the three lexicons.
LEXICONS = {
    "afinn": {"word": "string", "value": "int"},
    "bing": {"word": "string", "sentiment": "string"},
    "nrc": {"word": "string", "sentiment": "string"},
}

# The custom stop words; the missing word removes tokens of empty cells.
CUSTOM_WORDS = [
    "user", "cloud", "nice", "ha", "tag", None, "www.yammer.com", "cognizant.com", "https", "3", "6", "101",
]

STOP_WORDS = {"word": "string", "lexicon": "string"}


def read_lexicon(spark: SparkSession, path: str, name: str, format: str = "parquet") -> DataFrame:
    """Read one of the lexicons; a word may have several rows and keeps them all."""
    if name not in LEXICONS:
        raise ValueError(f"unknown lexicon {name}; known: {sorted(LEXICONS)}")
    reader = spark.read.format(format)
    df = (reader.option("header", True) if format == "csv" else reader).load(path)
    return _select(df, LEXICONS[name], name)


def stop_words(spark: SparkSession, path: str | None = None, format: str = "parquet") -> DataFrame:
    """The stop-word list at ``path``, or the short English list that comes with Spark."""
    if path is None:
        words = StopWordsRemover.loadDefaultStopWords("english")
        return lookup_table(spark, STOP_WORDS, [(word, "spark") for word in words])
    reader = spark.read.format(format)
    df = (reader.option("header", True) if format == "csv" else reader).load(path)
    return _select(df, STOP_WORDS, "stop words")


def custom_stop_words(
    spark: SparkSession, base: DataFrame, words: Iterable[str | None] = tuple(CUSTOM_WORDS), lexicon: str = "custom"
) -> DataFrame:
    """``words`` put in front of the ``base`` stop words."""
    return bind_rows(lookup_table(spark, STOP_WORDS, [(word, lexicon) for word in words]), base)


def bind_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Append rows, matching columns by name, keeping duplicates; a missing column is filled with nulls."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def lookup_table(spark: SparkSession, columns: dict[str, str], rows: Iterable[tuple]) -> DataFrame:
    """A small table given in the program, kept in the plan itself."""
    kinds = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in columns.items()])
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(columns, row)) for row in rows], schema=schema))


def _select(df: DataFrame, columns: dict[str, str], what: str) -> DataFrame:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"{what}: no column {', '.join(missing)}; found {df.columns}")
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns.items()])
