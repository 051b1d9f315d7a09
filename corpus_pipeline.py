"""From documents to token ids, stage by stage; each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import fuzzy_lines, languages, mixing, near_texts, pieces
from parlance.llm.tables import table, whole_row
from parlance.storage import Scope, bucketed, release, unscoped, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Tables behind the result of the last stage that was called, by application. A stage gets what the one before
# it wrote, so when it is called nothing reads those of the one before any more.
_behind: dict[str, Scope] = {}


def stage(make: Stage) -> Stage:
    """The stage, holding the tables that its result reads until the next stage is called."""

    @wraps(make)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        if (before := _behind.pop(application, None)) is not None:
            before.release()
        _behind.clear()
        _behind[application] = Scope()
        with _behind[application].open():
            return make(spark, docs, sf_dir)

    return run_stage


@stage
def in_a_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, as no language can be told; the label becomes the predicted one."""
    found = languages.with_language(docs, languages.learn(docs))
    return found.where(F.col("lang") != languages.UNKNOWN_LANGUAGE)


@stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of like lines the first stays; a document that loses all its words goes."""
    return _measured(fuzzy_lines.without_repeats(docs))


@stage
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by the fingerprints of op2, the row with the smallest id stays (null last), whatever ids repeat.

    Rows lie in buckets by a number of their own, so that only numbers are shuffled to find who stays.
    """
    number = F.monotonically_increasing_id().alias("number")
    rows = bucketed(docs.select(number, F.col("doc_id").alias("key"), whole_row(docs)), "number")
    groups = near_texts.near_groups(rows.select("number", F.col("row").getField("text").alias("text")), "number")
    order = F.struct(F.col("key").isNull().alias("last"), "key", "number")
    first = groups.join(rows.select("number", "key"), "number").groupBy("component_id").agg(F.min(order).alias("first"))
    stay = first.select(F.col("first.number").alias("number"))
    return rows.join(stay, "number", "left_semi").select("row.*")


@stage
def at_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target shares of the tokens."""
    return mixing.sampled(docs)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("language", in_a_known_language),
    ("lines", without_repeated_lines),
    ("near copies", one_of_near_copies),
    ("mix", at_target_weights),
    ("pieces", token_ids),
]

# Learned models and fingerprints are beyond SQL; the tests restate the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        # not among the tables of the stage: the next one reads it
        result = function(spark, docs, sf_dir)
        with unscoped():
            kept = written(result)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
