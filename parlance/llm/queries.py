"""The operators applied to whole test tables, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (
    alignment,
    block_names,
    fuzzy_lines,
    languages,
    mixing,
    near_texts,
    packing,
    periods,
    pieces,
    private_data,
    quality,
    secrets,
    shard_tree,
    spans,
)
from parlance.llm.tables import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts.near_groups(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judged(docs, rules).select("doc_id", *first, "base_failed", "rule", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("path", "doc_id").select("doc_id", *spans.digest(secrets.RULES))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.personal_data(table(spark, sf_dir, "documents")).select("doc_id", *spans.digest(private_data.RULES))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.sharded(table(spark, sf_dir, "documents"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_report(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_groups(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages.identified(docs, languages.learn(docs))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digest = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.placed(digest)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = alignment.aligned(table(spark, sf_dir, "documents"), *paths)
    return alignment.scored(found, alignment.link_table(found)).withColumnRenamed("key", "doc_id").drop("row")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), plant=True)
    best = F.array_min(F.transform("runs", lambda run: F.struct((-run.length).alias("minus"), run.start.alias("start"), run.period.alias("period"))))
    line = F.transform("runs", lambda run: F.concat(run.start, F.lit(","), run.length, F.lit(","), run.period, F.lit("\n")))
    length = -F.col("best.minus")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        length.alias("length"),
        "best.period",
        F.floor(F.lit(1000) * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    query.__name__: query
    for query in (
        op1_sentencepiece,
        op2_simhash_near_dedup,
        op3_quality_rules,
        op4_secret_scan,
        op5_personal_data,
        op6_source_mix,
        op7_shard_tree,
        op8_fuzzy_lines,
        op9_exact_dedup,
        op10_language_id,
        op11_best_fit_packing,
        op12_token_alignment,
        op13_periodic_runs,
    )
}

ORACLE_SQL = {
    "op4_secret_scan": spans.sql(secrets.RULES),
    "op5_personal_data": spans.sql(private_data.RULES),
    "op7_shard_tree": shard_tree.oracle_sql(),
    "op9_exact_dedup": block_names.ORACLE_SQL,
}
