"""What the physical plans must and must not contain."""

import re

import pytest

from parlance.operators import message_word_counts
from parlance.plans import QUERIES, oracle_queries
from parlance.sources import as_messages

SF = "/root/testdata/sf0.001"


def plan_of(df):
    """The first physical plan, before any stage has run."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Final Plan ==")[0]


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_pair_products(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for operator in ("EvalPython", "InPandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


@pytest.mark.parametrize("name", ["tokens", "tokens_clean", "bigrams", "bigram_counts", "trigram_counts", "word_cloud"])
def test_words_are_found_once(spark, name):
    assert plan_of(QUERIES[name](spark, SF)).count("regexp_extract_all") == 1


@pytest.mark.parametrize("name", ["tokens", "tokens_clean", "bigrams_filtered", "bigrams_united"])
def test_row_level_steps_do_not_shuffle(spark, name):
    exchanges = re.findall(r"Exchange (\w+)", plan_of(QUERIES[name](spark, SF)))
    # the single exchange spreads the one-file input over the cores
    assert [e for e in exchanges if e == "hashpartitioning"] == ["hashpartitioning"]


def test_net_sentiment_takes_one_shuffle_after_the_spreading(spark):
    plan = plan_of(QUERIES["sentiment_by_group_month"](spark, SF))
    keys = re.findall(r"Exchange hashpartitioning\((\w+)", plan)
    # spreading the input, the result, and the few rows of the lexicon
    assert sorted(keys) == ["Group_Name", "Message_ID_int", "word"]
    assert "partial_sum" in plan


def test_counts_per_message_shuffle_no_texts_and_no_words(spark, messages, stops, tmp_path):
    messages.repartition(8).write.parquet(str(tmp_path / "m"))
    plan = plan_of(message_word_counts(as_messages(spark.read.parquet(str(tmp_path / "m"))), stops))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    # the registered query only spreads its one file over the cores
    plan = plan_of(QUERIES["message_word_counts"](spark, SF))
    assert re.findall(r"Exchange hashpartitioning\((\w+)", plan) == ["Message_ID_int"]


def test_group_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["group_sentiment"](spark, SF))
    assert "EqualTo(source,src0)" in plan
    read = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert {column.split(":")[0] for column in read.split(",")} == {"doc_id", "text", "source"}


def test_word_cloud_is_a_bounded_top_list(spark):
    assert "TakeOrderedAndProject(limit=500" in plan_of(QUERIES["word_cloud"](spark, SF))


def test_every_query_has_sql(spark):
    assert set(oracle_queries()) == set(QUERIES)
