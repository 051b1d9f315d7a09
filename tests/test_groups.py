import math
import random
from collections import Counter

import pytest
from support import rows
from pyspark.sql import functions as F

from parlance.operators import (
    attach,
    attach_split,
    bind_tf_idf,
    count,
    group_totals,
    group_words,
    ngrams,
    ngrams_without,
    tokens,
    unite,
    without_stop_words,
)
from parlance.operators import joins
from parlance.operators.joins import hot_keys


@pytest.fixture(scope="module")
def counts(messages):
    return count(tokens(messages), "Group_Name", "word").cache()


def test_group_totals_count_everything(counts):
    assert rows(group_totals(counts)) == [("A", 13), ("B", 5)]


def test_group_words_keep_the_earlier_total(counts, custom, either_join):
    found = group_words(counts, custom)
    assert found.columns == ["Group_Name", "word", "n", "total"]
    assert rows(found) == [
        ("A", "bad", 1, 13), ("A", "can't", 1, 13), ("A", "good", 3, 13), ("A", "here", 1, 13), ("A", "work", 2, 13),
        ("B", "envious", 1, 5), ("B", "work", 2, 5),
    ]


def test_tf_idf(messages, custom, either_join):
    kept = count(without_stop_words(tokens(messages), custom), "Group_Name", "word")
    found = {(r["Group_Name"], r["word"]): round(r["tf_idf"], 6) for r in bind_tf_idf(kept).collect()}
    assert found == {
        ("A", "good"): 0.259930, ("A", "here"): 0.086643, ("A", "can't"): 0.086643, ("A", "bad"): 0.086643,
        ("A", "work"): 0.0, ("B", "envious"): 0.231049, ("B", "work"): 0.0,
    }
    assert [r["word"] for r in bind_tf_idf(kept).collect()][:2] == ["good", "envious"]
    sums = bind_tf_idf(kept).groupBy("Group_Name").agg(F.round(F.sum("tf"), 12))
    assert rows(sums) == [("A", 1.0), ("B", 1.0)]


def test_tf_idf_with_null_and_skewed_groups_matches_brute_force(spark, either_join):
    draw = random.Random(5)
    table = {}
    for i in range(3000):
        group = "big" if i % 3 == 0 else None if i % 3 == 1 and i % 2 else f"g{i % 400}"
        word = "hot" if draw.random() < 0.2 else None if draw.random() < 0.1 else f"w{draw.randrange(300)}"
        table[group, word] = draw.randrange(1, 9)
    df = spark.createDataFrame([(g, w, n) for (g, w), n in table.items()], "Group_Name string, word string, n long")
    totals, spread_of = Counter(), Counter()
    for (group, word), n in table.items():
        totals[group] += n
        spread_of[word] += 1
    found = bind_tf_idf(df.repartition(5), sort=False).collect()
    assert len(found) == len(table)
    for row in found:
        tf = table[row["Group_Name"], row["word"]] / totals[row["Group_Name"]]
        idf = math.log(len(totals) / spread_of[row["word"]])
        assert (row["tf"], row["idf"], row["tf_idf"]) == pytest.approx((tf, idf, tf * idf), abs=1e-12)


def test_attach_split_sends_hot_keys_by_broadcast_and_the_rest_by_shuffle(spark, no_broadcast):
    keys = ["a"] * 900 + ["b"] * 700 + [None] * 30 + [f"k{i % 200}" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(keys)), "id long, k string").repartition(5)
    keyed = df.groupBy("k").agg(F.count("*").alias("m")).withColumn("value", F.concat(F.lit("v"), F.coalesce("k", F.lit("-"))))
    assert {row["k"] for row in hot_keys(keyed, "k", "m").collect()} == {"a", "b", None}
    expected = [(i, k, "v" + (k or "-")) for i, k in enumerate(keys)]
    assert [tuple(r) for r in attach_split(df, keyed, "k", "m").orderBy("id").collect()] == expected
    assert [tuple(r) for r in attach(df, keyed, "k", "m").orderBy("id").collect()] == expected


def test_wide_rows_allow_fewer_hot_keys(spark, monkeypatch):
    """The broadcast of hot keys is bounded by bytes, however wide the attached rows are."""
    df = spark.range(1000).selectExpr("concat('k', id % 100) AS k").groupBy("k").agg(F.count("*").alias("m"))
    assert hot_keys(df, "k", "m").count() == 100
    wide = df.withColumn("w", F.array_repeat(F.lit(1.0), 1000))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 400_000)
    assert hot_keys(wide, "k", "m").count() == 0 and hot_keys(df, "k", "m").count() == 100


def test_attach_keeps_rows_without_a_key_in_both_forms(spark, either_join):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, k string")
    keyed = spark.createDataFrame([("a", 1, 5)], "k string, m int, v int")
    assert rows(attach(df, keyed, "k", "m")) == [(1, "a", 5), (2, "b", None), (3, None, None)]


def test_rows_of_a_hot_key_are_spread_over_the_tasks(spark, no_broadcast):
    df = spark.range(40_000).select("id", F.lit("hot").alias("k"))
    df = df.union(spark.range(100).selectExpr("id + 50000", "concat('k', id)"))
    keyed = df.groupBy("k").agg(F.count("*").alias("m"), F.lit(1).alias("v"))
    plan_off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in plan_off}
    try:
        for key, value in plan_off.items():
            spark.conf.set(key, value)
        sizes = [r["count"] for r in attach_split(df, keyed, "k", "m").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 40_100
    assert max(sizes) < 1.2 * 40_100 / spark.sparkContext.defaultParallelism


def test_bigram_counts_filter_after_pairing(messages, stops, either_join):
    kept = ngrams_without(ngrams(messages, 2), stops, 2)
    assert rows(count(kept, "word1", "word2")) == [
        ("can't", "work", 1), ("envious", "work", 1), ("good", "bad", 1), ("good", "good", 1),
        ("https", "www.yammer.com", 1), ("work", "here", 1), ("www.yammer.com", "good", 1),
    ]
    assert ("here can't",) not in rows(unite(kept, "bigram", ["word1", "word2"]).select("bigram"))


def test_trigram_counts(messages, custom, either_join):
    kept = ngrams_without(ngrams(messages, 3), custom, 3)
    assert rows(count(kept, "word1", "word2", "word3")) == [("good", "good", "bad", 1)]


def test_null_ngrams_follow_the_list(messages, stops, custom, either_join):
    pairs = ngrams(messages, 2, short="null")
    assert ngrams_without(pairs, stops, 2).where("word1 IS NULL").count() == 3
    assert ngrams_without(pairs, custom, 2).where("word1 IS NULL").count() == 0
