import re

import pytest
from support import rows

from parlance.operators import (
    count,
    frequent_words,
    in_group,
    inner_lookup,
    labelled,
    lexicon_use,
    message_sentiment,
    net_sentiment,
    score_sums,
    sentiment_counts,
    sentiment_top_terms,
    spread,
    spread_sentiment,
    tokens,
    top_n,
    with_position,
    without_stop_words,
    word_cloud,
    word_sentiment,
)


@pytest.fixture(scope="module")
def raw(messages):
    return tokens(messages)


@pytest.fixture(scope="module")
def clean(raw, stops):
    return without_stop_words(raw, stops).cache()


def test_stop_words_keep_the_null_word(raw, stops, custom, either_join):
    kept = without_stop_words(raw, stops)
    assert kept.columns == raw.columns
    assert kept.count() == 14
    assert kept.where("word IS NULL").count() == 1
    # "https" and "www.yammer.com" go too, and the listed null matches the null word
    assert without_stop_words(raw, custom).count() == 11


def test_word_counts(clean):
    counts = count(clean, "word", sort=True)
    assert [tuple(row) for row in counts.collect()[:2]] == [("work", 4), ("good", 3)]
    assert {row["word"]: row["n"] for row in counts.collect()} == {
        "work": 4, "good": 3, "here": 1, "can't": 1, "bad": 1, "https": 1, "www.yammer.com": 1, "envious": 1, None: 1,
    }


def test_frequent_words_are_above_the_threshold_and_ordered(clean):
    counts = count(clean, "word")
    assert rows(frequent_words(counts, 1)) == [("good", 3, 1), ("work", 4, 2)]
    assert rows(frequent_words(counts, 3)) == [("work", 4, 1)]
    assert rows(frequent_words(counts)) == []


def test_word_cloud(spark):
    counts = spark.createDataFrame([("d", 3), ("a", 5), ("c", 4), ("b", 4), ("e", 2)], "word string, n long")
    assert [tuple(r) for r in word_cloud(counts, 2).collect()] == [("a", 5), ("b", 4)]
    assert [r["word"] for r in word_cloud(counts).collect()] == ["a", "b", "c", "d"]
    assert word_cloud(counts, min_freq=0).count() == 5


def test_net_sentiment(clean, bing, either_join):
    found = net_sentiment(clean, bing)
    assert found.columns == ["Group_Name", "index", "negative", "positive", "sentiment"]
    assert rows(found) == [("A", 1, 1, 2, 1), ("A", 2, 0, 1, 1), ("B", 2, 1, 1, 0)]


def test_spread_of_counts_is_the_net_sentiment(clean, bing):
    long = sentiment_counts(clean, bing)
    assert rows(long) == [
        ("A", 1, "negative", 1), ("A", 1, "positive", 2), ("A", 2, "positive", 1),
        ("B", 2, "negative", 1), ("B", 2, "positive", 1),
    ]
    wide = spread(long, "sentiment", "n", ["negative", "positive"])
    assert rows(wide) == rows(net_sentiment(clean, bing).drop("sentiment"))


def test_group_word_sentiment(clean, bing, either_join):
    one = word_sentiment(in_group(clean, "A"), bing)
    assert [tuple(row) for row in one.collect()] == [("good", "positive", 3), ("bad", "negative", 1)]
    other = word_sentiment(in_group(clean, "B"), bing)
    assert in_group(clean).count() == 0
    assert rows(other) == [("envious", "negative", 1), ("envious", "positive", 1)]


def test_every_label_counts(spark, clean, either_join):
    """Labels beyond the two polarities, a null label and a label listed twice."""
    entries = [("good", "positive")] * 2 + [("good", "joy"), ("bad", None), (None, "joy")]
    lexicon = spark.createDataFrame(entries, "word string, sentiment string")
    assert rows(word_sentiment(clean, lexicon)) == [
        (None, "joy", 1), ("bad", None, 1), ("good", "joy", 3), ("good", "positive", 6),
    ]
    assert rows(sentiment_counts(clean, lexicon)) == [
        ("A", 1, None, 1), ("A", 1, "joy", 2), ("A", 1, "positive", 4), ("A", 2, "joy", 1), ("A", 2, "positive", 2),
        ("B", 2, "joy", 1),
    ]
    assert labelled(clean, lexicon).columns == [*clean.columns, "sentiment"]


def test_wide_tables_refuse_labels_they_have_no_column_for(spark, clean, bing):
    for label in ("joy", None):
        lexicon = bing.union(spark.createDataFrame([("good", label)], "word string, sentiment string"))
        with pytest.raises(Exception, match="must be among"):
            net_sentiment(clean, lexicon).collect()
        with pytest.raises(Exception, match="must be among"):
            spread_sentiment(sentiment_counts(clean, lexicon)).collect()


def test_scores(spark, clean, bing, either_join):
    assert rows(message_sentiment(clean, bing)) == [(2, 1, 2, 1), (3, 0, 1, 1), (5, 1, 1, 0)]
    afinn = spark.createDataFrame([("good", 3), ("bad", -3), ("work", 1), ("work", 1)], "word string, value int")
    assert rows(score_sums(clean, afinn)) == [("A", 1, 7, 5), ("A", 2, 3, 1), ("B", 1, 2, 1), ("B", 2, 2, 1)]


def test_top_terms_keep_ties(spark):
    counts = [("a", "positive", 5), ("b", "positive", 4), ("c", "positive", 4), ("d", "positive", 3), ("a", "negative", 1)]
    df = spark.createDataFrame(counts, "word string, sentiment string, n long")
    found = sentiment_top_terms(df, 2)
    assert found.columns == ["word", "sentiment", "n", "rank", "ord"]
    # mean counts: a (5 + 1) / 2 = 3, b and c 4
    assert rows(found) == [
        ("a", "negative", 1, 1, 1), ("a", "positive", 5, 1, 1), ("b", "positive", 4, 2, 2), ("c", "positive", 4, 2, 3),
    ]


@pytest.mark.parametrize("n", [1, 40, 5000])
def test_top_n_matches_rank(spark, n):
    data = [(None if i % 3 == 2 else i % 3, (i * 7919) % 23, i) for i in range(2000)]
    df = spark.createDataFrame(data, "g int, w int, i int").repartition(5)
    expected = []
    for g, w, i in data:
        rank = 1 + sum(1 for h, v, _ in data if h == g and v > w)
        if rank <= n:
            expected.append((g, w, i, rank))
    assert rows(top_n(df, "g", "w", n)) == sorted(expected, key=lambda row: [(v is not None, v) for v in row])


def test_top_n_ranks_parts_before_panels(spark):
    df = spark.range(100).selectExpr("id % 2 AS g", "id AS w")
    for n in (15, 5000):
        plan = top_n(df, "g", "w", n)._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"row_number\(\) windowspecdefinition\(g#\d+L, _part#", plan)


def test_positions_are_a_total_order(spark):
    df = spark.range(1000).selectExpr("id", "(id * 389) % 1000 AS v").repartition(7)
    found = with_position(df, "v", name="at", start=0)
    assert all(row["v"] == row["at"] for row in found.collect())
    assert found.count() == 1000


def test_lexicon_use(raw, bing, custom, either_join):
    assert rows(lexicon_use(raw, bing)) == [
        ("bad", "negative", 1), ("envious", "negative", 1), ("envious", "positive", 1), ("good", "positive", 3),
    ]
    used = lexicon_use(raw, custom)
    assert used.count() == 15
    assert rows(used.where("n > 0")) == [
        (None, "custom", 1), ("https", "custom", 1), ("i", "test", 2), ("see", "test", 1), ("the", "test", 1),
        ("www.yammer.com", "custom", 1),
    ]


def test_lexicon_use_counts_hot_words_before_they_meet(spark):
    df = spark.range(20_000).selectExpr("id", "if(id % 10 = 0, concat('w', id), 'hot') AS word")
    lexicon = spark.createDataFrame([("hot", "x"), ("w10", "x"), ("none", "x")], "word string, lexicon string")
    used = lexicon_use(df, lexicon)
    assert rows(used) == [("hot", "x", 18_000), ("none", "x", 0), ("w10", "x", 1)]
    assert "partial_count" in used._jdf.queryExecution().executedPlan().toString()


def test_inner_lookup_keeps_every_row_of_a_hot_word(spark, either_join):
    words = ["hot"] * 5000 + [f"w{i % 700}" for i in range(2500)] + [None] * 800
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string").repartition(6)
    lookup = spark.createDataFrame([("hot", 1), ("w3", 2), ("w699", 3), (None, 4), ("zz", 5)], "word string, v int")
    value = {"hot": 1, "w3": 2, "w699": 3, None: 4}
    expected = [(i, word, value[word]) for i, word in enumerate(words) if word in value]
    assert rows(inner_lookup(df, lookup).select("id", "word", "v")) == sorted(expected, key=lambda r: r[0])
