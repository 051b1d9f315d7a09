import pytest
from support import rows
from pyspark.sql import functions as F

from parlance.operators import (
    TopicModel,
    beta,
    document_term_matrix,
    fit_topics,
    gamma,
    message_word_counts,
    topic_assignment,
    topic_group_check,
    topic_purity,
    topic_top_terms,
    vocabulary,
)


@pytest.fixture(scope="module")
def counts(messages, stops):
    return message_word_counts(messages, stops).cache()


@pytest.fixture(scope="module")
def two_subjects(spark):
    """Messages of two subjects with no word in common; the subject is the group."""
    subjects = {"sea": "ship sail wave harbour tide".split(), "farm": "cow field plough barn hay".split()}
    found = []
    for i in range(60):
        group = "sea" if i % 2 else "farm"
        words = subjects[group]
        for j in range(4):
            found.append((group, i, words[(i + j * (1 + i % 3)) % 5], 1 + (i + j) % 3))
    merged = {}
    for group, i, word, n in found:
        merged[group, i, word] = merged.get((group, i, word), 0) + n
    table = [(g, i, w, n) for (g, i, w), n in merged.items()]
    return spark.createDataFrame(table, "Group_Name string, Message_ID_int long, word string, n long").cache()


@pytest.fixture(scope="module")
def fitted(two_subjects):
    return fit_topics(two_subjects, k=2, max_iter=30, alpha=1.5)


def test_message_word_counts(counts):
    assert counts.columns == ["Group_Name", "Message_ID_int", "word", "n"]
    assert counts.count() == 12
    assert rows(counts.where("word IS NULL")) == [("B", 6, None, 1)]


def test_vocabulary_is_sorted_and_dense(counts):
    found = vocabulary(counts).orderBy("term_index").collect()
    assert [r["word"] for r in found] == sorted(r["word"] for r in found)
    assert [r["term_index"] for r in found] == list(range(1, 9))


def test_document_term_matrix(counts, either_join):
    cells = document_term_matrix(counts)
    assert cells.columns == ["Message_ID_int", "term_index", "n"]
    assert cells.count() == 11
    assert {r["Message_ID_int"] for r in cells.collect()} == {1, 2, 3, 4, 5}


def test_shares_sum_to_one(fitted, two_subjects):
    per_topic = beta(fitted).groupBy("topic").agg(F.count("*"), F.round(F.sum("beta"), 9))
    assert rows(per_topic) == [(1, 10, 1.0), (2, 10, 1.0)]
    per_message = gamma(fitted).groupBy("Message_ID_int").agg(F.count("*"), F.round(F.sum("gamma"), 9))
    assert rows(per_message) == [(i, 2, 1.0) for i in range(60)]


def test_two_subjects_are_told_apart(fitted):
    checked = topic_group_check(fitted)
    assert checked.columns == ["topic", "Group_Name", "n"]
    assert sorted(r["n"] for r in checked.collect()) == [30, 30]
    assert {(r["n"], r["share"]) for r in topic_purity(checked).collect()} == {(30, 1.0)}
    assert topic_assignment(fitted).count() == 60
    top = topic_top_terms(fitted, 5).collect()
    assert {frozenset(r["term"] for r in top if r["topic"] == t) for t in (1, 2)} == {
        frozenset("ship sail wave harbour tide".split()),
        frozenset("cow field plough barn hay".split()),
    }


def shares(model):
    """All numbers of a model, exactly."""
    terms = {(r["term"], r["topic"]): r["beta"] for r in beta(model).collect()}
    return terms, {(r["Message_ID_int"], r["topic"]): r["gamma"] for r in gamma(model).collect()}


def test_split_keys_and_other_partitions_change_no_digit(two_subjects, no_broadcast, monkeypatch):
    split = shares(fit_topics(two_subjects.repartition(7), k=3, max_iter=3))
    monkeypatch.undo()
    assert split == shares(fit_topics(two_subjects.coalesce(1), k=3, max_iter=3))


def test_message_keys_survive_the_joins(spark):
    table = [("A", 7, "x", 2), (None, 8, "x", 1), ("", 9, "y", 1), ("a\u0000b", 10, "y", 3), (None, 11, None, 1)]
    counts = spark.createDataFrame(table, "Group_Name string, Message_ID_int long, word string, n long")
    found = fit_topics(counts, k=3, max_iter=3).messages.select("Message_ID_int", "Group_Name").collect()
    assert {(r["Group_Name"], r["Message_ID_int"]) for r in found} == {("A", 7), (None, 8), ("", 9), ("a\u0000b", 10)}


def test_settings_reach_the_fit(two_subjects):
    base = shares(fit_topics(two_subjects, k=2, max_iter=2))
    for settings in ({"alpha": 30.0}, {"eta": 2.0}, {"seed": 5}, {"max_iter": 3}):
        assert shares(fit_topics(two_subjects, **{"k": 2, "max_iter": 2, **settings})) != base
    for settings in ({"alpha": 1.0}, {"eta": 0.5}):
        with pytest.raises(ValueError, match="must exceed 1"):
            fit_topics(two_subjects, k=2, **settings)


def test_a_tolerance_ends_the_fit(two_subjects):
    # with so wide a tolerance the second round ends it
    assert shares(fit_topics(two_subjects, k=2, max_iter=9, tolerance=1.0)) == shares(fit_topics(two_subjects, k=2, max_iter=2))
    assert shares(fit_topics(two_subjects, k=2, max_iter=3, tolerance=0.0)) == shares(fit_topics(two_subjects, k=2, max_iter=3))


def test_repeated_ids_fail(messages, stops):
    with pytest.raises(ValueError, match="unique"):
        message_word_counts(messages.unionByName(messages), stops)


def test_no_words_no_topics(spark):
    empty = spark.createDataFrame([("A", 1, None, 1)], "Group_Name string, Message_ID_int long, word string, n long")
    with pytest.raises(ValueError, match="no message has a word"):
        fit_topics(empty)


def test_same_settings_same_digits(two_subjects):
    assert shares(fit_topics(two_subjects, k=3, max_iter=5)) == shares(fit_topics(two_subjects, k=3, max_iter=5))


def test_top_terms_keep_ties_and_are_placed_per_topic(spark):
    terms = spark.createDataFrame(
        [("a", [0.4, 0.1]), ("b", [0.2, 0.1]), ("c", [0.2, 0.5]), ("d", [0.2, 0.3])], "term string, weights array<double>"
    )
    found = topic_top_terms(TopicModel(2, terms, terms), 2)
    assert [tuple(r) for r in found.collect()] == [
        (1, "1", "a", 0.4, 1, 4), (1, "1", "b", 0.2, 2, 1), (1, "1", "c", 0.2, 2, 2), (1, "1", "d", 0.2, 2, 3),
        (2, "2", "c", 0.5, 1, 2), (2, "2", "d", 0.3, 2, 1),
    ]


def test_lowest_topic_wins_a_tie(spark):
    mixed = spark.createDataFrame(
        [(1, "A", [0.4, 0.4, 0.2]), (2, "A", [0.1, 0.2, 0.7]), (3, "B", [0.3, 0.4, 0.3])],
        "Message_ID_int long, Group_Name string, weights array<double>",
    )
    model = TopicModel(3, mixed, mixed)
    assert rows(topic_assignment(model)) == [(1, 1, 0.4), (2, 3, 0.7), (3, 2, 0.4)]
    assert rows(topic_group_check(model)) == [(1, "A", 1), (2, "B", 1), (3, "A", 1)]
