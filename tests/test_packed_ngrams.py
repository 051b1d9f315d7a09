"""Packed n-grams: the same counts as by texts, whether all words, some or none are numbered."""

import random
import re

import pytest
from support import rows

from parlance.operators import count, joins, ngram_columns, ngrams, ngrams_without, packed_ngram_counts
from parlance.sources import as_messages, lookup_table


@pytest.fixture(scope="module")
def many(spark):
    draw = random.Random(9)
    texts = [" ".join(f"w{int(draw.paretovariate(0.8)) % 60}" for _ in range(draw.randint(0, 30))) for _ in range(200)]
    texts += [None, "", "the", "the w1", "w1 the w1 the w1", "é ü é"]
    table = [(at, 1, "g", text) for at, text in enumerate(texts)]
    return as_messages(spark.createDataFrame(table, "Message_ID_int long, Month_Index int, Group_Name string, Message_Body string"))


@pytest.fixture(scope="module")
def stop_list(spark):
    return lookup_table(spark, {"word": "string", "lexicon": "string"}, [("the", "x"), ("w3", "x"), (None, "x")])


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("bound", [500_000, 20, 0])
def test_same_counts_as_by_texts(many, stop_list, monkeypatch, n, bound):
    names = ngram_columns(n)
    expected = count(ngrams_without(ngrams(many, n), stop_list, n), *names, sort=True).collect()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    found = packed_ngram_counts(many, stop_list, n, sort=True)
    assert found.columns == [*names, "n"]
    assert found.collect() == expected
    assert rows(packed_ngram_counts(many, stop_list, n)) == sorted(map(tuple, expected))


def test_only_numbers_are_shuffled(many, stop_list):
    plan = packed_ngram_counts(many, stop_list, 2, sort=True)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Exchange (?:hash|range)partitioning\(word\d", plan)
    assert len(re.findall(r"Exchange rangepartitioning\(n#", plan)) == 1 and "SortMergeJoin" not in plan


def test_longer_ones_do_not_fit(many, stop_list):
    with pytest.raises(ValueError, match="1 to 3"):
        packed_ngram_counts(many, stop_list, 4)


@pytest.mark.parametrize("bound", [500_000, 20])
def test_texts_are_split_once(many, stop_list, monkeypatch, bound):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    plan = packed_ngram_counts(many, stop_list, 3, sort=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("Generate") == 1
