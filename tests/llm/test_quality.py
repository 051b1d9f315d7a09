import re
from collections import Counter

import numpy as np

from parlance.llm import quality, queries

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), doubled, len(repeated), failed


def first_columns(rows):
    return sorted(
        ((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows.collect()), key=str
    )


def test_counts(documents, awkward, nothing):
    for docs in (documents, awkward):
        found = first_columns(quality.judged(docs, []))
        assert found == sorted(((r.doc_id, brute(r.text)) for r in docs.collect()), key=str)
    assert quality.judged(nothing, []).collect() == []
    text = "a b c a b c d e a b\n\x0b\n a b c \n a b c \nx" + " y z"
    assert quality.counts_of(text)[:5] == brute(text)[:5]


def test_learned_list_covers_what_made_the_labels():
    draw = np.random.default_rng(0)
    values = {"a": draw.random(3000), "b": draw.random(3000), "c": draw.random(3000)}
    bad = ((values["a"] > 0.8) & (values["b"] <= 0.5)) | (values["c"] > 0.95)
    rules = quality.learn_rules(values, bad)
    found = np.zeros(3000, dtype=bool)
    for rule in rules:
        found |= quality.covered(rule, values)
    assert found[bad].mean() > 0.9 and found[~bad].mean() < 0.03
    assert {condition.feature for condition in rules[0]} <= {"a", "b", "c"} and str(rules[0][0])


def test_no_rules_from_noise_or_nothing(documents, spark):
    draw = np.random.default_rng(1)
    assert quality.learn_rules({"a": draw.random(900)}, draw.random(900) < 0.3) == []
    assert quality.learn_rules({"a": np.empty(0)}, np.empty(0, dtype=bool)) == []
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality long")
    assert quality.learn(documents, labels) == []
    assert quality.learn(documents, labels.where("false")) == []


def test_rules_as_expressions_agree_with_arrays(spark):
    rules = [(quality.Condition("words", True, 60.0), quality.Condition("digits", False, 0.1)), (quality.Condition("words", False, 55.0),)]
    rows = [(i, "w " * (50 + i) + "1" * (i % 40)) for i in range(40)]
    found = quality.judged(spark.createDataFrame(rows, "doc_id long, text string"), rules).collect()
    for r in found:
        expected = 1 if r.n_words > 60 and r.n_digits / max(r.word_chars, 1) <= 0.1 else 2 if r.n_words <= 55 else None
        assert r.rule == expected and r.kept == (not r.base_failed and expected is None)


def test_query_on_labelled_documents(spark):
    found = queries.op3_quality_rules(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert first_columns(found) == sorted(((r.doc_id, brute(r.text)) for r in docs.collect()), key=str)
    judged = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, bad = ([r.kept for r in judged if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
