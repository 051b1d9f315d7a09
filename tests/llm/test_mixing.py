import math
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from parlance.llm import mixing


def tokens(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_raked_weights_have_the_target_shares():
    draw = np.random.default_rng(0)
    labels = [draw.integers(0, n, 200) for n in (7, 4, 3)]
    targets = [draw.dirichlet(np.full(n, 5.0)) for n in (7, 4, 3)]
    counts = draw.integers(1, 1000, 200).astype(float)
    weights = counts * mixing.rake(counts, labels, targets, keep=0.01)
    assert weights.sum() == pytest.approx(0.01 * counts.sum())
    weights /= weights.sum()
    for of_cell, target in zip(labels, targets):
        assert np.bincount(of_cell, weights) == pytest.approx(target, abs=1e-5)
    # raking changes no interaction: the odds of four cells stay those of the counts
    rates = defaultdict(dict)
    for cell in zip(*labels, weights / counts):
        rates[cell[:2]][cell[2]] = cell[3]
    ratios = {(two[0], two[1]): r for two, r in rates.items() if len(r) == 3}
    first = next(iter(ratios.values()))
    for other in ratios.values():
        assert other[0] / other[1] == pytest.approx(first[0] / first[1], rel=1e-4)


def test_one_kind_is_scaled_by_hand(spark):
    rows = [(i, "w " * (10 if i % 4 else 20), "en", "big" if i % 4 else "small") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = [{"big": 0.5, "small": 0.5}, {"en": 1.0}, {"prose": 1.0}]
    found = mixing.mixed(docs, targets=targets, keep=0.8).collect()
    # 300 * 10 tokens of big and 100 * 20 of small: small is kept whole, big at 2000 / 3000
    assert {(r.source, round(r.probability, 9)) for r in found} == {("small", 1.0), ("big", round(2 / 3, 9))}
    big = [r.kept for r in found if r.source == "big"]
    assert all(r.kept for r in found if r.source == "small") and 0.58 < np.mean(big) < 0.75


def brute_rates(rows, exponent, keep=mixing.KEEP):
    """Natural shares to the power, then raking in dictionaries, rates stopping at 1."""
    cells = defaultdict(float)
    for source, lang, topic, n in rows:
        cells[source, lang, topic] += n
    cells = {c: n for c, n in cells.items() if n}
    total, goals = sum(cells.values()), []
    for at in range(3):
        sums = defaultdict(float)
        for c, n in cells.items():
            sums[c[at]] += n
        raised = {label: (n / total) ** exponent for label, n in sums.items()}
        goals.append({label: r / sum(raised.values()) for label, r in raised.items()})
    rates = dict.fromkeys(cells, keep)
    for _ in range(mixing.ROUNDS):
        before = rates
        for at in range(3):
            sums = defaultdict(float)
            for c, r in rates.items():
                sums[c[at]] += r * cells[c]
            rates = {c: min(1.0, r * keep * total * goals[at][c[at]] / sums[c[at]]) for c, r in rates.items()}
        if max(abs(rates[c] - before[c]) for c in rates) <= mixing.CLOSE:
            break
    return rates


def draw_of(key):
    """Spark's hash of the seed and then the key, whose eight bytes are hashed with the first as seed."""
    first = xxhash.xxh64_intdigest(mixing.SEED.to_bytes(4, "little"), 42)
    value = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), first)
    return (value - (1 << 64) if value >> 63 else value) % (1 << 53) / (1 << 53)


def test_documents_by_brute_force(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    found = mixing.mixed(documents).collect()
    assert len(found) == len(texts) and all(r.tokens == tokens(texts[r.doc_id]) for r in found)
    for r in found:
        topic = next((name for name, pattern in mixing.TOPICS[:-1] if re.search(pattern, texts[r.doc_id])), "prose")
        assert r.topic == topic
    rates = brute_rates([(r.source, r.lang, r.topic, r.tokens) for r in found], mixing.EXPONENT)
    for r in found:
        assert r.probability == pytest.approx(rates[r.source, r.lang, r.topic], abs=1e-5)
        assert r.kept == (draw_of(r.doc_id) < r.probability)
    kept = {r.doc_id for r in mixing.sampled(documents).collect()}
    assert kept == {r.doc_id for r in found if r.kept}
    assert mixing.sampled(documents).columns == documents.columns


@pytest.mark.parametrize("on_driver", [True, False])
def test_many_labels_with_a_long_tail_are_raked_by_name(spark, monkeypatch, on_driver):
    """150 sources of like size, and a hundred of ever fewer tokens: each has the share it is aimed at."""
    if not on_driver:
        monkeypatch.setattr(mixing, "CELLS_ON_DRIVER", 0)
    rows = []
    for at in range(250):
        for part in range(4):
            n = 400 if at < 150 else max(1, 300 // (at - 148))
            rows.append((len(rows), "w " * (n + part), ["en", "de"][(at + part) % 2 if part else 0], f"s{at}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.mixed(docs, keep=0.4).collect()
    rates = brute_rates([(r.source, r.lang, r.topic, r.tokens) for r in found], mixing.EXPONENT, 0.4)
    assert all(r.probability == pytest.approx(rates[r.source, r.lang, r.topic], abs=1e-5) for r in found)
    sums, natural = defaultdict(float), defaultdict(float)
    for r in found:
        sums[r.source] += r.tokens * r.probability
        natural[r.source] += r.tokens
    raised = {source: n**mixing.EXPONENT for source, n in natural.items()}
    goal = {source: 0.4 * sum(natural.values()) * n / sum(raised.values()) for source, n in raised.items()}
    whole = [source for source in goal if goal[source] > natural[source]]
    assert len(set(natural)) == 250 and whole
    # a label is short of its goal only where some cell of it is kept whole; the others share what is left alike
    capped = {r.source for r in found if r.probability > 1 - 1e-5}
    shares = [sums[source] / goal[source] for source in goal if source not in capped]
    assert len(shares) > 150 and min(shares) > 0.99 and max(shares) < 1.1 * min(shares)
    assert all(sums[source] == pytest.approx(natural[source]) for source in whole)


def test_topics_of_the_caller(spark):
    rows = [(at, "w " * 10, "en", "s", "rare" if at % 10 == 0 else "common") for at in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    targets = [{"s": 1.0}, {"en": 1.0}, {"rare": 0.3, "common": 0.7}]
    found = mixing.mixed(docs, targets=targets, keep=0.2, topic=mixing.F.col("subject")).collect()
    assert {(r.topic, round(r.probability, 6)) for r in found} == {("rare", 0.6), ("common", round(0.14 / 0.9, 6))}


def test_awkward(awkward, nothing):
    rows = mixing.mixed(awkward).collect()
    assert len(rows) == awkward.count() and all(0 < r.probability <= 1 for r in rows)
    assert {r.tokens for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert len({r.kept for r in rows if r.doc_id == 3}) == 1
    assert mixing.mixed(nothing).collect() == [] and mixing.sampled(nothing).collect() == []
    assert mixing.sampled(awkward).columns == awkward.columns
    blank = mixing.mixed(awkward.where("doc_id in (2, 3, 4)")).collect()
    assert len(blank) == 4 and all(r.kept and math.isclose(r.probability, 1) for r in blank)
    with pytest.raises(ValueError):
        mixing.mixed(awkward, targets=[{"nowhere": 1.0}, {"en": 1.0}, {"prose": 1.0}])
