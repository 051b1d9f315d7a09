"""Runs against comparing words at every distance."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import periods, queries


def brute(words, least=periods.LEAST_WORDS):
    """(start, length, period) of every run, by looking at each distance."""
    best = {}
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            start = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            if at - start >= period:
                best.setdefault((start, at + period), period)
            at += 1
    return sorted((start, end - start, period) for (start, end), period in best.items() if end - start >= max(least, 2 * period))


def found_in(texts, least=periods.LEAST_WORDS):
    words = np.array([word for text in texts for word in text], dtype=np.int64)
    found = periods.runs_of(words, np.array([len(text) for text in texts], dtype=np.int64), least)
    result = [[] for _ in texts]
    for text, *run in zip(*(column.tolist() for column in found), strict=True):
        result[text].append(tuple(run))
    return result


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=80), max_size=5), st.sampled_from([1, 4, 12]))
def test_few_different_words(texts, least):
    assert found_in(texts, least) == [brute(text, least) for text in texts]


def test_planted_repeats_and_known_words():
    draw = random.Random(11)
    texts = [[0] * 300, [bin(at).count("1") % 2 for at in range(300)], []]
    one, other = [0], [0, 1]
    while len(other) < 300:
        one, other = other, other + one
    texts.append(other)
    for _ in range(120):
        unit = [draw.randrange(40) for _ in range(draw.randint(1, 60))]
        texts.append([draw.randrange(40) for _ in range(draw.randint(0, 30))] + (unit * draw.randint(1, 7))[: draw.randint(1, 260)] + unit[:3])
    assert found_in(texts) == [brute(text) for text in texts]


def test_wrong_hashes_are_noticed(monkeypatch):
    real, seeds = periods.RunFinder._hashed, []

    def poor(self, draw, values):
        real(self, draw, values)
        seeds.append(len(seeds))
        if len(seeds) == 1:  # first try: all names and sums agree
            self._names[:] = 1
            self._sums = [np.zeros_like(sums) for sums in self._sums]

    monkeypatch.setattr(periods.RunFinder, "_hashed", poor)
    text = [1, 2, 3] * 6 + [4, 5]
    assert found_in([text]) == [brute(text)]
    assert len(seeds) == 2


def expected(key, text):
    words = (text or "").replace("\x0b", " ").replace("\x0c", " ").encode().split()
    if key is not None and words:
        mark = zlib.crc32(str(key).encode())
        if mark % 10 == 0:
            rest, n = mark // 10, len(words)
            a = rest % n
            p = 1 + (n - a) // (3 + rest % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    kept = b" ".join(word for i, word in enumerate(words) if i not in gone)
    lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    top = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (key, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, documents):
    rows = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    docs = [(row["doc_id"], row["text"]) for row in documents.collect()]
    assert any(row["n_runs"] for row in rows)
    assert sorted(map(tuple, rows), key=str) == sorted((expected(*doc) for doc in docs), key=str)


@pytest.mark.parametrize("plant", [False, True])
def test_awkward_rows(spark, awkward, nothing, plant):
    rows = periods.periodic_runs(awkward, plant=plant).collect()
    assert len(rows) == awkward.count()
    by_key = {row["doc_id"]: row for row in rows}
    assert by_key[2]["runs"] == [] and by_key[2]["collapsed"] == "" and by_key[2]["n_words"] == 0
    if not plant:
        assert [tuple(run) for run in by_key[8]["runs"]] == [(0, 20_000, 1)]
        assert by_key[8]["collapsed"] == "word"
    assert periods.periodic_runs(nothing, plant=plant).collect() == []
