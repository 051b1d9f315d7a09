"""Packing against plain best fit, and whole contents of the sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parlance.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def one_by_one(counts, room):
    """Sequences of best fit, longest first, one piece at a time: room left of each."""
    left = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [at for at, rest in enumerate(left) if rest >= length]
            if fit:
                left[min(fit, key=lambda at: left[at])] -= length
            else:
                left.append(room - length)
    return sorted(left)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.integers(40, 60))
def test_plan_is_best_fit(counts, room):
    plan = packing.best_fit(counts, room)
    assert len(plan) <= 3 * room * np.log2(room)
    used, ranks = defaultdict(list), Counter()
    for length, first, items, each, sequence, offset in plan:
        assert first == ranks[length]
        ranks[length] += items
        for slot in range(items):
            used[sequence + slot // each].append((offset + slot % each * length, length))
    assert dict(ranks) == counts
    left = []
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        left.append(room - at)
    assert sorted(used) == list(range(len(used)))
    assert sorted(left) == one_by_one(counts, room)


def test_plan_is_bounded_for_many_pieces():
    draw = random.Random(5)
    counts = {length: draw.randrange(1, 10**9) for length in range(1, packing.ROOM + 1)}
    assert len(packing.best_fit(counts)) <= 3 * packing.ROOM * 12
    counts = dict.fromkeys(counts, 10**9)
    plan = packing.best_fit(counts)
    sequences = max(sequence + -(-items // each) for _, _, items, each, sequence, _ in plan)
    assert sequences <= 1.001 * sum(length * n for length, n in counts.items()) / packing.ROOM


TRICKY = ["", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "DON'T İİ ẞ Σ σς", "tab\t\x0b\x0c\r\nx\x1cy z w", "日本語 テキスト", "x" * 9000, "Å é ́x", "..!!?? 12 3.4", "\u0000 a", "Élan éLAN élan, élan,. élan's élan?!'x ÿ Ā ŉ ǆ ǅ İ ſ straße STRASSE ﬁ º ª"]


def test_ids_are_the_tokenizers(tokenizer, documents):
    texts = TRICKY + [row["text"] or "" for row in documents.collect()]
    ids, counts = packing.encoded(pa.array(texts, pa.string()), PATH)
    whole = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert counts.tolist() == [len(one) for one in whole]
    assert ids.tolist() == [i for one in whole for i in one]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" aéÉİß.,'sd<|>*1")), max_size=30), max_size=4))
def test_ids_of_any_text(texts):
    whole = [Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids for text in texts[:1]]
    ids, counts = packing.encoded(pa.array(texts[:1], pa.string()), PATH)
    assert ids.tolist() == [i for one in whole for i in one]


def check(rows, texts, tokenizer, room):
    """Each document's ids are whole, cut only beyond the room, and sequences have no gap."""
    by_key, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        by_key[row["doc_id"]].append(row)
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    expected = defaultdict(list)
    for key, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected[key] += [
            (piece, piece * room, len(ids[piece * room :][:room]), zlib.crc32(np.array(ids[piece * room :][:room], "<u4").tobytes()))
            for piece in range(-(-len(ids) // room))
        ]
    found = {key: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in some) for key, some in by_key.items()}
    assert found == {key: sorted(some) for key, some in expected.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    counts = Counter(row["length"] for row in rows)
    assert len(sequences) == len(one_by_one(counts, room))


def test_query(spark, tokenizer, documents):
    rows = queries.op11_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    check(rows, [(row["doc_id"], row["text"]) for row in documents.collect()], tokenizer, packing.ROOM)


@pytest.mark.parametrize("broadcast", [True, False])
def test_awkward_rows(spark, awkward, tokenizer, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(packing, "fits_broadcast", lambda table: False)
    from pyspark.sql import functions as F

    found = packing.packed(awkward, PATH, room=50)
    rows = found.withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, [(row["doc_id"], row["text"]) for row in awkward.select("doc_id", "text").collect()], tokenizer, 50)


def test_no_rows(spark, nothing):
    assert packing.packed(nothing, PATH).collect() == []


def test_lengths_beyond_the_room_fail(spark):
    with pytest.raises(Exception, match="from 1 to 10"):
        packing.placed(spark.createDataFrame([(11,)], "length long"), 10).collect()
