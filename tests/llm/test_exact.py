import hashlib
import re

import pytest

from parlance.llm import block_names


def brute(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of rows (doc_id, text)."""
    bodies = [(key, re.sub(r"[\x20\x09-\x0D]+", " ", text or "")) for key, text in rows]
    out = []
    for key, body in bodies:
        keys = [k for k, b in bodies if b == body]
        known = [k for k in keys if k is not None]
        keep = min(known) if known else None
        out.append((key, keep, len(keys), key == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def check(docs, **settings):
    found = block_names.exact_groups(docs, **settings)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(row) for row in found.collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward(awkward):
    check(awkward)


def test_empty(nothing):
    check(nothing)


def test_documents(documents):
    check(documents)


def test_many_rounds(spark):
    """Texts of many short blocks, with the same blocks in other orders and numbers, and cut characters."""
    texts = ["é" * n for n in range(1, 40)] + ["ab" * 20, "ba" * 20, "ab" * 19 + "ba", "ab" * 20, "a b  a", "a  b a", "ab" * 10]
    docs = spark.createDataFrame([(i % 30, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check(docs, block=4)


def test_shared_keys_take_the_next_seed(documents, monkeypatch):
    key, tried = block_names._block_key, []

    def weak(block, seed):
        tried.append(seed)
        first, second = key(block, seed)
        return (first % 3, second % 3) if seed == 0 else (first, second)

    monkeypatch.setattr(block_names, "_block_key", weak)
    check(documents)
    assert max(tried) == 1


def test_no_seed_left(documents, monkeypatch):
    key = block_names._block_key
    monkeypatch.setattr(block_names, "_block_key", lambda block, seed: tuple(h % 2 for h in key(block, seed)))
    with pytest.raises(RuntimeError):
        block_names.exact_groups(documents)
