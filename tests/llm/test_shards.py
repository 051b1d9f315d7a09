import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.llm import shard_tree


def chosen(node, key):
    """Down the tree by the smallest draw, in Python."""
    while node.children:
        def draw(child):
            digits = hashlib.md5(f"{child.label}/{key}".encode()).hexdigest()[:13]
            return -math.log((int(digits, 16) + 0.5) / 16**13) / child.weight

        node = min(node.children, key=draw)
    return node.shard


def check(docs):
    found = shard_tree.sharded(docs)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows, given = found.collect(), docs.collect()
    now, grown = shard_tree.tree([1.0] * 16), shard_tree.tree([1.0] * 17)
    name = lambda key: "" if key is None else str(key)
    expected = [
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), "key", chosen(now, name(r.doc_id)), chosen(grown, name(r.doc_id)))
        for r in given
    ]
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows), key=str) == sorted(expected, key=str)
    for shard, n in Counter(r.shard for r in rows).items():
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(n))
        order = [(r.doc_id is not None, r.doc_id, r.text_crc32, r.size) for r in own]
        assert order == sorted(order, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)


def test_documents(documents):
    check(documents)


def test_awkward(awkward):
    check(awkward)


def test_empty(nothing):
    assert shard_tree.sharded(nothing).collect() == []


def moves(spark, before, after):
    """Of 4000 keys, those whose shard differs between two trees, as (old, new)."""
    key = F.col("id").cast("string")
    rows = spark.range(4000).select(shard_tree.shard_of(before, key).alias("old"), shard_tree.shard_of(after, key).alias("new"))
    return [(r.old, r.new) for r in rows.where("old <> new").collect()]


@pytest.mark.parametrize("shards", [16, 17, 20, 33])
def test_one_more_shard_takes_only(spark, shards):
    moved = moves(spark, shard_tree.tree([1.0] * shards), shard_tree.tree([1.0] * (shards + 1)))
    assert {new for _, new in moved} == {shards}
    assert 0.5 / (shards + 1) < len(moved) / 4000 < 2 / (shards + 1)


def test_changed_weight_moves_only_its_branch(spark):
    """Shard 5 (rack 1, region 0) grows: nothing moves between the shards of an untouched rack or region."""
    heavier = [1.0] * 16
    heavier[5] = 3.0
    moved = moves(spark, shard_tree.tree([1.0] * 16), shard_tree.tree(heavier))
    assert moved
    for old, new in moved:
        assert old // 8 != new // 8 or old // 4 != new // 4 or new == 5
        assert new // 8 == 0 and (old // 8 == 0) <= (new // 4 == 1)


def test_weights_are_met(spark):
    weights = [1.0, 2.0, 3.0, 4.0, 5.0, 1.0]
    key = F.col("id").cast("string")
    counts = spark.range(20_000).groupBy(shard_tree.shard_of(shard_tree.tree(weights), key).alias("s")).count().collect()
    for row in counts:
        assert row["count"] / 20_000 == pytest.approx(weights[row.s] / 16, rel=0.12)
