"""Shards chosen by descending a weighted tree of regions, racks and shards.

On each level every child of the node reached so far draws a number from the hash of its label
and the document's key, stretched by its weight, and the best draw wins. A child's draw depends
on nothing but its own label and weight: when weights change, documents move only along changed
branches, into a child that grew or out of one that shrank, and all other subtrees keep theirs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import text_or_empty
from parlance.operators.ranks import with_position
from parlance.storage import release, written

RACK_SHARDS = 4
REGION_RACKS = 2
BASE_SHARDS = 16
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Node:
    """A label that is unique in the tree, a weight above 0, and children, or for a leaf its shard."""

    label: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def tree(weights: Sequence[float], base: int = BASE_SHARDS) -> Node:
    """Shards 0, 1, … with the given weights, in racks of 4 and regions of 2 racks.

    Every shard from ``base`` on opens a region of its own, so that adding shards one at a time
    takes documents only into the new one.
    """
    leaves = [Node(f"shard-{i}", w, shard=i) for i, w in enumerate(weights)]
    racks = _parents("rack", [leaves[i : i + RACK_SHARDS] for i in range(0, min(base, len(leaves)), RACK_SHARDS)])
    regions = _parents("region", [racks[i : i + REGION_RACKS] for i in range(0, len(racks), REGION_RACKS)])
    added = [_parents(f"added-region-{leaf.shard}", _split(_parents(f"added-rack-{leaf.shard}", [[leaf]]))) for leaf in leaves[base:]]
    regions = regions + [region for one in added for region in one]
    return Node("root", sum(region.weight for region in regions), tuple(regions))


def _split(nodes: list[Node]) -> list[list[Node]]:
    return [[node] for node in nodes]


def _parents(kind: str, groups: list[list[Node]]) -> list[Node]:
    return [Node(f"{kind}-{i}", sum(n.weight for n in group), tuple(group)) for i, group in enumerate(groups)]


def draw(label: str, weight: float, key: Column) -> Column:
    """An exponentially distributed draw at rate ``weight``; the smallest wins."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{label}/"), key)), 1, DRAW_DIGITS)
    uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))
    return -F.log(uniform) / F.lit(float(weight))


def shard_of(node: Node, key: Column) -> Column:
    """The shard below ``node`` that ``key`` (a string) draws; only branches taken are evaluated."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return shard_of(node.children[0], key)
    draws = [F.struct(draw(child.label, child.weight, key).alias("at"), F.lit(i).alias("child")) for i, child in enumerate(node.children)]
    best = F.least(*draws)["child"]
    cases = [(best == i, shard_of(child, key)) for i, child in enumerate(node.children[:-1])]
    first, *others = cases
    chain = reduce(lambda c, case: c.when(*case), others, F.when(*first))
    return chain.otherwise(shard_of(node.children[-1], key))


def sharded(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * BASE_SHARDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the key and the weights decide, so rows that repeat a key share a shard;
    a null key is drawn for as the empty string. ``grown_shard`` is the shard with one more shard
    of the mean weight. ``slot`` numbers the rows of a shard from 0 by key (null first), checksum
    and size, from a range-partitioned sort, so no shard is gathered in one task. A null text has
    no bytes: size 1, checksum 0.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    grown = tree([*weights, sum(weights) / len(weights)])
    rows = written(
        docs.select(
            F.col(key).alias(key),
            (F.octet_length(text_or_empty(text)) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text_or_empty(text)).alias("text_crc32"),
            F.lit("key").alias("law"),
            shard_of(tree(weights), name).alias("shard"),
            shard_of(grown, name).alias("grown_shard"),
        )
    )
    placed = with_position(rows, "shard", F.asc_nulls_first(key), "text_crc32", "size", name="_place")
    release(rows)
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        key, "size", "text_crc32", "law", "shard", (F.col("_place") - F.col("_first")).alias("slot"), "grown_shard"
    )


def _sql_case(node: Node) -> str:
    if node.shard is not None:
        return str(node.shard)
    if len(node.children) == 1:
        return _sql_case(node.children[0])
    uniform = "(CAST('0x' || md5('{}/' || k)[1:13] AS BIGINT) + 0.5) / 4503599627370496.0"
    draws = ", ".join(f"-ln({uniform.format(c.label)}) / {float(c.weight)}" for c in node.children)
    cases = " ".join(f"WHEN {i} THEN {_sql_case(child)}" for i, child in enumerate(node.children, 1))
    return f"(CASE list_position([{draws}], least({draws})) {cases} END)"


def oracle_sql(shards: int = BASE_SHARDS) -> str:
    """The same in SQL; the checksum goes byte by byte through the usual table, made by its rule."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    entry = "i"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda c: {step})[1]"
    return f"""
WITH crc AS (SELECT list({entry} ORDER BY i) AS entries FROM range(256) AS r(i)),
rows AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS body,
         hex(encode(coalesce(text, ''))) AS digits
  FROM documents
),
summed AS (
  SELECT doc_id, k, CAST(strlen(body) + 1 AS BIGINT) AS size,
         xor(list_reduce(
           list_prepend(4294967295, list_transform(range(1, strlen(digits), 2), lambda p: CAST('0x' || digits[p:p + 1] AS BIGINT))),
           lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM rows, crc
),
dealt AS (
  SELECT doc_id, size, text_crc32, 'key' AS law, CAST({_sql_case(tree([1.0] * shards))} AS INTEGER) AS shard,
         CAST({_sql_case(tree([1.0] * (shards + 1)))} AS INTEGER) AS grown_shard
  FROM summed
)
SELECT doc_id, size, text_crc32, law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM dealt"""
