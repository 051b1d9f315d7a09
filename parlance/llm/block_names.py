"""Exact duplicates by deterministic naming of blocks (Karp, Miller and Rosenberg).

A text is cut into blocks of a fixed number of bytes. The different blocks of the corpus are
sorted and numbered; then neighbouring names are paired, the different pairs sorted and numbered,
and so on, until each text has one name. Two texts have the same name after the same number of
rounds exactly if they are the same text.

Block contents are shuffled once, and only to prove that two different blocks never share the
128-bit key they are sorted by; were there such a pair, the next seed would be taken. All later
steps move numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import WHITE, text_or_empty
from parlance.operators.ranks import with_position
from parlance.storage import release, written

BLOCK_BYTES = 4096
SEEDS = 8


def normalised(text: str = "text") -> Column:
    """The text with every run of white space made one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), WHITE, " ")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal if their :func:`normalised` forms are; a null text equals an empty one. Of
    equal texts the smallest key is ``keep_id`` and stays. A null key never stays beside a key
    that is not null; in a group of null keys only, ``keep_id`` is null and all rows stay. Rows
    that repeat key and text are kept or dropped alike. An empty table gives an empty table.
    """
    bodies = docs.select(F.col(key).alias(key), normalised(text).cast("binary").alias("body"))
    rows, names = _first_names(bodies, key, block)
    ids = _identities(rows, names)
    named = written(rows.select("row", key, "text_sha256").join(ids, "row"))
    release(rows, names, ids)
    # written, so that the join has plain exchanges on both sides and a hot name can be split
    groups = written(named.groupBy("level", "name").agg(F.min(key).alias("keep_id"), F.count("*").alias("group_size")))
    return named.join(groups, ["level", "name"]).select(
        key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _block_key(block: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def _blocks(block: int) -> Column:
    """The body in blocks; an empty body is one empty block."""
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length("body"), F.lit(1)), F.lit(block))
    return F.transform(starts, lambda start: F.substr(F.col("body"), start, F.lit(block)))


def _first_names(bodies: DataFrame, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the keys of their blocks, and the numbered keys; no two different blocks share a key."""
    for seed in range(SEEDS):
        contents = bodies.select(F.explode(_blocks(block)).alias("content"))
        first, second = _block_key(F.col("content"), seed)
        different = contents.select(first.alias("h1"), second.alias("h2"), "content").distinct()
        counted = written(different.groupBy("h1", "h2").agg(F.count("*").alias("contents")))
        if counted.where(F.col("contents") > 1).isEmpty():
            names = with_position(counted.select("h1", "h2"), "h1", "h2", name="name")
            keys = F.transform(_blocks(block), lambda b: F.struct(*[h.alias(n) for h, n in zip(_block_key(b, seed), ("h1", "h2"), strict=True)]))
            digest = F.sha2("body", 256).alias("text_sha256")
            rows = bodies.select(F.monotonically_increasing_id().alias("row"), key, digest, keys.alias("keys"))
            return written(rows), names
        release(counted)
    raise RuntimeError(f"different blocks share a key under each of {SEEDS} seeds")


def _identities(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(row, level, name): the name of the whole text and the round in which it was reached."""
    blocks = rows.select("row", F.size("keys").alias("left"), F.posexplode("keys").alias("pos", "key"))
    level = written(
        blocks.select("row", "left", "pos", "key.h1", "key.h2").join(names, ["h1", "h2"]).select("row", "left", "pos", "name")
    )
    most = level.agg(F.max("left")).first()[0] or 1
    levels = [level]
    while most > 1:
        most = (most + 1) // 2
        level = _paired(level)
        levels.append(level)
    done = [
        table.where(F.col("left") == 1).select("row", F.lit(at).alias("level"), "name") for at, table in enumerate(levels)
    ]
    ids = written(reduce(DataFrame.unionByName, done))
    release(*levels)
    return ids


def _paired(level: DataFrame) -> DataFrame:
    """Names of neighbouring pairs, for the texts that have more than one name; a last odd one pairs with 0."""
    side = F.col("pos") % 2
    pairs = written(
        level.where(F.col("left") > 1)
        .groupBy("row", "left", F.shiftright("pos", 1).alias("pair"))
        .agg(
            F.max(F.when(side == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(0)).alias("second"),
        )
    )
    names = with_position(pairs.select("first", "second").distinct(), "first", "second", name="name")
    half = F.shiftright(F.col("left") + 1, 1).alias("left")
    joined = written(pairs.join(names, ["first", "second"]).select("row", half, F.col("pair").alias("pos"), "name"))
    release(pairs, names)
    return joined


ORACLE_SQL = r"""
WITH bodies AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM bodies WINDOW same AS (PARTITION BY body)"""
