"""Counts of n-grams by numbers: words are numbered once, and an n-gram is one long while it is counted.

The widest key space of the analyses is that of pairs and triples. Shuffled as texts, they cost many
times what their counts do. Here the words that messages use are counted and numbered in their
order, as far as they fit a broadcast; n-grams of such words are packed, added up and sorted as
numbers, which is the order of their words, and get their texts back where they then lie. N-grams
with a word beyond the numbered ones, the rarest, are counted by their texts, in the same pass. Messages are split
into words once, and their words written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import ngrams as ngram_runs
from parlance.functions.text import words
from parlance.operators import joins
from parlance.operators.counts import count
from parlance.operators.joins import anti_lookup, fits_broadcast
from parlance.operators.ranks import with_position
from parlance.operators.tokens import ngram_columns
from parlance.storage import release, written

# The number of every stop word.
_STOP = -1


def packed_ngram_counts(
    messages: DataFrame, stop_words: DataFrame, n: int, body: str = "Message_Body", sort: bool = False, mode: str = "uax"
) -> DataFrame:
    """Uses of each n-gram without stop words: word1 to wordn, n; the rows of counting :func:`ngrams_without`.

    ``sort`` puts the highest counts first, ties by the words.
    """
    if not 1 <= n <= 3:
        raise ValueError(f"packed n-grams have 1 to 3 words, not {n}")
    said = written(messages.select(words(body, mode).alias("_words")))
    used = written(anti_lookup(count(said.select(F.explode("_words").alias("word")), "word"), stop_words, "word"))
    whole = fits_broadcast(used)
    known = used.select("word") if whole else used.where(F.col("n") >= _least_use(used)).select("word")
    numbered = with_position(known, "word", name="_id", start=0)
    bits = 63 // n
    names = ngram_columns(n)
    rows = said.select(F.inline(ngram_runs(F.col("_words"), n)).alias(*names))
    listed = numbered
    if not whole:
        listed_stops = stop_words.select("word").distinct()
        if fits_broadcast(listed_stops):
            # no word that is used is a stop word, so each has one row here
            listed = numbered.unionByName(listed_stops.withColumn("_id", F.lit(_STOP)))
        else:
            rows = anti_lookup(rows, stop_words, *names)
    for at, name in enumerate(names):
        of_word = F.broadcast(listed.select(F.col("word").alias("_word"), F.col("_id").alias(f"_id{at}")))
        rows = rows.join(of_word, F.col(name).eqNullSafe(F.col("_word")), "inner" if whole else "left").drop("_word")
        if not whole:
            rows = rows.where(F.coalesce(F.col(f"_id{at}"), F.lit(0)) != _STOP)
    ids = [F.col(f"_id{at}") for at in range(n)]
    # null if a word has no number; then the texts are the key
    packed = reduce(lambda key, one: F.shiftleft(key, bits).bitwiseOR(one), ids)
    keys = [packed.alias("_key")]
    if not whole:
        keys += [F.when(packed.isNull(), F.col(name)).alias(f"_{name}") for name in names]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    if whole and sort:
        # a sort below a join is dropped as of no use, unless something reads where it puts the rows;
        # the joins that put the texts back stream these rows past a broadcast, in their order
        sums = sums.orderBy(F.desc("n"), "_key").withColumn("_place", F.monotonically_increasing_id())
    found = sums
    for at, name in enumerate(names):
        one = F.shiftright("_key", bits * (n - 1 - at)).bitwiseAND(F.lit((1 << bits) - 1))
        text = F.broadcast(numbered.select(F.col("word").alias(name), F.col("_id").alias("_one")))
        found = found.join(text, one == F.col("_one"), "inner" if whole else "left").drop("_one")
    release(used)
    if whole:
        return (found.where(F.col("_place") >= 0) if sort else found).select(*names, "n")
    texts = [F.when(F.col("_key").isNull(), F.col(f"_{name}")).otherwise(F.col(name)).alias(name) for name in names]
    every = found.select(*texts, "n")
    return every.orderBy(F.desc("n"), *names) if sort else every


def _least_use(used: DataFrame) -> int:
    """The least power of two such that the words with as many uses are few enough to be broadcast."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    width = F.sum(F.coalesce(F.octet_length("word"), F.lit(0)) + F.lit(24))
    levels = {row["level"]: row for row in used.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), width.alias("bytes")).collect()}
    rows = size = 0
    for at in range(63, -1, -1):
        if at in levels:
            rows, size = rows + levels[at]["rows"], size + levels[at]["bytes"]
        if rows > joins.BROADCAST_ROWS or size > joins.BROADCAST_BYTES:
            return 1 << (at + 1) if at < 62 else (1 << 63) - 1
    return 1
