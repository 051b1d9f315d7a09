"""Stop words proposed from the messages themselves: words that every group and message uses alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.joins import attach
from parlance.operators.tokens import word_uses
from parlance.storage import written

# Terms are added up in whole parts of this unit, and rates as decimals, so that sums do not depend on the order of rows.
_PARTS = 1e9
_SHARE = "decimal(38,18)"


def word_spread(messages: DataFrame, mode: str = "uax") -> DataFrame:
    """How evenly each word is spread: word, n, messages, groups, group_evenness, message_evenness, score.

    ``group_evenness`` is the entropy of the word's rates in the groups (its uses over all words of
    the group) as a share of the entropy of equal rates in all groups, ``message_evenness`` that of its
    uses in the messages over all messages; ``score`` is their product. With one group or
    one message everything is even. Uses are counted inside the message, then by group and word; from
    there on all sums are over counts, and group totals are attached by key. Null groups are a
    group; null words (of null bodies) are left out. No messages give no rows.
    """
    found = word_uses(messages.select("Group_Name", "Message_Body"), mode=mode).where(F.col("word").isNotNull())
    terms = _parts(F.col("n") * F.log(F.col("n").cast("double")))
    counts = written(
        found.groupBy("Group_Name", "word").agg(
            F.sum("n").alias("n"), F.count("*").alias("messages"), F.sum(terms).alias("_terms")
        )
    )
    totals = written(counts.groupBy("Group_Name").agg(F.sum("n").alias("_all"), F.count("*").alias("_rows")))
    groups, every = totals.count(), messages.count()
    rate = F.col("n") / F.col("_all")
    rated = attach(counts, totals, "Group_Name", "_rows").withColumn("_rate", rate)
    by_word = rated.groupBy("word").agg(
        F.sum("n").alias("n"),
        F.sum("messages").alias("messages"),
        F.count("*").alias("groups"),
        F.sum("_terms").alias("_terms"),
        F.sum(F.col("_rate").cast(_SHARE)).cast("double").alias("_rates"),
        F.sum((F.col("_rate") * F.log("_rate")).cast(_SHARE)).cast("double").alias("_rate_terms"),
    )
    of_groups = _entropy(F.col("_rates"), F.col("_rate_terms"))
    of_messages = _entropy(F.col("n").cast("double"), F.col("_terms") / F.lit(_PARTS))
    scored = by_word.select(
        "word", "n", "messages", "groups", _share(of_groups, groups).alias("group_evenness"), _share(of_messages, every).alias("message_evenness")
    )
    return scored.withColumn("score", F.col("group_evenness") * F.col("message_evenness"))


def proposed_stop_words(messages: DataFrame, n: int = 100, digits: int = 6, mode: str = "uax") -> DataFrame:
    """The ``n`` words of the highest score of :func:`word_spread`, rounded to ``digits``, with their ``rank`` from 1.

    Ties go to the more frequent word, then by word.
    """
    rounded = [F.round(name, digits).alias(name) for name in ("group_evenness", "message_evenness", "score")]
    spread = word_spread(messages, mode).select("word", "n", "messages", "groups", *rounded)
    order = [F.desc("score"), F.desc("n"), "word"]
    top = spread.orderBy(*order).limit(n)
    # at most n rows
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "*")


def _parts(value: Column) -> Column:
    return F.floor(value * F.lit(_PARTS) + F.lit(0.5))


def _entropy(whole: Column, terms: Column) -> Column:
    """Entropy of shares x / whole from the sum of x ln x."""
    return F.when(whole > 0, F.log(whole) - terms / whole).otherwise(F.lit(0.0))


def _share(entropy: Column, of: int) -> Column:
    return entropy / F.log(F.lit(float(of))) if of > 1 else F.lit(1.0)
