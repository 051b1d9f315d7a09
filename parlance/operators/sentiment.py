"""Polarity of words, messages, groups and months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.counts import count, spread
from parlance.operators.joins import inner_lookup
from parlance.operators.ranks import top_n, with_position
from parlance.storage import written

LABELS = ("negative", "positive")


def labelled(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row per token and label that the lexicon gives its word, with the column ``sentiment``.

    Every label counts, null among them, and as often as the lexicon lists it for the word.
    """
    by_word = lexicon.groupBy("word").agg(F.collect_list(F.struct("sentiment")).alias("_labels"))
    found = inner_lookup(tokens, by_word)
    return found.select(*tokens.columns, F.inline("_labels"))


def sentiment_counts(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Labelled words per group and month, one row per label that occurs: Group_Name, index, sentiment, n."""
    found = labelled(tokens, lexicon).withColumnRenamed("Month_Index", "index")
    return count(found, "Group_Name", "index", "sentiment")


def net_sentiment(tokens: DataFrame, lexicon: DataFrame, by: Sequence[str] = ("Group_Name", "Month_Index")) -> DataFrame:
    """Negative and positive words per group and month, and positive minus negative as ``sentiment``.

    One row per word of the lexicon is joined and summed at once, so this takes a single shuffle. A
    lexicon with other labels fails: they would be lost in the difference.
    """
    keys = [F.col(name).alias("index" if name == "Month_Index" else name) for name in by]
    sums = [F.sum(label).alias(label) for label in LABELS]
    found = inner_lookup(tokens, _label_counts(lexicon)).groupBy(*keys).agg(*sums)
    return found.withColumn("sentiment", F.col("positive") - F.col("negative"))


def message_sentiment(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """:func:`net_sentiment` of each message that has a labelled word."""
    return net_sentiment(tokens, lexicon, ("Message_ID_int",))


def score_sums(tokens: DataFrame, scores: DataFrame, by: Sequence[str] = ("Group_Name", "Month_Index")) -> DataFrame:
    """Sum of the scores of a lexicon (word, value) and number of scored words, per group and month: score, n.

    A word listed twice is scored by both values and counted once.
    """
    by_word = scores.groupBy("word").agg(F.sum("value").alias("_value"))
    keys = [F.col(name).alias("index" if name == "Month_Index" else name) for name in by]
    return inner_lookup(tokens, by_word).groupBy(*keys).agg(F.sum("_value").alias("score"), F.count("*").alias("n"))


def word_sentiment(tokens: DataFrame, lexicon: DataFrame, sort: bool = True) -> DataFrame:
    """How often each labelled word is used, for each of its labels: word, sentiment, n."""
    return count(labelled(tokens, lexicon), "word", "sentiment", sort=sort)


def sentiment_top_terms(word_counts: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` words contributing most to each label, ties kept, from :func:`word_sentiment`.

    ``ord`` places the words from the lowest mean count up, over all labels.
    """
    top = written(top_n(written(word_counts), "sentiment", "n", n))
    order = with_position(top.groupBy("word").agg(F.avg("n").alias("_mean")), "_mean", "word")
    placed = top.join(order.withColumnRenamed("word", "_word"), F.col("word").eqNullSafe(F.col("_word")))
    return placed.select("word", "sentiment", "n", "rank", "ord")


def spread_sentiment(counts: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """The long counts made wide, and positive minus negative as ``sentiment``; other labels fail."""
    return spread(counts, "sentiment", "n", labels).withColumn("sentiment", F.col("positive") - F.col("negative"))


def lexicon_use(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """All rows of ``lexicon``, each with the number of uses of its word as ``n``.

    Words are counted first, so a word is one row however often it is used when it meets the lexicon.
    """
    used = count(tokens, "word").withColumnRenamed("word", "_used")
    matched = lexicon.join(used, F.col("word").eqNullSafe(F.col("_used")), "left")
    return matched.select(*lexicon.columns, F.coalesce("n", F.lit(0)).alias("n"))


def _label_counts(lexicon: DataFrame) -> DataFrame:
    """One row per word, with one column per polarity saying how often the lexicon gives it to the word."""
    label = F.col("sentiment")
    known = F.coalesce(label.isin(*LABELS), F.lit(False))
    message = F.concat(F.lit(f"labels must be among {', '.join(LABELS)}; found "), F.coalesce(label, F.lit("null")))
    checked: Column = F.when(known, label).otherwise(F.raise_error(message))
    return lexicon.groupBy("word").agg(*[F.count_if(checked == name).alias(name) for name in LABELS])
