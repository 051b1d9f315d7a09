"""The registered analyses: each takes a session and a data folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import operators as op
from parlance import sources
from parlance.plans import inputs
from parlance.storage import folder, unscoped, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(analysis):
    QUERIES[analysis.__name__] = analysis
    return analysis


def _custom(spark):
    return sources.custom_stop_words(spark, sources.stop_words(spark))


def _clean(messages):
    """Words without stop words; a group filter on ``messages`` reaches the scan through all of it."""
    return op.without_stop_words(op.tokens(messages), sources.stop_words(messages.sparkSession))


def _focus(spark, sf_dir):
    return op.in_group(inputs.messages(spark, sf_dir), inputs.FOCUS_GROUP)


@query
def messages_from_parquet(spark, sf_dir):
    """The messages as a Parquet table with the other name of the month, read and checked."""
    path = folder(spark)
    inputs.messages(spark, sf_dir).withColumnRenamed("Month_Index", "Month_ID_int").write.parquet(path)
    return sources.read_messages(spark, path)


@query
def messages_from_csv(spark, sf_dir):
    """The messages as CSV files with a header, bodies with line breaks and quotes among them, read and checked."""
    path = folder(spark)
    inputs.messages(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return sources.read_messages(spark, path, "csv", multi_line=True)


@query
def tokens(spark, sf_dir):
    return op.tokens(inputs.messages(spark, sf_dir))


@query
def tokens_clean(spark, sf_dir):
    return _clean(inputs.messages(spark, sf_dir))


@query
def word_counts(spark, sf_dir):
    return op.count(tokens_clean(spark, sf_dir), "word", sort=True)


@query
def frequent_words(spark, sf_dir):
    return op.frequent_words(op.count(tokens_clean(spark, sf_dir), "word"))


@query
def word_cloud(spark, sf_dir):
    return op.word_cloud(op.count(tokens_clean(spark, sf_dir), "word"))


@query
def word_cloud_by_thresholds(spark, sf_dir):
    """The same words, found without a shuffle of the whole vocabulary."""
    return op.most_frequent(tokens_clean(spark, sf_dir))


@query
def sentiment_counts(spark, sf_dir):
    return op.sentiment_counts(tokens_clean(spark, sf_dir), inputs.bing(spark))


@query
def sentiment_by_group_month(spark, sf_dir):
    return op.net_sentiment(tokens_clean(spark, sf_dir), inputs.bing(spark))


@query
def sentiment_spread(spark, sf_dir):
    """The long counts made wide again, the way the net sentiment is defined step by step."""
    return op.spread_sentiment(sentiment_counts(spark, sf_dir))


@query
def message_sentiment(spark, sf_dir):
    """The score of each message with a labelled word."""
    return op.message_sentiment(tokens_clean(spark, sf_dir), inputs.bing(spark))


@query
def score_by_group_month(spark, sf_dir):
    return op.score_sums(tokens_clean(spark, sf_dir), inputs.afinn(spark))


@query
def emotions_by_group_month(spark, sf_dir):
    """Words of each emotion per group and month; a word may have several."""
    return op.sentiment_counts(tokens_clean(spark, sf_dir), inputs.nrc(spark))


@query
def emotions_spread(spark, sf_dir):
    """The same made wide, one column for each emotion that the messages turn out to have."""
    return op.spread_found(written(emotions_by_group_month(spark, sf_dir)), "sentiment", "n")


@query
def word_emotions(spark, sf_dir):
    return op.word_sentiment(tokens_clean(spark, sf_dir), inputs.nrc(spark))


@query
def group_sentiment(spark, sf_dir):
    return op.net_sentiment(_clean(_focus(spark, sf_dir)), inputs.bing(spark))


@query
def stored_group_sentiment(spark, sf_dir):
    """The same from messages stored by group and month, of which only the group's files are read."""
    path = folder(spark)
    sources.store_messages(inputs.messages(spark, sf_dir), path)
    return op.net_sentiment(_clean(sources.read_stored(spark, path, inputs.FOCUS_GROUP)), inputs.bing(spark))


@query
def group_word_sentiment(spark, sf_dir):
    return op.word_sentiment(_clean(_focus(spark, sf_dir)), inputs.bing(spark))


@query
def sentiment_top_terms(spark, sf_dir):
    clean = _clean(_focus(spark, sf_dir))
    return op.sentiment_top_terms(op.word_sentiment(clean, inputs.bing(spark), sort=False))


@query
def lexicons(spark, sf_dir):
    """Entries of the three lexicons, with their uses in the messages."""
    no_value, no_label = F.lit(None).cast("int"), F.lit(None).cast("string")
    entries = sources.bind_rows(
        inputs.afinn(spark).select(F.lit("afinn").alias("lexicon"), "word", no_label.alias("label"), "value"),
        *[
            table.select(F.lit(name).alias("lexicon"), "word", table.sentiment.alias("label"), no_value.alias("value"))
            for name, table in (("bing", inputs.bing(spark)), ("nrc", inputs.nrc(spark)))
        ],
    )
    return op.lexicon_use(op.tokens(inputs.messages(spark, sf_dir)), entries)


@query
def custom_stop_words(spark, sf_dir):
    """Custom and base stop words in one list, with their uses in the messages."""
    return op.lexicon_use(op.tokens(inputs.messages(spark, sf_dir)), _custom(spark))


@query
def proposed_stop_words(spark, sf_dir):
    """Words that groups and messages use most evenly, a list to choose custom stop words from."""
    return op.proposed_stop_words(inputs.messages(spark, sf_dir))


@query
def group_word_counts(spark, sf_dir):
    return op.count(op.tokens(inputs.messages(spark, sf_dir)), "Group_Name", "word", sort=True)


def _group_word_counts(spark, sf_dir):
    return op.count(op.tokens(inputs.messages(spark, sf_dir)), "Group_Name", "word")


@query
def group_totals(spark, sf_dir):
    return op.group_totals(_group_word_counts(spark, sf_dir))


@query
def group_words(spark, sf_dir):
    return op.group_words(_group_word_counts(spark, sf_dir), _custom(spark))


@query
def tfidf(spark, sf_dir):
    """Stop words go before counting: fewer rows to shuffle, and the totals of tf are the filtered ones."""
    kept = op.without_stop_words(op.tokens(inputs.messages(spark, sf_dir)), _custom(spark))
    scored = op.bind_tf_idf(op.count(kept, "Group_Name", "word"))
    return scored.select("Group_Name", "word", "n", *[F.round(name, 9).alias(name) for name in ("tf", "idf", "tf_idf")])


@query
def bigrams(spark, sf_dir):
    pairs = op.ngrams(inputs.messages(spark, sf_dir), 2)
    return op.unite(pairs, "bigram", ["word1", "word2"]).select("Group_Name", "bigram")


@query
def bigrams_separated(spark, sf_dir):
    return op.separate(bigrams(spark, sf_dir), "bigram", ["word1", "word2"])


@query
def bigrams_filtered(spark, sf_dir):
    kept = op.ngrams_without(op.ngrams(inputs.messages(spark, sf_dir), 2), sources.stop_words(spark), 2)
    return kept.select("Group_Name", "word1", "word2")


@query
def bigram_counts(spark, sf_dir):
    return op.count(bigrams_filtered(spark, sf_dir), "word1", "word2", sort=True)


@query
def bigram_counts_packed(spark, sf_dir):
    """The same pairs, numbers while they are counted."""
    return op.packed_ngram_counts(inputs.messages(spark, sf_dir), sources.stop_words(spark), 2, sort=True)


@query
def bigrams_united(spark, sf_dir):
    return op.unite(bigrams_filtered(spark, sf_dir), "bigram", ["word1", "word2"])


@query
def trigram_counts(spark, sf_dir):
    triples = op.ngrams_without(op.ngrams(inputs.messages(spark, sf_dir), 3), _custom(spark), 3)
    return op.count(triples, "word1", "word2", "word3", sort=True)


@query
def trigram_counts_packed(spark, sf_dir):
    return op.packed_ngram_counts(inputs.messages(spark, sf_dir), _custom(spark), 3, sort=True)


@query
def message_word_counts(spark, sf_dir):
    return op.message_word_counts(inputs.messages(spark, sf_dir), sources.stop_words(spark))


@query
def dtm(spark, sf_dir):
    return op.document_term_matrix(message_word_counts(spark, sf_dir))


_models: dict[tuple, op.TopicModel] = {}


def fitted_model(spark, sf_dir, **settings):
    """One fit per application, state of the data and settings, shared by the topic queries."""
    key = (spark.sparkContext.applicationId, inputs.state(spark, sf_dir), *sorted(settings.items()))
    if key not in _models:
        with unscoped():
            _models[key] = op.fit_topics(message_word_counts(spark, sf_dir), **settings)
    return _models[key]


def release_models() -> None:
    """Delete the tables of the models fitted so far."""
    while _models:
        op.release_topics(_models.popitem()[1])


def _rounded(rows, name):
    return rows.withColumn(name, F.round(name, 9))


@query
def topic_beta(spark, sf_dir):
    return _rounded(op.beta(fitted_model(spark, sf_dir)), "beta")


@query
def topic_gamma(spark, sf_dir):
    return _rounded(op.gamma(fitted_model(spark, sf_dir)), "gamma")


@query
def topic_beta_sums(spark, sf_dir):
    sums = op.beta(fitted_model(spark, sf_dir)).groupBy("topic")
    return sums.agg(F.count("*").alias("terms"), F.round(F.sum("beta"), 6).alias("beta_sum"))


@query
def topic_gamma_sums(spark, sf_dir):
    sums = op.gamma(fitted_model(spark, sf_dir)).groupBy("Message_ID_int")
    return sums.agg(F.count("*").alias("topics"), F.round(F.sum("gamma"), 6).alias("gamma_sum"))


# The fit by joins is the only one now; the names it had beside another one stay.
QUERIES["topic_beta_sums_by_joins"] = topic_beta_sums
QUERIES["topic_gamma_sums_by_joins"] = topic_gamma_sums


@query
def topic_alpha(spark, sf_dir):
    """The messages' prior after each round of a fit that estimates it."""
    alphas = fitted_model(spark, sf_dir, estimate_alpha=True).alphas
    found = spark.createDataFrame(list(enumerate(alphas, 1)), "round int, alpha double")
    return found.withColumn("alpha", F.round("alpha", 6))


@query
def topic_top_terms(spark, sf_dir):
    return _rounded(op.topic_top_terms(fitted_model(spark, sf_dir)), "beta")


@query
def topic_assignment(spark, sf_dir):
    return _rounded(op.topic_assignment(fitted_model(spark, sf_dir)), "gamma")


@query
def topic_group_check(spark, sf_dir):
    return op.topic_group_check(fitted_model(spark, sf_dir))


@query
def topic_group_messages(spark, sf_dir):
    """Messages of each group over all assigned topics: every message with a word has exactly one."""
    return topic_group_check(spark, sf_dir).groupBy("Group_Name").agg(F.sum("n").alias("n"))


@query
def topic_purity(spark, sf_dir):
    return op.topic_purity(topic_group_check(spark, sf_dir))


@query
def topic_agreement(spark, sf_dir):
    """How far the topics are the groups, corrected for chance."""
    found = op.agreement(topic_group_check(spark, sf_dir))
    return found.select("n", *[F.round(name, 9).alias(name) for name in found.columns[1:]])
