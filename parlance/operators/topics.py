"""Latent Dirichlet allocation over messages: matrix, fit, terms of topics, topics of messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.counts import count
from parlance.operators.joins import anti_lookup, attach
from parlance.operators.ranks import top_n, with_position
from parlance.operators.tokens import word_uses
from parlance.operators.topic_blocks import Priors, fit_by_blocks, in_pieces
from parlance.session import narrow_rows
from parlance.storage import release, written


@dataclass(frozen=True)
class TopicModel:
    """A fitted model as two tables, topics being numbered from 1 by position in the arrays.

    ``terms``: term, weights (share of the term in each topic).
    ``messages``: Message_ID_int, Group_Name, weights (share of each topic in the message).
    ``alphas``: the prior of each round, if it was estimated.
    """

    k: int
    terms: DataFrame
    messages: DataFrame
    alphas: tuple[float, ...] = ()


def message_word_counts(messages: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Uses of each word in each message, without stop words: Group_Name, Message_ID_int, word, n.

    A message is one row, so its words are counted inside it and no text is shuffled. Ids that are
    not unique fail; the check reads nothing but the ids.
    """
    repeated = messages.groupBy("Message_ID_int").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if not repeated.isEmpty():
        raise ValueError("message ids must be unique")
    return anti_lookup(word_uses(messages.select("Group_Name", "Message_ID_int", "Message_Body")), stop_words, "word")


def vocabulary(counts: DataFrame) -> DataFrame:
    """Distinct words with their place in sorted order: word, messages, term_index from 1."""
    found = counts.where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("messages"))
    return with_position(found, "word", name="term_index")


def document_term_matrix(counts: DataFrame) -> DataFrame:
    """The non-zero cells of the message x word matrix: Message_ID_int, term_index, n.

    ``counts`` is :func:`message_word_counts`; messages without words have no cell.
    """
    counts = written(counts)
    cells = attach(counts.where(F.col("word").isNotNull()), vocabulary(counts), "word", "messages")
    return cells.select("Message_ID_int", "term_index", "n")


def fit_topics(
    counts: DataFrame,
    k: int = 13,
    seed: int = 1234,
    max_iter: int = 20,
    alpha: float | None = None,
    eta: float = 1.1,
    tolerance: float | None = None,
    estimate_alpha: bool = False,
    settled: int = 10,
) -> TopicModel:
    """Fit ``k`` topics to :func:`message_word_counts`, every word counting, for a vocabulary of any size.

    ``alpha`` (50/k + 1) and ``eta`` are the priors of messages and words and must exceed 1. The fit
    takes ``max_iter`` rounds, or fewer if a ``tolerance`` is given: it then ends when a round raises
    the log likelihood by less than that share of it. With ``estimate_alpha`` the messages' prior is
    fitted to the data, a step a round after the first ``settled``; ``alpha`` less 1 (50/k), a Dirichlet prior, is
    then where it starts. Equal counts and settings give equal
    models. Release the model with :func:`release_topics` when no result of it is read any more.
    """
    counted = counts.where(F.col("word").isNotNull()).select(F.col("Message_ID_int").alias("message"), "Group_Name", "word", "n")
    with narrow_rows(counts.sparkSession):
        cells = written(in_pieces(counted))
    if cells.isEmpty():
        raise ValueError("no message has a word to fit topics to")
    alpha = 50 / k + 1 if alpha is None else alpha
    if alpha <= 1 or eta <= 1:
        raise ValueError(f"alpha and eta must exceed 1, not {alpha} and {eta}")
    terms, mixed, alphas = fit_by_blocks(cells, k, seed, max_iter, Priors(alpha - 1, eta - 1, settled if estimate_alpha else None), tolerance)
    # counting takes most rows away by hash; the first of a text alone would sort them all
    cells_of = cells.select("message", "Group_Name").groupBy("message", "Group_Name").agg(F.count("*").alias("_cells"))
    groups = cells_of.where("_cells > 0").drop("_cells").dropDuplicates(["message"])
    messages = written(
        mixed.join(groups, "message").select(F.col("message").alias("Message_ID_int"), "Group_Name", "weights")
    )
    release(cells, mixed)
    return TopicModel(k, terms, messages, tuple(alphas))


def release_topics(model: TopicModel) -> None:
    """Delete the tables of a fitted model."""
    release(model.terms, model.messages)


def beta(model: TopicModel) -> DataFrame:
    """Share of each term in each topic: topic, term, beta."""
    return _by_topic(model.terms, "term", share="beta").select("topic", "term", "beta")


def gamma(model: TopicModel) -> DataFrame:
    """Share of each topic in each message: Message_ID_int, topic, gamma."""
    return _by_topic(model.messages, "Message_ID_int", share="gamma")


def topic_top_terms(model: TopicModel, n: int = 5) -> DataFrame:
    """The ``n`` likeliest terms of each topic, ties kept: topic, label, term, beta, rank, ord.

    ``ord`` places the terms of one topic from the lowest share up, as a chart draws them.
    """
    top = top_n(beta(model), "topic", "beta", n)
    placed = with_position(top, "topic", "beta", "term", name="_place")
    first = placed.groupBy("topic").agg(F.min("_place").alias("_first"))
    order = F.col("_place") - F.col("_first") + F.lit(1)
    return (
        placed.join(F.broadcast(first), "topic")
        .select("topic", F.col("topic").cast("string").alias("label"), "term", "beta", "rank", order.alias("ord"))
        .orderBy("topic", F.desc("beta"), "term")
    )


def topic_assignment(model: TopicModel) -> DataFrame:
    """The likeliest topic of each message, the lowest number on a tie: Message_ID_int, topic, gamma."""
    return _assigned(model).drop("Group_Name")


def topic_group_check(model: TopicModel) -> DataFrame:
    """Messages per assigned topic and group: topic, Group_Name, n."""
    return count(_assigned(model), "topic", "Group_Name")


def topic_purity(checked: DataFrame) -> DataFrame:
    """The largest group of each topic and its share, from :func:`topic_group_check`: topic, Group_Name, n, share."""
    largest = F.min(F.struct((-F.col("n")).alias("_n"), "Group_Name"))
    found = checked.groupBy("topic").agg(largest.alias("_top"), F.sum("n").alias("_all"))
    n = -F.col("_top._n")
    return found.select("topic", "_top.Group_Name", n.alias("n"), (n / F.col("_all")).alias("share"))


def _assigned(model: TopicModel) -> DataFrame:
    share = F.array_max("weights")
    topic = F.array_position("weights", share).cast("int")
    return model.messages.select("Message_ID_int", "Group_Name", topic.alias("topic"), share.alias("gamma"))


def _by_topic(table: DataFrame, key: str, share: str) -> DataFrame:
    return table.select(key, F.posexplode("weights").alias("_position", share)).select(
        key, (F.col("_position") + F.lit(1)).alias("topic"), share
    )
