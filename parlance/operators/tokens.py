"""Messages to words and n-grams, one per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import ngrams as ngram_runs
from parlance.functions.text import runs_of_equals, words
from parlance.operators.joins import anti_lookup


def tokens(messages: DataFrame, body: str = "Message_Body", mode: str = "uax") -> DataFrame:
    """One row per word of each message; the body is dropped, every other column kept."""
    kept = [name for name in messages.columns if name != body]
    return messages.select(*kept, F.explode(words(body, mode)).alias("word"))


def word_uses(messages: DataFrame, body: str = "Message_Body", mode: str = "uax") -> DataFrame:
    """One row per different word of each message with its uses as ``n``; the body is dropped."""
    kept = [name for name in messages.columns if name != body]
    sorted_words = messages.select(*kept, F.sort_array(words(body, mode)).alias("_words"))
    return sorted_words.select(*kept, F.inline(runs_of_equals(F.col("_words"))).alias("word", "n"))


def without_stop_words(tokens: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Anti join on the word."""
    return anti_lookup(tokens, stop_words, "word")


def ngrams(
    messages: DataFrame, n: int, body: str = "Message_Body", short: str = "drop", mode: str = "uax"
) -> DataFrame:
    """One row per run of ``n`` neighbouring words inside a message, as ``word1`` to ``wordn``."""
    kept = [name for name in messages.columns if name != body]
    return messages.select(*kept, words(body, mode).alias("_words")).select(
        *kept, F.inline(ngram_runs(F.col("_words"), n, short)).alias(*ngram_columns(n))
    )


def ngram_columns(n: int) -> list[str]:
    return [f"word{i}" for i in range(1, n + 1)]


def ngrams_without(ngrams: DataFrame, stop_words: DataFrame, n: int) -> DataFrame:
    """N-grams none of whose words is a stop word; runs were formed before, so no new neighbours arise."""
    return anti_lookup(ngrams, stop_words, *ngram_columns(n))


def unite(rows: DataFrame, name: str, columns: Sequence[str], sep: str = " ") -> DataFrame:
    """Join ``columns`` to one string column in their place; a null is written ``NA``."""
    text = F.concat_ws(sep, *[F.coalesce(F.col(column), F.lit("NA")) for column in columns])
    return _replace(rows, columns, [text.alias(name)])


def separate(rows: DataFrame, column: str, into: Sequence[str], sep: str = " ") -> DataFrame:
    """Split a string column at the pattern ``sep``; missing pieces are null, further ones dropped."""
    pieces = F.split(F.col(column), sep)
    return _replace(rows, [column], [F.get(pieces, F.lit(i)).alias(name) for i, name in enumerate(into)])


def _replace(rows: DataFrame, columns: Sequence[str], new: list[Column]) -> DataFrame:
    """Put ``new`` where the first of ``columns`` stands, and drop the others."""
    selected: list[Column] = []
    for name in rows.columns:
        if name == columns[0]:
            selected += new
        elif name not in columns:
            selected.append(F.col(name))
    return rows.select(*selected)
