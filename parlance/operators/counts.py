"""Counting, thresholds and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ranks import with_position


def count(rows: DataFrame, *columns: str, sort: bool = False) -> DataFrame:
    """Rows per distinct ``columns`` as ``n``; a null is a value of its own.

    ``sort`` puts the highest counts first, with the columns deciding ties.
    """
    counts = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), *columns) if sort else counts


def in_group(rows: DataFrame, group: str = "Book_Review") -> DataFrame:
    """Rows of one group; on messages or their words alike, the filter reaches the scan."""
    return rows.where(F.col("Group_Name") == group)


def frequent_words(counts: DataFrame, min_count: int = 1500) -> DataFrame:
    """Words counted more than ``min_count`` times, ``ord`` giving their place from the least count up."""
    return with_position(counts.where(F.col("n") > min_count), "n", "word")


def word_cloud(counts: DataFrame, max_words: int = 500, min_freq: int = 3) -> DataFrame:
    """The ``max_words`` most frequent words among those with at least ``min_freq`` uses, ties going by word."""
    return counts.where(F.col("n") >= min_freq).orderBy(F.desc("n"), "word").limit(max_words)


def spread(rows: DataFrame, key: str, value: str, labels: Sequence[str], fill: int = 0) -> DataFrame:
    """Long to wide: one column per label of ``key`` holding ``value``, ``fill`` where there is none.

    The labels are given, so the schema is fixed and no job looks for them. A row with another
    label, or none, fails: it would be lost.
    """
    kept = [name for name in rows.columns if name not in (key, value)]
    named = F.coalesce(F.col(key).isin(*labels), F.lit(False))
    message = F.concat(F.lit(f"{key} must be among {', '.join(labels)}; found "), F.coalesce(F.col(key), F.lit("null")))
    checked = F.when(named, F.col(key)).otherwise(F.raise_error(message))
    wide = [F.max(F.when(checked == label, F.col(value))) for label in labels]
    return rows.groupBy(*kept).agg(
        *[F.coalesce(column, F.lit(fill)).alias(label) for column, label in zip(wide, labels)]
    )


def labels_of(rows: DataFrame, key: str, most: int = 200) -> list[str | None]:
    """The different values of ``key`` in order, null last; more than ``most`` fail.

    At most ``most`` + 1 values of each task, and as many in all, are ever held.
    """
    found = [row[0] for row in rows.select(F.col(key).cast("string")).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{key} has more than {most} different values; a table this wide is to be asked for by name")
    return sorted(found, key=lambda label: (label is None, label))


def spread_found(
    rows: DataFrame, key: str, value: str, fill: int = 0, most: int = 200, null_label: str = "NA"
) -> DataFrame:
    """:func:`spread` over the labels that ``key`` has in ``rows``, in order; null gets a column ``null_label``.

    The labels are looked for first, so pass rows that are cheap to read twice, such as a written
    table. A label that is also the name of a kept column, or of the column for null, fails, as do
    more than ``most`` labels. No rows give the kept columns alone.
    """
    labels = labels_of(rows, key, most)
    kept = [name for name in rows.columns if name not in (key, value)]
    names = [null_label if label is None else label for label in labels]
    if repeated := {name for name in names if names.count(name) > 1 or name in kept}:
        raise ValueError(f"labels of {key} need columns of their own: {', '.join(sorted(repeated))}")
    wide = [F.max(F.when(F.col(key).eqNullSafe(F.lit(label)), F.col(value))) for label in labels]
    columns = [F.coalesce(column, F.lit(fill)).alias(name) for column, name in zip(wide, names, strict=True)]
    grouped = rows.groupBy(*[F.col(f"`{name}`") for name in kept])
    return grouped.agg(*columns) if columns else rows.select(*kept).distinct()
