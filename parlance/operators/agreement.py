"""How well two labellings agree, corrected for chance, from the table of their counts."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.storage import release, written

_PARTS = 1e9


def agreement(checked: DataFrame, first: str = "topic", second: str = "Group_Name", n: str = "n") -> DataFrame:
    """One row: n, purity, adjusted_rand, mutual_information, normalised_information.

    ``checked`` has one row per pair of labels with its count, such as
    :func:`~parlance.operators.topics.topic_group_check`; null is a label. Purity is the share of rows in the
    largest ``second`` label of their ``first`` label. The adjusted Rand index is 0 on average for random
    labels of the same sizes and 1 for equal ones; the mutual information, in nats, is normalised by
    the mean of both entropies. Two labellings of one label each agree fully. Nothing counted gives
    nulls. Pairs of rows and x ln x are added up in whole numbers over the counts and over both
    margins; five numbers each come to the driver, however many labels there are.
    """
    table = written(checked.groupBy(first, second).agg(F.sum(n).alias("n")))
    cells = _sums(table)
    rows = _sums(table.groupBy(first).agg(F.sum("n").alias("n")))
    columns = _sums(table.groupBy(second).agg(F.sum("n").alias("n")))
    largest = table.groupBy(first).agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    release(table)
    schema = "n long, purity double, adjusted_rand double, mutual_information double, normalised_information double"
    if not cells[0]:
        return checked.sparkSession.createDataFrame([(0, None, None, None, None)], schema)
    total = cells[0]
    pairs = Decimal(total) * (total - 1) / 2
    expected = rows[1] * columns[1] / pairs if pairs else Decimal(0)
    most = (rows[1] + columns[1]) / 2
    rand = float((cells[1] - expected) / (most - expected)) if most != expected else 1.0
    of_cells, of_rows, of_columns = (math.log(total) - found[2] / total for found in (cells, rows, columns))
    information = of_rows + of_columns - of_cells
    mean = (of_rows + of_columns) / 2
    normalised = information / mean if mean > 1e-12 else 1.0
    return checked.sparkSession.createDataFrame([(total, largest / total, rand, information, normalised)], schema)


def _sums(counts: DataFrame) -> tuple[int, Decimal, float]:
    """Of the counts: their sum, the pairs of rows inside them, and the sum of x ln x."""
    count = F.col("n").cast("decimal(19,0)")
    terms: Column = F.floor(F.col("n") * F.log(F.col("n").cast("double")) * F.lit(_PARTS) + F.lit(0.5)).cast("decimal(28,0)")
    pairs = (count * (count - F.lit(1).cast("decimal(19,0)"))).cast("decimal(38,0)")
    found = counts.where("n > 0").agg(F.sum("n"), F.sum(pairs), F.sum(terms)).first()
    return found[0] or 0, Decimal(found[1] or 0) / 2, float(found[2] or 0) / _PARTS
