"""What the operators share: reading the test tables, batches of bounded size, small joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters of text that a Python step works on at a time; only a longer single text exceeds it.
BATCH_CHARS = 1_000_000

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def whole_row(rows: DataFrame) -> Column:
    """All columns as one, named ``row``, so that none can clash with what is put beside it."""
    return F.struct(*[F.col(f"`{name}`") for name in rows.columns]).alias("row")


def slices(batch: pa.RecordBatch, text: str = "text", chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together stay below ``chars`` bytes, if one row does."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > chars:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)
