"""Words that set a group apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.joins import anti_lookup, attach
from parlance.storage import written


def group_totals(counts: DataFrame) -> DataFrame:
    """All words of each group, from counts per group and word: Group_Name, total."""
    return counts.groupBy("Group_Name").agg(F.sum("n").alias("total"))


def group_words(counts: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Counts per group and word without stop words, with the group's ``total`` from before they went.

    The counts are needed twice and are written down once, so texts are read and split once.
    """
    counts = written(counts)
    totals = counts.groupBy("Group_Name").agg(F.sum("n").alias("total"), F.count("*").alias("_rows"))
    return attach(anti_lookup(counts, stop_words, "word"), written(totals), "Group_Name", "_rows")


def bind_tf_idf(
    counts: DataFrame, term: str = "word", document: str = "Group_Name", n: str = "n", sort: bool = True
) -> DataFrame:
    """Add tf, idf and their product to one row per document and term.

    tf is the share of the term in the document's count, idf the natural logarithm of all
    documents over those with the term. Totals and document frequencies are aggregates of the
    written counts, attached by key and never windows, so neither a large document nor a word of
    all documents ends up in one task.
    """
    counts = written(counts)
    documents = written(counts.groupBy(document).agg(F.sum(n).alias("_all"), F.count("*").alias("_rows")))
    terms = written(counts.groupBy(term).agg(F.count("*").alias("_df"), F.count("*").alias("_rows")))
    tf = F.col(n) / F.col("_all")
    idf = F.log(F.lit(documents.count()) / F.col("_df"))
    scored = attach(attach(counts, documents, document, "_rows"), terms, term, "_rows")
    scored = scored.select(*counts.columns, tf.alias("tf"), idf.alias("idf"), (tf * idf).alias("tf_idf"))
    return scored.orderBy(F.desc("tf_idf"), document, term) if sort else scored
