"""Secret scan over versions of files with a ledger of what has been scanned.

Every version's text is addressed by its SHA-256. The ledger holds a row per scanned blob with the
rules (and their versions) it was scanned by and the spans they found. A scan takes one text per
blob that some current rule has not seen, runs only the unseen rules on it, appends to the ledger,
and joins the spans of current rules back to every path. When few blobs are new, only their
texts are moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.spans import SPAN, Rule, of_kind, spans_of
from parlance.llm.tables import text_or_empty
from parlance.storage import table_path, written

LEDGER = f"blob binary, rules array<string>, spans array<{SPAN}>"

_KEY_WORDS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"

# The first three are fixed; the others look for formats that their issuers publish.
RULES = (
    Rule(
        "assign",
        _KEY_WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        needs=_KEY_WORDS + r"""["']?\x20*[:=]""",
        value=1,
        valid=lambda value: F.length(value) >= 6,
        sql_valid="length(s.value) >= 6",
        base=True,
    ),
    Rule("access", "AKIA[A-Z0-9]{16,}", needs="AKIA[A-Z0-9]{16}", base=True),
    Rule("hex", "[0-9a-f]{24,}", needs="[0-9a-f]{24}", base=True),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}", needs="gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox[abprs]-"),
    Rule("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ"),
)


def scan(
    versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: str | None = None, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """One row per row of ``versions``: path, blob, found (sorted array of spans by the current rules).

    ``ledger`` is a folder, read if it exists and appended to; without one, a new one is made in the
    checkpoint folder. A null text is an empty blob. Paths may be null or repeat: each row
    gets the spans of its own text. An empty table adds nothing.
    """
    spark = versions.sparkSession
    ledger = ledger or table_path(spark)
    addressed = versions.select(
        F.col(path).alias("path"), F.unhex(F.sha2(text_or_empty(text), 256)).alias("blob"), text_or_empty(text).alias("body")
    )
    current = F.array(*[F.lit(rule_id(rule)) for rule in rules])
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    unseen = F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))
    todo = (
        addressed.groupBy("blob")
        .agg(F.min("path").alias("first"))
        .join(seen, "blob", "left")
        .select(F.col("blob").alias("of"), "first", unseen.alias("todo"))
        .where(F.size("todo") > 0)
    )
    texts = addressed.join(todo, (F.col("blob") == F.col("of")) & F.col("path").eqNullSafe(F.col("first")))
    nothing = F.array().cast(f"array<{SPAN}>")
    found = [
        F.when(F.array_contains("todo", rule_id(rule)), spans_of(rule, place, F.col("body"))).otherwise(nothing)
        for place, rule in enumerate(rules)
    ]
    scanned = texts.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("spans"))
    scanned.write.mode("append").parquet(ledger)
    # written, so that the join has plain exchanges on both sides and a hot blob can be split
    results = written(
        read_ledger(spark, ledger)
        .dropDuplicates(["blob", "rules"])
        .select("blob", _of_current(rules).alias("spans"))
        .groupBy("blob")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    return addressed.select("path", "blob").join(results, "blob").select("path", "blob", F.array_sort("spans").alias("found"))


def rule_id(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def _of_current(rules: Sequence[Rule]) -> Column:
    """Spans whose rule was, in that ledger row, run in its current version; places as in ``rules``."""
    parts = [
        F.when(F.array_contains("rules", rule_id(rule)), _placed(rule.kind, place)).otherwise(F.array().cast(f"array<{SPAN}>"))
        for place, rule in enumerate(rules)
    ]
    return F.concat(*parts)


def _placed(kind: str, place: int) -> Column:
    return F.transform(
        of_kind("spans", kind),
        lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"), s["score"].alias("score")),
    )


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger, empty if there is none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger)
