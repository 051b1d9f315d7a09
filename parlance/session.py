"""Session settings the library is tested and benchmarked with."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(
    cpus: int | str = "*", memory: str = "12g", app: str = "parlance", folder: str | None = None
) -> SparkSession:
    """One-machine session for tests and the benchmark; clusters bring their own.

    ``folder`` is for intermediate tables, a new temporary one if none is named.
    """
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="parlance-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Let the session's Python workers import this package from where the driver has it, whatever folder they run in.

    Clusters whose machines do not share that folder ship the package with the application.
    """
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


@contextmanager
def narrow_rows(spark: SparkSession):
    """Send rows to Python by number alone, 10,000 at a time unless the session says otherwise, for rows of a few words and numbers.

    Spark measures the batch after each row else, which takes longer than the row.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str((1 << 31) - 1))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
