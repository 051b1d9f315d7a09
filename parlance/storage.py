"""Intermediate results kept in the folder that all executors share, and who deletes them.

An operator writes what it reads more than once, and its result goes on reading some of those tables, so
the operator cannot delete them. A :class:`Scope` can: it holds every table written inside it, and
deletes them when the caller has written the result::

    with storage.Scope():
        op.bind_tf_idf(counts).write.parquet(path)
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


BUCKET_BYTES = 64 * 1024 * 1024
UNKNOWN_BYTES = 1 << 50

_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """Tables written while it is entered (in the same thread), deleted when it is left, or at :meth:`release`.

    Tables that are released before are forgotten. Scopes nest: a table belongs to the innermost one.
    """

    def __init__(self):
        self._tables: dict[str, DataFrame] = {}
        self._entered: list = []

    def __enter__(self) -> Scope:
        self._entered.append(_scope.set(self))
        return self

    def __exit__(self, *error) -> None:
        _scope.reset(self._entered.pop())
        self.release()

    @contextmanager
    def open(self):
        """Hold what is written inside, and keep it until :meth:`release`: for results that are read later."""
        token = _scope.set(self)
        try:
            yield self
        finally:
            _scope.reset(token)

    @property
    def tables(self) -> list[DataFrame]:
        return list(self._tables.values())

    def release(self) -> None:
        release(*self.tables)

    def hold(self, table: DataFrame) -> None:
        self._tables[table.written_path] = table
        table.written_scope = self

    def forget(self, path: str) -> None:
        self._tables.pop(path, None)


@contextmanager
def unscoped():
    """Tables written inside belong to no scope: for models that outlive the query that makes them."""
    token = _scope.set(None)
    try:
        yield
    finally:
        _scope.reset(token)


def _held(table: DataFrame) -> DataFrame:
    if (scope := _scope.get()) is not None:
        scope.hold(table)
    return table


def written(rows: DataFrame, schema: StructType | None = None, path: str | None = None) -> DataFrame:
    """Compute ``rows`` once into a table in the checkpoint folder, and read it from there ever after.

    Later steps read only the columns they need, and a lost executor costs no recomputation.
    ``schema`` reads the table back under other types of the same storage form. A ``path`` from
    :func:`table_path` is written over, which an iteration does with tables it no longer reads.
    The table stays until :func:`release` is called with the frame returned here.
    """
    spark = rows.sparkSession
    path = path or table_path(spark)
    rows.write.mode("overwrite").parquet(path)
    table = spark.read.schema(schema or rows.schema).parquet(path)
    table.written_path = path
    return _held(table)


def dealt(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """``rows`` with a partition for each bucket of ``key``."""
    return rows.repartitionById(buckets, F.pmod(F.hash(key), F.lit(buckets)))


def bucketed(rows: DataFrame, key: str, buckets: int | None = None, lies: bool = False) -> DataFrame:
    """:func:`written` as a table whose rows are kept by the hash of ``key``, one file a bucket.

    Groupings and joins by ``key`` that take it as it lies do not shuffle it. Without ``buckets`` there are
    as many as the size of the input of ``rows`` asks for. Rows that come from :func:`dealt` by the same key and number
    lie as they should already.
    """
    spark = rows.sparkSession
    buckets = buckets or bucket_count(rows)
    path = table_path(spark)
    name = f"parlance_{uuid.uuid4().hex}"
    rows = rows if lies else dealt(rows, key, buckets)
    rows.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.written_path, table.written_name = path, name
    return _held(table)


def bucket_count(rows: DataFrame) -> int:
    """One bucket for each ``BUCKET_BYTES`` that the plan of ``rows`` expects, and as many as shuffles have partitions at least.

    With fewer, a join would rather shuffle the table anew than run in so few tasks. A plan on rows of
    unknown size says a number beyond ``UNKNOWN_BYTES``.
    """
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= UNKNOWN_BYTES else max(least, -(-size // BUCKET_BYTES))


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no result reads any more; other frames are left alone."""
    for table in tables:
        path = getattr(table, "written_path", None)
        if (name := getattr(table, "written_name", None)) is not None:
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if (scope := getattr(table, "written_scope", None)) is not None:
            scope.forget(path)
        if path is not None:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def folder(spark: SparkSession) -> str:
    """A new path in the checkpoint folder for files that are not a table of :func:`written`; a scope deletes it, too."""
    place = spark.range(0)
    place.written_path = table_path(spark)
    return _held(place).written_path


def table_path(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors must share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
