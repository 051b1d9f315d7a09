"""What the test modules share beside the fixtures; a conftest is no place to import from."""

from parlance import storage

BODIES = [
    (1, 1, "A", "I work here. I can't work!"),
    (2, 1, "A", "Good good bad"),
    (3, 2, "A", "See https://www.yammer.com good"),
    (4, 1, "B", "work"),
    (5, 2, "B", "the envious work"),
    (6, 2, "B", None),
    (7, 2, "B", ""),
]


def tables(spark):
    """Names of what lies in the checkpoint folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(storage.checkpoint_folder(spark))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(status.getPath().getName()) for status in system.listStatus(folder)}


def rows(df):
    """Rows as a sorted list of tuples, nulls first."""
    return sorted((tuple(row) for row in df.collect()), key=lambda row: [(v is not None, v) for v in row])
