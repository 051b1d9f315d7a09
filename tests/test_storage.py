from types import SimpleNamespace

import pytest
from support import rows, tables

from parlance import storage
from parlance.operators import fit_topics, release_topics


def session(master, folder=None, configured=None):
    """As much of a session as the choice of folder looks at."""
    context = SimpleNamespace(master=master, folder=folder)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda value: setattr(context, "folder", value)
    conf = SimpleNamespace(get=lambda key, default: configured or default)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_folder_in_use_comes_first():
    assert storage.checkpoint_folder(session("yarn", "hdfs:/c", "hdfs:/d")) == "hdfs:/c"


def test_configured_folder_is_used():
    assert storage.checkpoint_folder(session("yarn", None, "hdfs:/d")) == "hdfs:/d"


@pytest.mark.parametrize("master", ["local", "local[2]", "local-cluster[2,1,1024]", "spark://host:7077"])
def test_no_folder_is_made_up(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.checkpoint_folder(session(master))


def test_released_tables_are_gone_and_others_stay(spark):
    before = tables(spark)
    kept, gone = (storage.written(spark.range(n)) for n in (3, 4))
    assert len(tables(spark) - before) == 2
    storage.release(gone, spark.range(2))
    assert len(tables(spark) - before) == 1 and kept.count() == 3


def test_a_fit_leaves_two_tables_and_none_when_released(spark):
    table = [("A", i % 7, f"w{i % 5}", 1 + i % 3) for i in range(35)]
    counts = spark.createDataFrame(table, "Group_Name string, Message_ID_int long, word string, n long")
    before = tables(spark)
    model = fit_topics(counts, k=2, max_iter=3)
    assert len(tables(spark) - before) == 2
    release_topics(model)
    assert tables(spark) == before


def test_written_rows_come_back_without_their_lineage(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, t string")
    back = storage.written(df)
    assert rows(back) == rows(df)
    assert "FileScan parquet" in back._jdf.queryExecution().executedPlan().toString()


def test_a_place_can_be_written_over(spark):
    place = storage.table_path(spark)
    storage.written(spark.range(3), path=place)
    assert storage.written(spark.range(5), path=place).count() == 5


def test_a_scope_deletes_what_is_written_in_it_when_it_is_left(spark):
    before = tables(spark)
    with storage.Scope() as outer:
        first = storage.written(spark.range(3))
        with storage.Scope() as inner:
            second = storage.bucketed(spark.range(4), "id", 2)
            with storage.unscoped():
                third = storage.written(spark.range(5))
            assert [t.written_path for t in inner.tables] == [second.written_path]
            early = storage.written(spark.range(6))
            storage.release(early)
            assert len(tables(spark) - before) == 3
            assert second.count() == 4
        assert len(tables(spark) - before) == 2 and first.count() == 3
        assert [t.written_path for t in outer.tables] == [first.written_path]
    assert len(tables(spark) - before) == 1 and third.count() == 5
    storage.release(third)
    assert tables(spark) == before
    assert not spark.sql("SHOW TABLES LIKE 'parlance_*'").collect()


def test_an_open_scope_holds_its_tables_until_it_is_released(spark):
    before, scope = tables(spark), storage.Scope()
    with scope.open():
        table = storage.written(spark.range(3))
        path = storage.folder(spark)
        spark.range(2).write.parquet(path)
    assert table.count() == 3 and len(tables(spark) - before) == 2
    scope.release()
    assert tables(spark) == before and not scope.tables


def test_a_scope_deletes_after_an_error(spark):
    before = tables(spark)
    with pytest.raises(KeyError), storage.Scope():
        storage.written(spark.range(3))
        raise KeyError
    assert tables(spark) == before


def test_buckets_join_without_a_shuffle(spark):
    table = storage.bucketed(spark.range(100).selectExpr("id % 7 AS k", "id"), "k", 4)
    plan = table.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert rows(table.groupBy("k").count()) == rows(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count())
    storage.release(table)
