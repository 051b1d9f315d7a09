"""Cells of the topic fit are written and shuffled as pieces of messages, not one by one."""

import pytest
from pyspark.sql import functions as F

from parlance import session
from parlance.operators import fit_topics, release_topics, topic_blocks, topics
from parlance.storage import release

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS = [("g", 1, "a", 2), ("g", 1, "é語", 300), (None, 1, "", 1), ("g", None, "b", 1), ("g", None, "b" * 300, 1 << 33), ("g", 1, "c", 1)]


@pytest.fixture
def cells(spark):
    return spark.createDataFrame(ROWS, "Group_Name string, message long, word string, n long").coalesce(1)


def test_neighbouring_cells_of_a_message_are_a_row(cells):
    found = topic_blocks.in_pieces(cells).collect()
    assert [(row["Group_Name"], row["message"], row["cells"], bytes(row["texts"]).decode()) for row in found] == [
        ("g", 1, 2, "aé語"), (None, 1, 1, ""), ("g", None, 2, "b" * 301), ("g", 1, 1, "c"),
    ]
    assert [topic_blocks._counts(row["counts"], row["cells"]).tolist() for row in found] == [[2, 300], [1], [1, 1 << 33], [1]]
    assert [topic_blocks._counts(row["lengths"], row["cells"]).tolist() for row in found] == [[1, 5], [0], [1, 300], [1]]


def test_messages_in_pieces_are_laid_out_whole(cells):
    layout = topic_blocks.laid_out(topic_blocks.in_pieces(cells.drop("Group_Name")), 2)
    rows = layout.collect()
    words = {row["block"]: row["words"] for row in rows if row["places"] is None}
    kept = [row for row in rows if row["places"] is not None]
    assert sorted((row["message"] is not None, len(row["n"])) for row in kept) == [(False, 2), (True, 4)]
    assert sorted(sum((one for one in words.values()), [])) == sorted({row[2] for row in ROWS})
    release(layout)


def test_a_fit_writes_a_row_for_many_cells(spark, monkeypatch):
    sizes, settings, table = [], [], topics.written
    before = spark.conf.get(SETTING, None)

    def kept(rows, *args):
        settings.append(spark.conf.get(SETTING, None))
        found = table(rows, *args)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(topics, "written", kept)
    counts = spark.range(4000, numPartitions=2).select(F.lit("g").alias("Group_Name"), F.expr("id DIV 100").alias("Message_ID_int"), F.expr("'w' || id % 90").alias("word"), F.lit(1).cast("long").alias("n"))
    release_topics(fit_topics(counts, k=2, max_iter=1))
    assert sizes[0] == 40 and settings[0] == str((1 << 31) - 1) and spark.conf.get(SETTING, None) == before


def test_the_setting_comes_back_after_an_error(spark):
    before = spark.conf.get(SETTING, None)
    with pytest.raises(ZeroDivisionError), session.narrow_rows(spark):
        1 / 0
    assert spark.conf.get(SETTING, None) == before
