"""What a round of the topic fit moves: a row for each part of a block's words, whatever their number."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.operators import beta, fit_topics, gamma, topic_blocks
from parlance.storage import release, written

K, PARTS = 2, 3


@pytest.fixture(scope="module")
def cells(spark):
    table = [(at % 40, f"w{(at * 7 + at // 40) % 300}", 1 + at % 4) for at in range(2000)]
    merged = Counter()
    for message, word, n in table:
        merged[message, word] += n
    return written(spark.createDataFrame([(*key, n) for key, n in merged.items()], "message long, word string, n long"))


@pytest.fixture(scope="module")
def layout(cells):
    table = topic_blocks.laid_out(cells, 4)
    yield table
    release(table)


def by_rows(layout):
    schema = "block long, kind byte, word string, place int, message long, likely double, t1 long, t2 long"
    return layout.groupBy("block").applyInArrow(lambda block: topic_blocks._first_round(block, K, 7), schema)


def packed(layout):
    schema = f"block long, kind byte, {topic_blocks._PACKED}, message long, received array<long>, likely double"
    return layout.groupBy("block").applyInArrow(lambda block: topic_blocks._packed(topic_blocks._first_round(block, K, 7), K, PARTS), schema)


def words_in(gathered):
    import numpy as np

    found = {}
    for row in gathered.where("kind = 0").collect():
        texts = topic_blocks._texts(row["texts"], row["ends"]).to_pylist()
        sums = np.frombuffer(row["sums"], np.int64).reshape(-1, K).tolist()
        for place, text, one in zip(np.frombuffer(row["places"], np.int32).tolist(), texts, sums, strict=True):
            found[row["block"], place] = (text, *one)
    return found


def test_a_block_has_a_row_for_each_part(layout):
    made = packed(layout)
    assert by_rows(layout).where("kind = 0").count() > 4 * PARTS
    assert made.where("kind = 0").count() <= 4 * PARTS
    assert topic_blocks._gathered(made).where("kind = 0").count() <= 4 * PARTS


def test_every_word_comes_back_with_its_sums_over_all_blocks(layout):
    rows = by_rows(layout)
    all_ = {row["word"]: (row["t1"], row["t2"]) for row in rows.where("kind = 0").groupBy("word").agg(F.sum("t1").alias("t1"), F.sum("t2").alias("t2")).collect()}
    expected = {(row["block"], row["place"]): (row["word"], *all_[row["word"]]) for row in rows.where("kind = 0").collect()}
    assert len(all_) == 300 and words_in(topic_blocks._gathered(packed(layout))) == expected
    assert words_in(topic_blocks._gathered(rows, ["t1", "t2"])) == expected


def test_blocks_say_what_their_topics_received(layout):
    totals = by_rows(layout).where("kind = 0").agg(F.sum("t1"), F.sum("t2")).first()
    assert topic_blocks._measured(packed(layout), K, None).totals == list(totals)


def test_sums_beyond_the_doubles_change_no_digit(spark, cells, monkeypatch):
    counts = cells.select(F.lit("g").alias("Group_Name"), F.col("message").alias("Message_ID_int"), "word", "n")

    def numbers():
        model = fit_topics(counts, k=2, max_iter=2)
        return sorted(map(tuple, beta(model).collect())), sorted(map(tuple, gamma(model).collect()))

    few = numbers()
    monkeypatch.setattr(topic_blocks, "EXACT", 0.0)
    assert numbers() == few


def test_texts_travel_once_and_numbers_stand_for_them(spark, layout):
    made = written(packed(layout))
    first = written(topic_blocks._met(topic_blocks._words_of(made)))
    assert first.groupBy("word_part").agg(F.max("words").alias("n")).agg(F.sum("n")).first()[0] == 300
    received = topic_blocks._with_messages(first.drop("texts", "ends"), made)
    share = topic_blocks._Shares(K, 1.0, 0.1, [1.0, 1.0], False)
    messages = layout.where("places IS NOT NULL").select("block", "message", "places", "n").groupBy("block")
    later = written(messages.cogroup(received.groupBy("block")).applyInArrow(topic_blocks._two_tables(share), made.schema))
    words = topic_blocks._words_of(later)
    assert words.where("texts IS NOT NULL OR ends IS NOT NULL OR numbers IS NULL OR sums IS NOT NULL").isEmpty()
    # by number, and by text
    texts = {(row["block"], row["word_part"]): row for row in topic_blocks._words_of(made).collect()}
    by_text = words.drop("texts", "ends", "numbers", "words").join(topic_blocks._words_of(made).select("block", "word_part", "texts", "ends"), ["block", "word_part"])
    by_text = by_text.selectExpr("block", "kind", "word_part", "places", "texts", "ends", "CAST(NULL AS BINARY) AS numbers", "0 AS words", "sums", "small")
    expected = {place: sums[1:] for place, sums in words_in(topic_blocks._met(by_text)).items()}
    found = {}
    for row in topic_blocks._met(words).collect():
        assert row["texts"] is None and len(row["numbers"]) == len(texts[row["block"], row["word_part"]]["ends"]) // 2
        sums = np.frombuffer(row["small"], np.int32).reshape(-1, K).tolist()
        found |= {(row["block"], place): tuple(one) for place, one in zip(np.frombuffer(row["places"], np.int32).tolist(), sums, strict=True)}
    assert found == expected
    release(made, first, later)


def test_sums_of_any_size_are_read_as_they_were():
    sums = [np.array([[1, 2], [3, (1 << 31) - 1]]), np.array([[0, 1 << 31]])]
    out = topic_blocks._sums_out(sums)
    assert [one is None for one in out["sums"]] == [True, False] and [one is None for one in out["small"]] == [False, True]
    part = pa.table({name: pa.array(values, pa.binary()) for name, values in out.items()})
    assert [one.tolist() for one in topic_blocks._sums_in(part, [2, 1])] == [one.tolist() for one in sums]


def test_shares_are_added_up_in_any_runs_of_cells(spark, cells, monkeypatch):
    counts = cells.select(F.lit("g").alias("Group_Name"), F.col("message").alias("Message_ID_int"), "word", "n")

    def numbers():
        model = fit_topics(counts, k=2, max_iter=2)
        return sorted(map(tuple, beta(model).collect())), sorted(map(tuple, gamma(model).collect()))

    few = numbers()
    monkeypatch.setattr(topic_blocks, "STEP_CELLS", 40)
    monkeypatch.setattr(topic_blocks, "SUM_CELLS", 100)
    assert numbers() == few


def test_cells_are_shuffled_once_and_not_sorted_by_block(cells):
    plans, table = [], topic_blocks.bucketed
    topic_blocks.bucketed = lambda rows, *args, **named: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or table(rows, *args, **named)
    try:
        release(topic_blocks.laid_out(cells, 4))
    finally:
        topic_blocks.bucketed = table
    assert plans[0].count("Exchange") - plans[0].count("BroadcastExchange") <= 2 and "FlatMapGroupsInArrow" not in plans[0]
