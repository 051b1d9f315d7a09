import pytest
from support import BODIES, rows
from pyspark.sql import functions as F

from parlance.plans.oracle import STOP_WORDS
from parlance.sources import (
    MESSAGES,
    as_messages,
    bind_rows,
    custom_stop_words,
    read_lexicon,
    read_messages,
    spread_out,
    stop_words,
)


def test_read_parquet_by_name(spark, messages, tmp_path):
    path = str(tmp_path / "m")
    messages.select("Message_Body", "Group_Name", F.col("Month_Index").alias("Month_ID_int"), "Message_ID_int").write.parquet(path)
    read = read_messages(spark, path)
    assert read.columns == MESSAGES.names
    assert rows(read) == rows(messages)


def test_read_csv_with_other_column_order(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('Group_Name,Extra,Message_Body,Month_ID_int,Message_ID_int\nA,x,"Hi, ""you""",3,12\n')
    assert rows(read_messages(spark, str(path), "csv")) == [(12, 3, "A", 'Hi, "you"')]


def test_read_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('Message_ID_int,Month_Index,Group_Name,Message_Body\n1,2,A,"one\ntwo"\n')
    assert rows(read_messages(spark, str(path), "csv", multi_line=True)) == [(1, 2, "A", "one\ntwo")]


def test_csv_files_with_other_headers_fail(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a.csv").write_text("Message_ID_int,Group_Name,Message_Body,Month_Index\n1,A,hello,2\n")
    (folder / "b.csv").write_text("Message_ID_int,Message_Body,Group_Name,Month_Index\n2,good bye,B,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_messages(spark, str(folder), "csv").collect()
    with pytest.raises(Exception, match="(?i)header"):
        read_messages(spark, str(folder), "csv").select("Message_Body").collect()
    (folder / "b.csv").write_text("Message_ID_int,Group_Name,Message_Body,Month_Index\n2,B,good bye,2\n")
    assert rows(read_messages(spark, str(folder), "csv")) == [(1, 2, "A", "hello"), (2, 2, "B", "good bye")]


def test_null_ids_fail(spark, messages):
    with pytest.raises(Exception, match="must not be null"):
        as_messages(messages.withColumn("Message_ID_int", F.expr("nullif(Message_ID_int, 3)"))).collect()


def test_csv_with_wrong_type_fails(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("Message_ID_int,Month_Index,Group_Name,Message_Body\nx,2,A,b\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_messages(spark, str(path), "csv").collect()


def test_missing_column_and_wrong_type_fail(messages):
    with pytest.raises(ValueError, match="Group_Name"):
        as_messages(messages.drop("Group_Name"))
    with pytest.raises(TypeError, match="Message_ID_int"):
        as_messages(messages.withColumn("Message_ID_int", F.col("Message_ID_int").cast("string")))


def test_narrow_ids_are_widened(messages):
    narrow = messages.withColumn("Message_ID_int", F.col("Message_ID_int").cast("int"))
    assert as_messages(narrow).schema["Message_ID_int"].dataType == MESSAGES["Message_ID_int"].dataType


def test_spread_out_only_where_splits_are_few(spark, messages, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    assert spread_out(messages) is messages
    messages.coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread_out(one).rdd.getNumPartitions() == cores
    assert rows(spread_out(one)) == rows(messages) and len(BODIES) == messages.count()
    messages.unionByName(messages).repartition(cores).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert spread_out(many) is many
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        assert spread_out(one) is one
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_lexicons_keep_repeated_words(spark, tmp_path):
    for name, header, lines in [
        ("afinn", "word,value", ["good,3"]),
        ("bing", "word,sentiment", ["envious,positive", "envious,negative"]),
        ("nrc", "word,sentiment", ["good,joy", "good,trust"]),
    ]:
        path = tmp_path / f"{name}.csv"
        path.write_text("\n".join([header, *lines]) + "\n")
        assert read_lexicon(spark, str(path), name, "csv").count() == len(lines)
    assert read_lexicon(spark, str(tmp_path / "afinn.csv"), "afinn", "csv").first()["value"] == 3
    with pytest.raises(ValueError):
        read_lexicon(spark, str(tmp_path / "afinn.csv"), "bing", "csv")
    with pytest.raises(ValueError):
        read_lexicon(spark, str(tmp_path / "afinn.csv"), "other", "csv")


def test_custom_stop_words(spark, stops, custom):
    assert custom.count() == 15
    assert custom.where("word IS NULL").count() == 1
    assert custom_stop_words(spark, stops, ["x"], "mine").where("lexicon = 'mine'").collect() == [("x", "mine")]


def test_default_stop_words_are_the_ones_in_the_sql(spark):
    assert [row["word"] for row in stop_words(spark).collect()] == STOP_WORDS
    assert len(STOP_WORDS) == 181


def test_stop_words_from_a_file(spark, stops, tmp_path):
    stops.write.parquet(str(tmp_path / "s"))
    assert rows(stop_words(spark, str(tmp_path / "s"))) == rows(stops)


def test_bind_rows_matches_names_and_keeps_duplicates(spark):
    a = spark.createDataFrame([("x", 1)], "w string, n int")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "n int, w string")
    c = spark.createDataFrame([("z",)], "w string")
    assert sorted(map(tuple, bind_rows(a, b, c).collect()), key=str) == [("x", 1), ("x", 1), ("y", 2), ("z", None)]
