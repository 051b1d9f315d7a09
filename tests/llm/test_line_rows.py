from parlance.llm import fuzzy_lines

L1, L2, L3, L4 = (f"{a} line of text tells about {b}" for a, b in (("this", "ships"), ("green", "winter hats"), ("no", "large numbers"), ("every", "old maps")))


def left(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return [r.text for r in fuzzy_lines.without_repeats(docs).collect()]


def test_rows_without_a_key_lose_only_their_own_lines(spark):
    rows = [(None, f"{L1}\n{L2}"), (None, f"{L3}\n{L1}"), (None, f"{L4}\n{L2}")]
    assert sorted(left(spark, rows)) == sorted([f"{L1}\n{L2}", L3, L4])


def test_rows_that_share_a_key_lose_only_their_own_lines(spark):
    rows = [(7, f"{L1}\n{L2}"), (7, f"{L1}\n{L3}"), (2, L4), (7, f"{L3}\n{L4}")]
    assert sorted(left(spark, rows)) == sorted([f"{L1}\n{L2}", L3, L4])
    report = fuzzy_lines.line_report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_lines, [tuple(x) for x in r.removed]) for r in report) == [
        (2, 1, []),
        (7, 2, []),
        (7, 2, [(0, 7, 0)]),
        (7, 2, [(0, 7, 1), (1, 2, 0)]),
    ]
