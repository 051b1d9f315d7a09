import pytest

CLASHING = (
    "row level name keys body path blob found spans size shard slot print group node doc line place removed "
    "lang_pred score _rate _cell _cell_rate gone lines left c0 c1 n_words base_failed rule kept h1 h2 first block ids key tokens topic"
).split()

AWKWARD = [
    (1, "One plain line of some words.\nAnd one more line of words here.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "de", None),
    (3, "", "de", None),
    (4, " \n\t ", None, "b"),
    (None, "One plain line of some words.\nAnd one more line of words here.", "en", "a"),
    (5, "One plain line of some words.\nAnd one more line of words here.", "en", "a"),
    (6, "x" * 30_000, "fr", "b"),
    (7, "12345 ... !!!", "fr", "b"),
    (8, "word " * 20_000, "en", "a"),
    (9, "日本語 ▁ 😀 é\u0000", "ja", "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those the operators use."""
    rows = [(*row, len(row[1] or ""), *["clash"] * len(CLASHING)) for row in AWKWARD]
    columns = ", ".join(f"`{name}` string" for name in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {columns}").repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
