import pytest
import sentencepiece
from test_lines import brute as removed_lines
from test_mixing import brute_rates, draw_of, tokens
from test_near import brute as near_groups

import corpus_pipeline
from parlance.llm import mixing, pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The rows that each stage returns, by its name, and the rows it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, corpus_pipeline.written(stage(spark, docs, SF))
        found[name] = ([r.asDict() for r in given.collect()], [r.asDict() for r in docs.collect()])
        if name != "pieces":
            assert docs.dtypes == given.dtypes
    return found


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_languages(kept):
    given, left = map(by_id, kept["language"])
    assert set(left) == {k for k, r in given.items() if any(c.isalpha() for c in r["text"])}
    assert sum(r["lang"] == given[k]["lang"] for k, r in left.items()) / len(left) > 0.98
    assert all({**r, "lang": 0} == {**given[k], "lang": 0} for k, r in left.items())


def test_lines(kept):
    given, left = map(by_id, kept["lines"])
    gone = removed_lines([(k, r["text"]) for k, r in given.items()])
    for k, r in given.items():
        lines = r["text"].split("\n")
        text = "\n".join(line for i, line in enumerate(lines) if i not in {x[0] for x in gone.get(k, [])})
        if k in gone and not text.split():
            assert k not in left
        else:
            assert left[k] == {**r, "text": text, "n_chars": len(text)}


def test_near_copies(kept):
    given, left = map(by_id, kept["near copies"])
    stay = {key for key, _, component in near_groups([(k, r["text"]) for k, r in given.items()]) if key == component}
    assert left == {k: r for k, r in given.items() if k in stay}


def test_mix(kept):
    given, left = map(by_id, kept["mix"])
    topics = {k: next((n for n, p in mixing.TOPICS[:-1] if mixing_re(p, r["text"])), "prose") for k, r in given.items()}
    rates = brute_rates([(r["source"], r["lang"], topics[k], tokens(r["text"])) for k, r in given.items()], mixing.EXPONENT)
    stay = {k for k, r in given.items() if draw_of(k) < rates.get((r["source"], r["lang"], topics[k]), 1.0)}
    assert left == {k: r for k, r in given.items() if k in stay}


def mixing_re(pattern, text):
    import re

    return re.search(pattern, text)


def test_pieces(kept):
    given, left = map(by_id, kept["pieces"])
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {k: r["ids"] for k, r in left.items()} == {k: library.encode(r["text"]) for k, r in given.items()}
    assert all(r["round_trip"] for r in left.values())


def test_run_gives_the_last_stage(spark, kept):
    found = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids) for r in found.collect()) == sorted((r["doc_id"], r["ids"]) for r in kept["pieces"][1])


def test_awkward(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            left = corpus_pipeline.written(stage(spark, docs, SF))
            assert name == "pieces" or left.columns == docs.columns
            docs = left
        docs.collect()
