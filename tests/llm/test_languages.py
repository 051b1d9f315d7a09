import random
import zlib
from collections import defaultdict

import pytest

from parlance.llm import languages, queries

SF = "/root/testdata/sf0.01"
SAMPLES = {"aa": ["abab abba", "baab"], "bb": ["cdcd dccd é", "dcdc cab"]}


def phrases(text, samples, others=()):
    """Cross-parsing by substring search, text after text of one class per character."""
    letters = {c for texts in [samples, *others] for t in texts for c in t.lower() if c.isalpha()}

    def fold(some):
        out = ""
        for c in some.lower():
            c = c if c in letters else "?" if c.isalpha() else " "
            if not (c == " " and out.endswith(" ")):
                out += c
        return out

    known, at, count, text = [fold(s) for s in samples], 0, 0, fold(text)
    while at < len(text):
        size = 1
        while at + size < len(text) and any(text[at : at + size + 1] in s for s in known):
            size += 1
        count, at = count + 1, at + size
    return count


TEXTS = ["abba cd", "dcdcab ab", "zz abab", "é1é", "c", "ab  ,ab\nab", "cabbage", "abab abba baab", ""]


def every(texts, samples):
    return [[phrases(t, samples[lang], samples.values()) for lang in sorted(samples)] for t in texts]


@pytest.mark.parametrize("letters", [0, 1, 2, 64])
def test_phrases(monkeypatch, letters):
    """Whether a letter's moves are in the table or in the list changes nothing."""
    monkeypatch.setattr(languages, "TABLE_LETTERS", letters)
    languages.build.cache_clear()
    model = languages.build(languages.sampled(SAMPLES))
    languages.build.cache_clear()
    assert model.phrases([model.folded(t) for t in TEXTS]).tolist() == every(TEXTS, SAMPLES)


@pytest.mark.parametrize("letters", [3, 64])
def test_phrases_of_random_texts(monkeypatch, letters):
    draw = random.Random(letters)
    samples = {lang: ["".join(draw.choice(own) for _ in range(80)) for _ in range(3)] for lang, own in (("x", "abcde é"), ("y", "cdefg-"), ("z", "日本語学 "))}
    texts = ["".join(draw.choice("abcdefg éß日本語学校1") for _ in range(draw.randint(0, 200))) for _ in range(60)]
    monkeypatch.setattr(languages, "TABLE_LETTERS", letters)
    languages.build.cache_clear()
    model = languages.build(languages.sampled(samples))
    languages.build.cache_clear()
    assert model.phrases([model.folded(t) for t in texts]).tolist() == every(texts, samples)


def spoken(draw, words, n):
    return " ".join(draw.choice(words) for _ in range(n))


def test_a_small_sample_beside_a_large_one():
    """Two languages that share words: the one with 2 sample texts against 50 is found as often."""
    draw = random.Random(7)
    make = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 7)))
    shared, first, second = ([make() for _ in range(n)] for n in (60, 120, 120))
    samples = {
        "large": [spoken(draw, shared + first, 130) for _ in range(50)],
        "small": [spoken(draw, shared + second, 130) for _ in range(2)],
    }
    model = languages.build(languages.sampled(samples))
    for lang, own in (("large", first), ("small", second)):
        found, _ = languages.predict([spoken(draw, shared + own, 80) for _ in range(100)], model)
        assert found.count(lang) >= 90


def test_many_scripts_and_two_languages_of_one_large_script():
    draw = random.Random(8)
    scripts = {f"s{at:02}": [chr(0x4E00 + 100 * at + i) for i in range(100)] for at in range(24)}
    both = [chr(0xAC00 + i) for i in range(3000)]
    draw.shuffle(both)
    words = {lang: ["".join(draw.choice(both) for _ in range(draw.randint(1, 3))) for _ in range(150)] for lang in ("k1", "k2")}
    samples = {lang: ["".join(draw.choice(own) for _ in range(400)) for _ in range(5)] for lang, own in scripts.items()}
    samples |= {lang: [spoken(draw, own, 200) for _ in range(5)] for lang, own in words.items()}
    model = languages.build(languages.sampled(samples))
    for lang in samples:
        own = scripts.get(lang) or words[lang]
        texts = [(spoken(draw, own, 60) if lang in words else "".join(draw.choice(own) for _ in range(60))) for _ in range(10)]
        assert languages.predict(texts, model)[0] == [lang] * 10


def test_held_out_accuracy(spark):
    found = queries.op10_language_id(spark, SF)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {r.doc_id: r for r in found.collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        assert rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= rows[r.doc_id].score <= 1
    tried = [rows[r.doc_id].lang_pred == r.lang for r in docs if rows[r.doc_id].held_out]
    assert sum(tried) / len(tried) > 0.98


def test_only_text_decides(spark, documents):
    """Equal texts get equal predictions whatever their other columns say, held-out labels are not learned."""
    model = languages.learn(documents)
    swapped = documents.selectExpr("doc_id + 1 AS doc_id", "text", "'xx' AS lang", "'no' AS source")
    first, second = defaultdict(set), defaultdict(set)
    for rows, docs in ((first, documents), (second, swapped)):
        for r in languages.identified(docs, model).join(docs, "doc_id").collect():
            rows[r.text].add((r.lang_pred, r.score))
    assert first == second and all(len(found) == 1 for found in first.values())
    only = documents.withColumn("lang", languages.F.when(languages.held_out(), "hidden").otherwise("seen"))
    assert [lang for lang, _ in languages.learn(only)] == ["seen"]


def test_samples_are_bounded_and_of_different_texts(spark):
    rows = [(i, "copy of one text" if i % 2 else f"other text number {i}", "en" if i < 90 else "de") for i in range(100)]
    seen = dict(languages.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), texts=5, chars=9, languages=1))
    assert list(seen) == ["en"] and len(seen["en"]) == 5 and all(len(t) == 9 for t in seen["en"])


def test_awkward(awkward, nothing):
    model = languages.learn(awkward)
    assert model
    rows = languages.identified(awkward, model).collect()
    assert len(rows) == awkward.count()
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert unknown == {2, 3, 4, 7} and all(r.score == 0 for r in rows if r.doc_id in unknown)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    kept = languages.with_language(awkward, model)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id, r.text, r.name) for r in kept.where("doc_id > 0 AND text IS NOT NULL").collect()) == sorted(
        (r.doc_id, r.text, r.name) for r in awkward.where("doc_id > 0 AND text IS NOT NULL").collect()
    )
    none = languages.learn(nothing)
    assert none == () and languages.identified(nothing, none).collect() == []
    assert {r.lang_pred for r in languages.identified(awkward, none).collect()} == {"und"}
