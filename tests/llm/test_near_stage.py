import random

import numpy as np

import corpus_pipeline
from parlance.llm.near_texts import fingerprints
from support import tables


def words(seed, n=60):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(10_000)}" for _ in range(n))


def left(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()), key=str)


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = map(words, range(4))
    # 7 has a text of its own besides a copy of 1's; 8 is there twice; c only without ids; a with an id and without
    rows = [(1, a), (7, a), (7, b), (8, d), (8, d), (None, c), (None, c), (None, a)]
    assert left(spark, rows) == sorted([(1, a), (7, b), (8, d), (None, c)], key=str)


def edited(draw, text, most):
    split = text.split()
    for _ in range(draw.randrange(most + 1)):
        split[draw.randrange(len(split))] = f"x{draw.randrange(10_000)}"
    return " ".join(split)


def test_groups_are_those_of_the_fingerprints(spark):
    draw = random.Random(4)
    rows = []
    for group in range(25):
        base = words(100 + group, draw.choice([12, 60, 150, 400]))
        rows += [(len(rows) + i, edited(draw, base, max(len(base.split()) // 40, 1))) for i in range(8)]
    draw.shuffle(rows)
    texts = dict(rows)
    prints = dict(zip(texts, fingerprints(list(texts.values())).view(np.uint64).tolist(), strict=True))
    label = {k: k for k in texts}
    for i in texts:
        for j in texts:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    assert 0 < sum(label[k] != k for k in label)
    assert left(spark, rows) == sorted(((k, t) for k, t in rows if label[k] == k), key=str)


def test_tables_of_a_stage_go_when_the_next_is_called(spark, documents):
    before = tables(spark)
    first = corpus_pipeline.without_repeated_lines(spark, documents, "")
    held = tables(spark) - before
    assert held and first.count() > 0
    second = corpus_pipeline.one_of_near_copies(spark, documents, "")
    assert not held & tables(spark) and second.count() > 0
    corpus_pipeline.at_target_weights(spark, documents.limit(0), "").count()
    corpus_pipeline._behind.pop(spark.sparkContext.applicationId).release()
    assert not tables(spark) - before
