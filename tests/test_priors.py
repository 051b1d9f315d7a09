"""The Dirichlet prior, and the topic fit that estimates it and keeps its cells in place."""

import math
import random

import numpy as np
import pytest
from support import tables

from parlance.operators import beta, dirichlet_prior, fit_topics, gamma, release_topics
from parlance.operators import topic_blocks
from parlance.operators.priors import digamma, trigamma
from parlance.storage import release, written


def test_digamma_and_trigamma():
    assert digamma(1.0) == pytest.approx(-0.57721566490153286, abs=1e-10)
    assert trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    for x in (0.01, 0.3, 2.5, 40.0, 1e6):
        assert digamma(x + 1) == pytest.approx(digamma(x) + 1 / x, rel=1e-9)
        assert trigamma(x + 1) == pytest.approx(trigamma(x) - 1 / x**2, rel=1e-6, abs=1e-10)
        step = 1e-4 * x
        assert (digamma(x + step) - digamma(x - step)) / (2 * step) == pytest.approx(trigamma(x), rel=1e-4)


def planted(spark, a, k, messages, words, seed=1):
    draw = np.random.default_rng(seed)
    counts = [draw.multinomial(words, share) for share in draw.dirichlet([a] * k, messages)]
    return counts, spark.createDataFrame([tuple(map(int, row)) for row in counts], ", ".join(f"c{i} long" for i in range(k)))


@pytest.mark.parametrize("a", [0.08, 0.6, 5.0])
def test_a_planted_prior_is_recovered(spark, a):
    counts, table = planted(spark, a, 6, 2000, 120)
    columns = table.columns
    found = dirichlet_prior(table, columns)
    assert found == pytest.approx(a, rel=0.1)
    assert dirichlet_prior(table.repartition(7), columns) == found

    def likely(prior):
        total = 6 * prior
        return sum(
            math.lgamma(total) - math.lgamma(total + sum(row)) + sum(math.lgamma(x + prior) - math.lgamma(prior) for x in map(int, row))
            for row in counts
        )

    assert likely(found) >= max(likely(found * 0.99), likely(found * 1.01))


def test_no_rows_leave_the_start(spark):
    _, table = planted(spark, 1.0, 3, 4, 5)
    assert dirichlet_prior(table.where("false"), table.columns, start=2.5) == 2.5


@pytest.fixture(scope="module")
def topical(spark):
    """Messages of four topics with words of their own, mixed by a planted prior."""
    draw = np.random.default_rng(3)
    table = []
    for message, shares in enumerate(draw.dirichlet([0.5] * 4, 400)):
        for topic, n in enumerate(draw.multinomial(60, shares)):
            for word, uses in enumerate(draw.multinomial(n, [0.1] * 10)):
                if uses:
                    table.append(("g", message, f"t{topic}w{word}", int(uses)))
    return spark.createDataFrame(table, "Group_Name string, Message_ID_int long, word string, n long").cache()


def test_the_fit_recovers_a_planted_prior(topical):
    model = fit_topics(topical, k=4, max_iter=35, estimate_alpha=True, alpha=2.0, settled=20)
    assert len(model.alphas) == 35 and set(model.alphas[:20]) == {1.0}
    assert model.alphas[-1] == pytest.approx(0.5, rel=0.1)
    fixed = fit_topics(topical, k=4, max_iter=2, alpha=2.0)
    assert fixed.alphas == ()
    release_topics(model)
    release_topics(fixed)


def numbers(model):
    terms = {(row["term"], row["topic"]): row["beta"] for row in beta(model).collect()}
    return terms, {(row["Message_ID_int"], row["topic"]): row["gamma"] for row in gamma(model).collect()}


def test_blocks_and_steps_change_no_digit(topical, monkeypatch):
    few = numbers(fit_topics(topical, k=3, max_iter=3))
    monkeypatch.setattr(topic_blocks, "STEP_CELLS", 50)
    monkeypatch.setattr(topic_blocks.fit_by_blocks, "__defaults__", (300,))
    assert numbers(fit_topics(topical, k=3, max_iter=3)) == few


def test_a_round_moves_words_of_blocks_and_no_cells(spark, topical):
    cells = written(topical.selectExpr("Message_ID_int AS message", "word", "n"))
    layout = topic_blocks.laid_out(cells, 6)
    assert sorted(row["n"] for row in layout.selectExpr("explode(n) AS n").collect()) == sorted(row["n"] for row in cells.select("n").collect())
    assert layout.where("words IS NOT NULL").count() <= 6
    names = ["t1", "t2"]
    schema = "block long, kind byte, word string, place int, message long, likely double, t1 long, t2 long"
    sums = written(layout.groupBy("block").applyInArrow(lambda block: topic_blocks._first_round(block, 2, 1), schema))
    messages = layout.where("places IS NOT NULL").select("block", "message", "places", "n").groupBy("block")
    share = topic_blocks._Shares(2, 1.0, 0.1, [1.0, 1.0], False)
    plan = messages.cogroup(topic_blocks._gathered(sums, names).groupBy("block")).applyInArrow(topic_blocks._two_tables(share), schema)
    text = plan._jdf.queryExecution().executedPlan().toString()
    # words meet by word, and come back to their block; the scan of the cells is bucketed and has no exchange above it
    assert text.count("Exchange hashpartitioning(word") == 1 and text.count("Exchange hashpartitioning(block") == 1
    assert "Bucketed: true" in text
    assert text.index("Bucketed: true") < text.index("Exchange")
    release(layout, sums, cells)


def test_a_fit_leaves_only_its_model(spark, topical):
    before = tables(spark)
    model = fit_topics(topical, k=2, max_iter=2, estimate_alpha=True)
    assert len(tables(spark) - before) == 2
    release_topics(model)
    assert tables(spark) == before


def test_any_kind_of_message_key(spark):
    draw = random.Random(1)
    table = [("g", f"m{at % 20}", f"w{draw.randrange(9)}", 1 + at % 3) for at in range(60)]
    merged = {}
    for group, message, word, n in table:
        merged[group, message, word] = merged.get((group, message, word), 0) + n
    counts = spark.createDataFrame([(*key, n) for key, n in merged.items()], "Group_Name string, Message_ID_int string, word string, n long")
    assert fit_topics(counts, k=2, max_iter=2).messages.count() == 20
