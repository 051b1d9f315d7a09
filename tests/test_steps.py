"""Steps of a round of the topic fit: words that a block uses as often are taken together; draws and words of plain text."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import draws, topic_blocks

K, WORDS, MESSAGES = 3, 700, 50


def block(seed):
    draw = np.random.default_rng(seed)
    uses = np.sort(np.minimum(draw.zipf(1.3, WORDS), 900))[::-1]
    uses[:-400], uses[-400:-300], uses[-300:] = np.maximum(uses[:-400], 4), 3, 1
    cells = topic_blocks._Cells.__new__(topic_blocks._Cells)
    cells.messages = pa.array(range(MESSAGES))
    cells.places = np.repeat(np.arange(WORDS, dtype=np.int32), uses)
    cells.numbers = draw.integers(0, MESSAGES, len(cells.places)).astype(np.int32)
    cells.n = draw.integers(1, 5, len(cells.places)).astype(np.uint8)
    return cells


@pytest.mark.parametrize("size", [7, 100, 5000, 1 << 20])
def test_steps_are_all_cells_in_order_and_whole_words_where_they_are_alike(size):
    places = block(1).places
    steps = list(topic_blocks._steps(places, size))
    assert [at for start, stop, _ in steps for at in range(start, stop)] == list(range(len(places)))
    uses = np.bincount(places)
    for start, stop, each in steps:
        assert stop - start <= max(size, topic_blocks.FEW_USES)
        assert not each or np.array_equal(places[start:stop].reshape(-1, each)[:, 0], places[start:stop:each]) and set(uses[places[start:stop]]) == {each}
    assert sum(stop - start for start, stop, each in steps if each) >= 600


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("size", [64, 1 << 14])
def test_sums_are_those_of_one_cell_after_the_other(monkeypatch, exact, size):
    monkeypatch.setattr(topic_blocks, "STEP_CELLS", size)
    monkeypatch.setattr(topic_blocks, "SUM_CELLS", 3 * size)
    if not exact:
        monkeypatch.setattr(topic_blocks, "EXACT", 0.0)
    cells, draw = block(2), np.random.default_rng(3)
    of_word, of_message = draw.random((WORDS, K)), draw.random((MESSAGES, K))

    def weigh(first, last, counts, messages, n, likely):
        own = np.arange(first, last)
        places = np.tile(own, len(messages) // len(own)) if counts is None else np.repeat(own, counts)
        likely[:] = (of_word[places] * of_message[messages]).T

    by_word, by_message = topic_blocks._dealt(cells, K, WORDS, weigh)
    words, messages = np.zeros((WORDS, K), np.int64), np.zeros((MESSAGES, K), np.int64)
    for place, message, n in zip(cells.places, cells.numbers, cells.n.tolist(), strict=True):
        likely = (of_word[place] * of_message[message]).tolist()
        shares = [int(n * 1e6 * one / (likely[0] + likely[1] + likely[2])) for one in likely]
        words[place] += shares
        messages[message] += shares
    assert np.array_equal(by_word, words) and np.array_equal(by_message, messages) and by_word.dtype == by_message.dtype == np.int64


def test_a_step_of_cells_is_a_step_of_draws():
    assert draws.STEP >= topic_blocks.STEP_CELLS


def test_a_word_is_what_it_was_by_possessive_quantifiers(spark):
    draw = random.Random(5)
    letters = "ab_01'.,;- \nÉ\u0301’字カ"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(30))) for _ in range(3000)] + ["It's 3.5, a_b. __ _a 1,000;5 x.1 1.x a..b A'B", "", "a." * 50_000]
    before = text.UAX_TOKEN.replace(text._SPACED_WORD, rf"(?=_*+[{text._LETTER}]){text._SPACED}++(?:(?=['’‘.·‧,;]){text._JOINT}{text._SPACED}++)*+")
    assert before != text.UAX_TOKEN and "(?=_" not in text.UAX_TOKEN
    found = spark.createDataFrame([(one,) for one in texts], "t string").select(text.words("t").alias("words"), F.regexp_extract_all(F.lower("t"), F.lit(before), F.lit(0)).alias("before")).collect()
    assert len(found) == len(texts) and all(row["words"] == row["before"] for row in found)
