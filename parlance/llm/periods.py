"""Stretches of words that repeat with a period, found by catchers of squares over dyadic blocks.

A square is a stretch of p words followed at once by the same p words. Cut the words into blocks of
B = 1, 2, 4, ... words: the first half of a square with 2B - 1 <= p <= 4B - 2 holds a whole block,
which comes again p words later. So each completed block keeps a catcher that lives for the next
4B - 2 words: with every word appended, the last B words are compared with the block, by name.
A hit says how far apart the two are, a period p. Hits of neighbouring blocks at the same distance
merge; their common stretch reaches less than B words further on either side, which is found by
halving steps over prefix hashes. If it is 2p words long or more, it is a run.

All catchers of a level advance together, over all texts of a batch: a step compares either every
block with the words at one distance, or one block with the words at all its distances, whichever
takes fewer steps. Names and prefix hashes are hashes; each run is checked word by word in the end,
and a text batch whose check fails is done again with other hashes, so results are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import slices
from parlance.llm.units import taken

LEAST_WORDS = 12
_PRIMES = (2_147_483_629, 2_147_483_587)


class RunFinder:
    """Runs of several texts, given as numbers of their words in a row.

    ``words``: non-negative numbers, equal for equal words; ``starts``: where each text starts, the
    longest text first, so that a level of long blocks only looks at the first texts.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, seed: int = 0):
        # a number of its own after each text: nothing that holds it can come again
        counts = lengths + 1
        self.starts = np.cumsum(counts) - counts
        self.lengths = lengths
        self.words = np.empty(int(counts.sum()), np.int64)
        ends = self.starts + lengths
        inside = np.ones(len(self.words), bool)
        inside[ends] = False
        self.words[inside] = words
        top = int(words.max(initial=-1)) + 1
        self.words[ends] = top + np.arange(len(ends))
        self._hashed(np.random.default_rng([seed, 0x51]), top + len(ends))

    def _hashed(self, draw: np.random.Generator, values: int) -> None:
        of_value = draw.integers(1, 1 << 63, size=(3, values), dtype=np.int64)
        self._names = of_value[0][self.words].astype(np.uint64)
        self._odd = draw.integers(0, 1 << 62, size=2, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self._powers, self._sums = [], []
        for prime, value in zip(_PRIMES, of_value[1:], strict=True):
            power = _powers(int(draw.integers(1 << 20, prime)), len(self.words) + 1, prime)
            terms = (value % prime)[self.words] * power[:-1] % prime
            self._powers.append(power)
            self._sums.append(np.concatenate([[0], np.cumsum(terms)]))

    def _same(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the ``size`` words from a and from b (a < b) are the same, by prefix hashes."""
        same = np.ones(len(a), bool)
        for prime, power, sums in zip(_PRIMES, self._powers, self._sums, strict=True):
            of_a = (sums[a + size] - sums[a]) % prime
            same &= of_a * power[b - a] % prime == (sums[b + size] - sums[b]) % prime
        return same

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of each run of at least two periods, by place in ``words``, period smallest."""
        found = [np.empty((0, 3), np.int64)]
        size, names = 1, self._names
        while True:
            # texts that can hold a square of this level: two periods of 2 * size - 1 words at least
            texts = int(np.searchsorted(-self.lengths, -(4 * size - 2), side="right"))
            if not texts:
                break
            stop = int(self.starts[texts - 1] + self.lengths[texts - 1])
            if size > 1:
                half = size // 2
                names = names[:stop]
                mixed = names[:-half] * self._odd[0] ^ (names[half:] * self._odd[1] >> np.uint64(29)) ^ names[half:] << np.uint64(17)
                names = mixed * self._odd[1]
            found.append(self._of_level(names, size))
            size *= 2
        every = np.concatenate(found)
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        first = np.ones(len(every), bool)
        first[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
        return tuple(every[first].T)

    def _hits(self, names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of the level and the distances at which their catchers see them again."""
        blocks = names[::size]
        near, far = 2 * size - 1, 4 * size - 2
        block, distance = [], []
        if far - near < len(blocks):
            for step in range(near, far + 1):
                later = names[step::size]
                hit = np.flatnonzero(blocks[: len(later)] == later)
                block.append(hit)
                distance.append(np.full(len(hit), step))
        else:
            for at in range(len(blocks)):
                hit = np.flatnonzero(names[at * size + near : at * size + far + 1] == blocks[at])
                block.append(np.full(len(hit), at))
                distance.append(hit + near)
        if not block:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(block), np.concatenate(distance)

    def _of_level(self, names: np.ndarray, size: int) -> np.ndarray:
        block, distance = self._hits(names, size)
        order = np.lexsort((block, distance))
        block, period = block[order], distance[order]
        new = np.ones(len(block), bool)
        new[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(block)]])[: len(first)] - 1
        period = period[first]
        start, end = block[first] * size, (block[last] + 1) * size
        # each side reaches less than a block further, as the next block was no hit
        step = size // 2
        total = len(self.words)
        while step:
            can = np.flatnonzero(start >= step)
            can = can[self._same(start[can] - step, start[can] - step + period[can], step)]
            start[can] -= step
            can = np.flatnonzero(end + period + step <= total)
            can = can[self._same(end[can], end[can] + period[can], step)]
            end[can] += step
            step //= 2
        kept = end - start >= period
        return np.stack([start[kept], end[kept] + period[kept], period[kept]], axis=1)

    def checked(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
        """Whether each run keeps its period word by word, and neither neighbour does (read in parts)."""
        before, after = np.flatnonzero(start > 0), np.flatnonzero(end < len(self.words))
        if (self.words[start[before] - 1] == self.words[start[before] + period[before] - 1]).any():
            return False
        if (self.words[end[after]] == self.words[end[after] - period[after]]).any():
            return False
        for one in np.flatnonzero(end - start > 1 << 16):
            a, b, p = start[one], end[one], period[one]
            if (self.words[a : b - p] != self.words[a + p : b]).any():
                return False
        rest = end - start <= 1 << 16
        start, period, counts = start[rest], period[rest], (end - start - period)[rest]
        dealt = np.cumsum(counts) // (1 << 22)
        for part in range(int(dealt[-1]) + 1 if len(dealt) else 0):
            own = dealt == part
            first = taken(self.words, start[own], counts[own])
            if (first != taken(self.words, start[own] + period[own], counts[own])).any():
                return False
        return True


def _powers(base: int, count: int, prime: int) -> np.ndarray:
    power = np.ones(count, np.int64)
    have, factor = 1, base % prime
    while have < count:
        more = min(have, count - have)
        power[have : have + more] = power[:more] * factor % prime
        have += more
        factor = factor * factor % prime
    return power


def runs_of(words: np.ndarray, lengths: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of at least ``least`` words and two periods, sorted.

    A run is a stretch with smallest period ``period`` that no neighbouring word extends. ``words``
    are the numbers of the words of all texts in a row, ``lengths`` the texts' numbers of words.
    """
    order = np.argsort(-lengths, kind="stable")
    offsets = np.cumsum(lengths) - lengths
    sorted_words = taken(words, offsets[order], lengths[order])
    seed = 0
    while True:
        finder = RunFinder(sorted_words, lengths[order], seed)
        start, end, period = finder.runs()
        if finder.checked(start, end, period):
            break
        seed += 1
    long = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[long], end[long], period[long]
    place = np.searchsorted(finder.starts, start, side="right") - 1
    text, start, length = order[place], start - finder.starts[place], end - start
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def with_periods(words: list[bytes], key: int) -> list[bytes]:
    """The words of a text, made periodic from some word on if the key's checksum ends in 0 (a planted case)."""
    mark = zlib.crc32(str(key).encode())
    rest, n = mark // 10, len(words)
    if mark % 10 or not n:
        return words
    start = rest % n
    period = 1 + (n - start) // (3 + rest % 8)
    unit = words[start : start + period]
    return words[:start] + (unit * (-(-(n - start) // period)))[: n - start]


SCHEMA = (
    "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, plant: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_words, runs, collapsed.

    ``runs`` are the stretches (start, length, period; words counted from 0) by start, then period,
    that repeat with their smallest period, have at least ``least`` words and two periods, and that no
    neighbouring word extends. ``collapsed`` is the text's words joined by one space without those
    that come after the first period of some run. Words are separated by ASCII white space. Null
    and empty texts have no words, no runs and an empty collapsed text; repeated rows each give their
    row; a null key is kept. ``plant`` first makes the words of some texts periodic (:func:`with_periods`;
    none with a null key). Rows are worked on where they are read: nothing is shuffled.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _batch(part, least, plant)

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, {SCHEMA}"
    return rows.mapInArrow(found, schema).withColumnRenamed("key", key)


def _batch(batch: pa.RecordBatch, least: int, plant: bool) -> pa.RecordBatch:
    texts = [(text or "").encode().split() for text in batch.column("text").to_pylist()]
    if plant:
        keys = batch.column("key").to_pylist()
        texts = [words if key is None else with_periods(words, key) for words, key in zip(texts, keys, strict=True)]
    number: dict[bytes, int] = {}
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    every = np.fromiter(
        (number.setdefault(word, len(number)) for words in texts for word in words), np.int64, int(lengths.sum())
    )
    text, start, length, period = runs_of(every, lengths, least)
    counts = np.bincount(text, minlength=len(texts))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    gone = _gone(np.cumsum(lengths) - lengths, text, start, length, period, int(lengths.sum()))
    collapsed = [
        b" ".join(_kept(words, gone, at, had)) for words, at, had in zip(texts, (np.cumsum(lengths) - lengths).tolist(), counts.tolist(), strict=True)
    ]
    run = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    arrays = [batch.column("key"), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), run)]
    arrays.append(pa.array([words.decode() for words in collapsed], pa.string()))
    return pa.RecordBatch.from_arrays(arrays, names=["key", "n_words", "runs", "collapsed"])


def _gone(offsets, text, start, length, period, total) -> np.ndarray:
    """For each word whether some run holds it after the run's first period."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, offsets[text] + start + period, 1)
    np.add.at(change, offsets[text] + start + length, -1)
    return np.cumsum(change[:-1]) > 0


def _kept(words: list[bytes], gone: np.ndarray, at: int, runs: int) -> list[bytes]:
    if not runs:
        return words
    return [words[i] for i in np.flatnonzero(~gone[at : at + len(words)]).tolist()]
