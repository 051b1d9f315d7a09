"""Token ids of the units that a text can be cut into without changing its tokens, each unit encoded once.

A unit is a stretch of text at whose borders the tokenizer always starts anew, such as a word with
the space before it. Texts repeat their words, so most units are looked up; the tables belong to a
Python worker and start anew when they outgrow their bounds.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np

# Bounds of the tables of one worker.
MOST_UNITS = 700_000
MOST_CHARS = 32_000_000

# The ids of all units in a row, and how many each has.
Stream = tuple[np.ndarray, np.ndarray]
Encode = Callable[[list], list[Stream]]


def stream(ids: Sequence[Sequence[int]]) -> Stream:
    return np.array(list(chain.from_iterable(ids)), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))


class UnitIds:
    """Ids of units in one or more streams, which ``encode`` gives for new units."""

    def __init__(self, encode: Encode, streams: int = 1):
        self._encode, self._streams = encode, streams
        self._clear()

    def _clear(self) -> None:
        self._place: dict = {}
        self._chars = 0
        self._flat = [np.empty(0, np.int32) for _ in range(self._streams)]
        self._counts = [np.empty(0, np.int64) for _ in range(self._streams)]
        self._starts = [np.empty(0, np.int64) for _ in range(self._streams)]

    def _add(self, new: list) -> None:
        first = len(self._place)
        self._place.update(zip(new, range(first, first + len(new)), strict=True))
        self._chars += sum(map(len, new))
        for at, (flat, counts) in enumerate(self._encode(new)):
            starts = len(self._flat[at]) + np.cumsum(counts) - counts
            self._flat[at] = np.concatenate([self._flat[at], flat])
            self._counts[at] = np.concatenate([self._counts[at], counts])
            self._starts[at] = np.concatenate([self._starts[at], starts])

    def of(self, units: list) -> list[Stream]:
        """The streams of the units."""
        if len(self._place) > MOST_UNITS or self._chars > MOST_CHARS:
            self._clear()
        at = np.fromiter(map(self._place.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [units[i] for i in missing.tolist()]
            self._add(list(dict.fromkeys(unknown)))
            at[missing] = np.fromiter(map(self._place.__getitem__, unknown), np.int64, len(unknown))
        return [(taken(self._flat[s], self._starts[s][at], self._counts[s][at]), self._counts[s][at]) for s in range(self._streams)]


def taken(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches ``flat[start : start + count]`` in a row."""
    shift = starts - (np.cumsum(counts) - counts)
    return flat[np.repeat(shift, counts) + np.arange(int(counts.sum()))]



def byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte: its own, or one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [byte for byte in range(256) if byte not in set(own)]
    return {byte: chr(byte) for byte in own} | {byte: chr(256 + at) for at, byte in enumerate(rest)}


# Marks that tokenizers split, as one run, from the letters before them; an apostrophe is not among them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_BEYOND_LATIN = "\u0250"
_SIGNS = byte_signs()


def latin_and_marks(word: str) -> tuple[str, str] | None:
    """A word of Latin letters in the signs of byte-level vocabularies, and the marks after it; else nothing."""
    letters = word.rstrip(MARKS)
    if not letters.isalpha() or max(letters) >= _BEYOND_LATIN:
        return None
    return letters if letters.isascii() else letters.encode().decode("latin-1").translate(_SIGNS), word[len(letters) :]


class Kept(dict):
    """Results of ``make`` by argument, forgotten when there are too many."""

    def __init__(self, make: Callable, most: int = 100_000):
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, key):
        if len(self) >= self._most:
            self.clear()
        found = self[key] = self._make(key)
        return found


def spelled_out(found: Stream, at: np.ndarray) -> Stream:
    """The stream of the units numbered ``at``, from that of different units."""
    flat, counts = found
    many = counts[at]
    return taken(flat, (np.cumsum(counts) - counts)[at], many), many


def one_thread() -> None:
    """Keep the tokenizer library to the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
