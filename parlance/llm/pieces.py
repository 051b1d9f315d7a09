"""SentencePiece encoding and decoding with numpy.

A text is cut before every run of spaces; no piece of the vocabulary reaches over such a cut, so
each word (its leading spaces included) is segmented by itself, and once for all its uses. Words of
equal length advance together: at each position the hashes of the substrings that end there probe
the sorted hashes of the pieces, and the best predecessor is stored for each word.

What is best depends on the kind of the model. In a unigram model it is the largest sum of scores.
In a merge model the score of a path is the same sum, but a step whose two neighbours the merges
would not have left side by side counts minus infinity; exactly one path to each position
remains, the one that merging yields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from parlance.llm.tables import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, MERGES = 1, 2
UNKNOWN_PENALTY = 10.0
FACTOR = np.uint64(0x9E3779B97F4A7C15)
CELLS = 2_000_000
LONG = 200
WORDS_KEPT = 600_000
PAIR_BITS = 21
LIKELY_BITS = 20
SLICE_CHARS = 3_000_000
_LIKELY_SHIFT = np.uint64(64 - LIKELY_BITS)
_WORDS = re.compile(" *[^ ]+| +")


@dataclass
class Pieces:
    """A vocabulary: pieces by id with spaces written as spaces, their scores, ids of single bytes."""

    kind: int
    pieces: list[str | None]
    scores: np.ndarray
    byte_ids: np.ndarray
    prefix: bool

    def __post_init__(self) -> None:
        ids = [i for i, piece in enumerate(self.pieces) if piece is not None]
        self.ids_of = {self.pieces[i]: i for i in ids}
        self.longest = max(map(len, self.ids_of), default=1)
        hashes = np.array([substring_hash(p) if p is not None else 0 for p in self.pieces], dtype=np.uint64)
        order = np.argsort(hashes[ids])
        self.keys, self.key_ids = hashes[ids][order], np.array(ids, dtype=np.int64)[order]
        self.likely = np.zeros(1 << LIKELY_BITS, dtype=bool)
        self.likely[self.keys >> _LIKELY_SHIFT] = True
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        if any(re.search("[^ ] ", piece) for piece in self.ids_of):
            raise ValueError("a piece reaches over a cut between words")
        self.powers = np.array([pow(int(FACTOR), i, 2**64) for i in range(self.longest + 1)], dtype=np.uint64)
        self.worst = float(self.scores[ids].min()) - UNKNOWN_PENALTY if ids else -UNKNOWN_PENALTY
        texts = [b"" if p is None else p.encode() for p in self.pieces]
        for value, i in enumerate(self.byte_ids):
            texts[i] = bytes([value])
        sizes = np.array([len(t) for t in texts])
        self.bytes_at, self.bytes = np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(texts), dtype=np.uint8)
        if self.kind == MERGES:
            self._trace_edges(hashes)

    def _trace_edges(self, hashes: np.ndarray) -> None:
        """For each piece, the parts at its two ends while it is being merged, and the score that ends each.

        ``solid`` says whether merging its characters gives the piece at all.
        """
        n = len(self.pieces)
        depth = self.longest + 1
        self.solid = np.zeros(n, dtype=bool)
        self.edges = np.zeros((2, n, depth), dtype=np.uint64)  # hash of the part at the left end [0], right end [1]
        self.sizes = np.zeros((2, n, depth), dtype=np.int64)
        self.ended = np.full((2, n, depth), -np.inf)
        for piece, i in self.ids_of.items():
            seen = _merges(piece, self)
            self.solid[i] = seen[-1] == [piece]
            for side, end in ((0, 0), (1, -1)):
                chain = list(dict.fromkeys(parts[end] for parts in seen))
                for at, part in enumerate(chain):
                    known = self.ids_of.get(part)
                    self.edges[side, i, at] = hashes[known] if known is not None else substring_hash(part)
                    self.sizes[side, i, at] = len(part)
                    if at:
                        self.ended[side, i, at - 1] = self.scores[known]
        self.pair_keys = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.pair_kept = np.zeros(1 << PAIR_BITS, dtype=bool)

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the hashes that are a piece's, and the ids of those pieces.

        The first bits of a hash rule out most of what is no piece before the sorted keys are searched.
        """
        places = np.flatnonzero(self.likely[hashes >> _LIKELY_SHIFT])
        some = hashes[places]
        at = np.searchsorted(self.keys, some)
        at[at == len(self.keys)] = 0
        same = self.keys[at] == some if len(self.keys) else np.zeros(0, dtype=bool)
        return places[same], self.key_ids[at[same]]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        starts = self.bytes_at[ids]
        return self.bytes[runs(starts, self.bytes_at[ids + 1] - starts)].tobytes()

    def is_stable(self, left: int, right: int) -> bool:
        return bool(self.stable(np.array([left]), np.array([right]))[0])

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of two neighbours ends in just these two pieces.

        No neighbour (-1: an unknown character, or the start of the word) takes part in no merge.
        Answers are kept by pair, the newer one where two pairs share a place.
        """
        pairs = left * np.int64(len(self.pieces)) + right
        slot = (pairs.astype(np.uint64) * FACTOR >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        answer = self.pair_kept[slot]
        new = np.flatnonzero(self.pair_keys[slot] != pairs)
        if len(new):
            answer[new] = self._stable(left[new], right[new])
            slot, pairs = slot[new], pairs[new]
            self.pair_keys[slot] = pairs
            # of pairs that meet in a slot the last one written stays in both tables
            self.pair_kept[slot] = answer[new]
        return answer

    def _stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Replay both sides' merges in the order of their scores, the left first on a tie.

        The pair falls if at some time the two parts that touch form a piece that is due before
        either part is merged away.
        """
        answer = self.solid[right].copy()
        answer[left >= 0] &= self.solid[left[left >= 0]]
        rows = np.flatnonzero(answer & (left >= 0))
        a, b = left[rows], right[rows]
        i, j = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        while len(rows):
            joined = self.edges[1, a, i] * self.powers[self.sizes[0, b, j]] + self.edges[0, b, j]
            hits, ids = self.probe(joined)
            due = np.full(len(rows), -np.inf)
            due[hits] = self.scores[ids]
            ends_left, ends_right = self.ended[1, a, i], self.ended[0, b, j]
            falls = (due > ends_left) & (due >= ends_right) & (due > -np.inf)
            answer[rows[falls]] = False
            on_left = ends_left >= ends_right
            going = ~falls & ((ends_left > -np.inf) | (ends_right > -np.inf))
            i, j = i + on_left, j + ~on_left
            rows, a, b, i, j = rows[going], a[going], b[going], i[going], j[going]
        return answer



def substring_hash(text: str) -> int:
    value = 0
    for c in text:
        value = (value * int(FACTOR) + ord(c) + 1) & (2**64 - 1)
    return value


def read_model(path: str = MODEL) -> Pieces:
    """The vocabulary of a SentencePiece model file with byte pieces."""
    import sentencepiece

    with open(path, "rb") as file:
        stored = file.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=stored)
    size = model.get_piece_size()
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    if not all(model.is_byte(int(i)) for i in byte_ids):
        raise ValueError("the model has no pieces for single bytes")
    special = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    pieces = [None if i in special else model.id_to_piece(i).replace(SPACE, " ") for i in range(size)]
    scores = np.array([model.get_score(i) for i in range(size)])
    kind = _number(stored, 2, 3) or UNIGRAM
    return Pieces(kind, pieces, scores, byte_ids, model.encode("a", out_type=str)[0].startswith(SPACE))


def _number(stored: bytes, message: int, name: int) -> int | None:
    """An integer of a message inside the model file, the last one set."""
    found = None
    for number, value in _fields(stored):
        if number == message and isinstance(value, bytes):
            found = next((v for n, v in reversed(list(_fields(value))) if n == name), found)
    return found


def _fields(stored: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = stored[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(stored):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, stored[at : at + size]
            at += size


# --- words ---------------------------------------------------------------------------------------


def encode_words(words: list[str], model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the offsets of the words in them."""
    by_length: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        by_length.setdefault(len(word), []).append(at)
    order, sizes, ids = [], [], []
    for length, places in by_length.items():
        step = max(1, CELLS // (length + 1))
        for first in range(0, len(places), step):
            some = places[first : first + step]
            group = [words[i] for i in some]
            path = _advance if length <= LONG else _walk
            rows, ends, found = path(group, length, model)
            found, counts = _with_bytes(group, rows, ends, found, model)
            if model.bytes_of(found) != "".join(group).encode():
                raise ValueError("a substring shares the hash of another piece")
            order.extend(some)
            sizes.append(counts)
            ids.append(found)
    if not words:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    grouped, counts = np.concatenate(ids), np.concatenate(sizes)
    starts = np.cumsum(counts) - counts
    back = np.argsort(np.array(order))
    return grouped[runs(starts[back], counts[back])], np.concatenate([[0], np.cumsum(counts[back])])


def _advance(words: list[str], length: int, model: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of one length, position by position: row, end and piece of each step of the best paths."""
    n = len(words)
    codes = _codes(words).reshape(n, length).T
    hashes = np.zeros((length + 1, n), dtype=np.uint64)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((length + 1, n), dtype=np.int32)
    last = np.full((length + 1, n), -1, dtype=np.int64)
    for end in range(1, length + 1):
        hashes[end] = hashes[end - 1] * FACTOR + codes[end - 1] + np.uint64(1)
        for size in range(min(end, model.longest), 0, -1):
            begin = end - size
            rows, ids = model.probe(hashes[end] - hashes[begin] * model.powers[size])
            if size == 1:
                single = np.zeros(n, dtype=bool)
                single[rows] = True
            reached = best[begin, rows] > -np.inf
            rows, ids = rows[reached], ids[reached]
            if not len(rows):
                continue
            score = best[begin, rows] + model.scores[ids]
            if model.kind == MERGES:
                score[~model.stable(last[begin, rows], ids)] = -np.inf
            better = score > best[end, rows]
            rows, ids = rows[better], ids[better]
            best[end, rows], back[end, rows], last[end, rows] = score[better], begin, ids
        lone = np.flatnonzero(~single & (best[end - 1] > -np.inf))
        score = best[end - 1, lone] + model.worst
        better = score > best[end, lone]
        lone = lone[better]
        best[end, lone], back[end, lone], last[end, lone] = score[better], end - 1, -1
    at, steps = np.full(n, length, dtype=np.int32), []
    while len(rows := np.flatnonzero(at > 0)):
        steps.append((rows, at[rows], last[at[rows], rows]))
        at[rows] = back[at[rows], rows]
    rows, ends, ids = (np.concatenate(x) for x in zip(*reversed(steps), strict=True))
    order = np.argsort(rows, kind="stable")
    return rows[order], ends[order], ids[order]


def _walk(words: list[str], length: int, model: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for words of great length, of which there are few: all places of a word are probed at once."""
    rows, ends, ids = [], [], []
    for row, word in enumerate(words):
        codes = _codes([word])
        # the hash of each window of ``size`` characters, from the windows one shorter
        window = np.zeros(length + 1, dtype=np.uint64)
        hits: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
        for size in range(1, min(length, model.longest) + 1):
            window = window[: length - size + 1] * FACTOR + codes[size - 1 :] + np.uint64(1)
            for begin, i in zip(*(x.tolist() for x in model.probe(window)), strict=True):
                hits[begin + size].append((begin, i))
        best, back, last = [0.0], [0], [-1]
        for end in range(1, length + 1):
            top = (-np.inf, 0, -1)
            for begin, i in sorted(hits[end]):
                score = best[begin] + model.scores[i]
                if score > top[0] and (model.kind != MERGES or model.is_stable(last[begin], i)):
                    top = (score, begin, i)
            if not any(begin == end - 1 for begin, _ in hits[end]) and best[end - 1] + model.worst > top[0]:
                top = (best[end - 1] + model.worst, end - 1, -1)
            best.append(top[0])
            back.append(top[1])
            last.append(top[2])
        at, path = length, []
        while at > 0:
            path.append(at)
            at = back[at]
        ends.extend(reversed(path))
        ids.extend(last[end] for end in reversed(path))
        rows.extend([row] * len(path))
    return np.array(rows), np.array(ends), np.array(ids, dtype=np.int64)


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _with_bytes(words, rows, ends, ids, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Unknown characters replaced by the ids of their bytes; the number of ids of each word."""
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        spelled = [model.byte_ids[list(words[rows[i]][ends[i] - 1].encode())] for i in unknown.tolist()]
        times = np.ones(len(ids), dtype=np.int64)
        times[unknown] = [len(s) for s in spelled]
        places = (np.cumsum(times) - times)[unknown]
        ids, rows = np.repeat(ids, times), np.repeat(rows, times)
        for place, s in zip(places.tolist(), spelled, strict=True):
            ids[place : place + len(s)] = s
    return ids, np.bincount(rows, minlength=len(words))


def merged(text: str, model: Pieces) -> list[str]:
    """The text's characters, the best-scored neighbours (the leftmost of equals) merged while there are any."""
    return _merges(text, model)[-1]


def _merges(text: str, model: Pieces) -> list[list[str]]:
    """The parts of the text before the first merge and after each."""
    parts = list(text)
    seen = [list(parts)]
    while True:
        best = None
        for i in range(len(parts) - 1):
            found = model.ids_of.get(parts[i] + parts[i + 1])
            if found is not None and (best is None or model.scores[found] > best[0]):
                best = (model.scores[found], i)
        if best is None:
            return seen
        at = best[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        seen.append(list(parts))


# --- texts ---------------------------------------------------------------------------------------


class _Numbers(dict):
    """A number for each key, given when the key is first looked up."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Encodes texts and remembers the words it has met, up to ``WORDS_KEPT`` of them."""

    def __init__(self, model: Pieces) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts in them."""
        if len(self.numbers) > WORDS_KEPT:
            self._forget()
        numbers, places, known = self.numbers, [], len(self.numbers)
        for text in texts:
            words = _WORDS.findall(f" {text}" if self.model.prefix and text else text)
            places.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
        ids, at = encode_words(list(islice(numbers, known, None)), self.model)
        self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        used = np.concatenate(places) if places else np.empty(0, np.int64)
        sizes = self.at[used + 1] - self.at[used]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        counts = [len(place) for place in places]
        return self.ids[runs(self.at[used], sizes)], ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … for each of ``sizes`` steps, one run after another."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, sizes)


def decode_texts(ids: np.ndarray, offsets: np.ndarray, model: Pieces) -> list[str]:
    """Texts behind ids, bytes joined to characters; the space that encoding puts first is taken off."""
    texts = []
    for first, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        text = model.bytes_of(ids[first:end]).decode("utf-8", "replace")
        texts.append(text[1:] if model.prefix and text[:1] == " " else text)
    return texts


# --- tables --------------------------------------------------------------------------------------


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """One row per row of ``docs``: key, ids (array of int), n_tokens, round_trip.

    ``round_trip`` says whether decoding the ids gave the text back. A null text has null ids, no
    tokens and a null round trip; an empty text has an empty array. Any character can be encoded:
    one without a piece becomes its bytes, and so does the sign that stands for a space inside
    the model file, so that it is not read back as a space. Repeated rows and null keys stay.
    The model file (a driver-side path) is sent to the executors, as they may not see it.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_model(model))
    types = [pa.field("ids", pa.list_(pa.int32())), pa.field("n_tokens", pa.int64()), pa.field("round_trip", pa.bool_())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces.value
        encoder = Encoder(model)
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                texts = part.column("text").to_pylist()
                ids, offsets = encoder([t or "" for t in texts])
                back = decode_texts(ids, offsets, model)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32), mask=np.array([*(t is None for t in texts), False])), pa.array(ids)
                )
                same = [None if t is None else t == b for t, b in zip(texts, back, strict=True)]
                columns = [part.column("key"), lists, pa.array(np.diff(offsets)), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([part.schema.field("key"), *types]))

    rows = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>, n_tokens long, round_trip boolean"
    return rows.mapInArrow(encode, schema).withColumnRenamed("key", key)


def decoded(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per row: key, text; null ids give a null text. Bytes that are no UTF-8 become U+FFFD."""
    pieces = rows.sparkSession.sparkContext.broadcast(read_model(model))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces.value
        for batch in batches:
            lists = batch.column("ids")
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = decode_texts(values, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), model)
            valid = lists.is_valid().to_pylist()
            column = pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), column], schema=pa.schema([batch.schema.field("key"), pa.field("text", pa.string())]))

    narrow = rows.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids")
    schema = f"key {narrow.schema['key'].dataType.simpleString()}, text string"
    return narrow.mapInArrow(decode, schema).withColumnRenamed("key", key)
