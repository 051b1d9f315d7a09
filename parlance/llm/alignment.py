"""Two tokenizers side by side: the groups of tokens between bytes where both end, and their links.

A byte range of a text gives a fragment: the tokens up to the first byte where both tokenizers end
(open prefix), the groups closed after that, and the tokens after the last such byte (open suffix).
Two neighbouring fragments make one: the left suffix and the right prefix close a group, or stay
open if one side has no closed end. This is associative, so the ranges of a very long text are
read by different tasks and put together in a tree, of which only the open ends are shuffled. A text
of one range closes all its groups where it is read.

Ranges end at multiples of ``RANGE`` bytes, wherever that falls in a token. A range is read with the
rest of the units (see ``units``) that it cuts, so that its tokens are those of the whole text, and
has the tokens that end in it. A longer unit belongs to the range in which it ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import slices, text_or_empty
from parlance.llm.units import Kept, Stream, UnitIds, byte_signs, latin_and_marks, one_thread, spelled_out, stream, taken
from parlance.operators.joins import BROADCAST_ROWS, fits_broadcast
from parlance.storage import release, written

RANGE = 65_536
FAN = 16
BATCH = 2_000_000
PIECE_SPACE = "▁"
# Links of a group are listed one by one up to this number; beyond it, by its different ids.
MANY_LINKS = 4096
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
# White space, a run of which is no border, at the start (after the space put there), at the end, or beside more of it.
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHITE_RUN = rf"^$|^[^ ]|{_SPACES}{_SPACES}|{_SPACES}$"
_CUT_BYTES = re.compile(rb"(?<=[!-~])(?=[ \n][!-~])")


class Pair:
    """Tokenizer A (byte-level merges over the usual word pattern) and B (pieces with a space sign and byte fallback)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        one_thread()
        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = {char: byte for byte, char in byte_signs().items()}
        names = [self._a.id_to_token(i) or "" for i in range(self._a.get_vocab_size())]
        special = {i for i, token in self._a.get_added_tokens_decoder().items() if token.special}
        self.bytes_a = [b"" if i in special else bytes(plain[c] for c in name) for i, name in enumerate(names)]
        self.bytes_b = [self._piece_bytes(i) for i in range(self._b.get_piece_size())]
        self.size_a, self.size_b = (np.fromiter(map(len, table), np.int64, len(table)) for table in (self.bytes_a, self.bytes_b))
        signs = [[f"{sign}{i}" for i in range(max(len(self.size_a), len(self.size_b)))] for sign in ",|;"]
        self.written = [*signs[0], *signs[1], *signs[2]]
        self._after = Kept(lambda marks: self._a.encode(marks, add_special_tokens=False).ids if marks else [])
        self._sign_of_space = byte_signs()[32]
        self._space = self._b.piece_to_id(PIECE_SPACE)
        self._known = UnitIds(self._encode, streams=3)

    def _piece_bytes(self, i: int) -> bytes:
        if self._b.is_control(i) or self._b.is_unknown(i):
            return b""
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace(PIECE_SPACE, " ").encode()

    def _ids_a(self, units: list[str]) -> list[list[int]]:
        """A space and Latin letters are what the word pattern makes of them: they go to the merges at once."""
        found: list[list[int] | None] = [None] * len(units)
        other = []
        merge, after, space = self._a.model.tokenize, self._after, self._sign_of_space
        for at, unit in enumerate(units):
            split = latin_and_marks(unit[1:]) if unit[0] == " " else None
            if split is None:
                other.append(at)
            else:
                found[at] = [token.id for token in merge(space + split[0])] + after[split[1]]
        for at, one in zip(other, self._a.encode_batch_fast([units[at] for at in other], add_special_tokens=False), strict=True):
            found[at] = one.ids
        return found

    def _encode(self, units: list[str]) -> list[Stream]:
        """Ids by A and by B of new units, and a mark in place of both for a unit whose tokens do not give it back."""
        ids_a = self._ids_a(units)
        ids_b = self._b.encode([unit[unit.startswith(" ") :] for unit in units], num_threads=1)
        ids_b = [
            ids if unit.startswith(" ") or ids[:1] != [self._space] else ids[1:] for unit, ids in zip(units, ids_b, strict=True)
        ]
        a, b = stream(ids_a), stream(ids_b)
        whole = [unit.encode() for unit in units]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        joined = b"".join(whole)
        right = all(
            (sizes == _by_text(size[flat], counts)).all() and b"".join(map(table.__getitem__, flat.tolist())) == joined
            for (flat, counts), size, table in ((a, self.size_a, self.bytes_a), (b, self.size_b, self.bytes_b))
        )
        if right:
            return [a, b, (np.empty(0, np.int32), np.zeros(len(units), np.int64))]
        wrong = [
            b"".join(map(self.bytes_a.__getitem__, x)) != data or b"".join(map(self.bytes_b.__getitem__, y)) != data
            for x, y, data in zip(ids_a, ids_b, whole, strict=True)
        ]
        marked = [[[] if bad else ids for bad, ids in zip(wrong, side, strict=True)] for side in (ids_a, ids_b)]
        return [*map(stream, marked), stream([[1] if bad else [] for bad in wrong])]

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(ids a, counts a, ids b, counts b, whether the text has a wrong unit) of texts made of whole units."""
        units, many = _units(texts)
        (a, by_a), (b, by_b), (_, bad) = (
            spelled_out(found, units.indices.to_numpy()) for found in self._known.of(units.dictionary.to_pylist())
        )
        return a, _by_text(by_a, many), b, _by_text(by_b, many), _by_text(bad, many) > 0


def _units(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of all texts in a row, by name, and how many each text has.

    Where a text begins with a space and all other white space is one space or line break between two
    other signs, Arrow cuts it; other texts are cut by the pattern, which means the same.
    """
    plain = pc.invert(pc.match_substring_regex(texts, _WHITE_RUN))
    simple = pc.split_pattern(pc.replace_substring(pc.utf8_slice_codeunits(texts.filter(plain), 1), "\n", " \n"), " ")
    cut = simple.flatten().dictionary_encode()
    names = [unit if unit[:1] == "\n" else " " + unit for unit in cut.dictionary.to_pylist()]
    counts = np.zeros(len(texts), np.int64)
    is_plain = plain.to_numpy(zero_copy_only=False)
    counts[is_plain] = simple.value_lengths().to_numpy(zero_copy_only=False)
    if is_plain.all():
        return pa.DictionaryArray.from_arrays(cut.indices, pa.array(names, pa.string())), counts
    others = [_CUT.split(text) if text else [] for text in texts.filter(pc.invert(plain)).to_pylist()]
    counts[~is_plain] = list(map(len, others))
    more = pa.array([unit for units in others for unit in units], pa.string()).dictionary_encode()
    # both in the order of the texts
    place = np.empty(int(counts.sum()), np.int64)
    of_plain = np.repeat(is_plain, counts)
    place[of_plain] = cut.indices.to_numpy()
    place[~of_plain] = more.indices.to_numpy() + len(names)
    return pa.DictionaryArray.from_arrays(pa.array(place), pa.array(names + more.dictionary.to_pylist(), pa.string())), counts


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _by_text(counts: np.ndarray, many: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(many)])]
    return np.diff(ends)


def pair_type(size_a: int, size_b: int) -> str:
    return "int" if size_a * size_b < 1 << 31 else "long"


# ---------------------------------------------------------------- fragments

FRAGMENT = (
    "row long, key {key}, no int, bad boolean, n_a long, n_b long, n_groups long, n_links long, closed boolean, "
    "head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, body string, "
    "pairs array<{pair}>, uses array<int>"
)


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    stops = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(flat.astype(kind.to_pandas_dtype())))


def group_numbers(end_a: np.ndarray, end_b: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the number of bytes, before its own end, where tokens of both end."""
    at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    at_a[end_a], at_b[end_b] = True, True
    both = np.concatenate([[0], np.cumsum(at_a & at_b)])
    return both[end_a], both[end_b]


def group_texts(
    a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, owner: np.ndarray, rows: int, written_out: list[str]
) -> list[str]:
    """For each row its groups as ``a1,a2|b1;a3|b2,b3``; ``owner`` is the row of each group (numbers from 0).

    ``written_out`` has the ids after a comma, after a bar and after a semicolon.
    """
    of_a, of_b = np.bincount(group_a, minlength=len(owner)), np.bincount(group_b, minlength=len(owner))
    start = np.cumsum(of_a + of_b) - of_a - of_b
    place_a = np.arange(len(a)) - (np.cumsum(of_a) - of_a - start)[group_a]
    place_b = np.arange(len(b)) - (np.cumsum(of_b) - of_b - start - of_a)[group_b]
    codes = np.empty(len(a) + len(b), np.int64)
    codes[place_a], codes[place_b] = a, b
    ids = len(written_out) // 3
    codes[start[of_a > 0]] += 2 * ids
    codes[(start + of_a)[of_b > 0]] += ids
    parts = list(map(written_out.__getitem__, codes.tolist()))
    per_row = np.bincount(owner, weights=of_a + of_b, minlength=rows).astype(np.int64)
    stops = np.cumsum(per_row).tolist()
    return ["".join(parts[first:stop])[1:] for first, stop in zip([0, *stops], stops, strict=False)]


def link_counts(
    a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, owner: np.ndarray, rows: int, size_a: int, size_b: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, uses) of all rows in a row, pairs of a row sorted; the number of pairs and of links of each row."""
    groups = len(owner)
    of_a, of_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    start_b = np.cumsum(of_b) - of_b
    links = np.bincount(owner, weights=of_a * of_b, minlength=rows).astype(np.int64)
    large = of_a * of_b > MANY_LINKS
    plain = ~large[group_a]
    own, more = group_a[plain], of_b[group_a[plain]]
    keys = [np.repeat(a[plain].astype(np.int64), more) * size_b + taken(b, start_b[own], more)]
    owners = [np.repeat(owner[own], more)]
    span = size_a * size_b
    if not large.any() and rows < (1 << 62) // span:
        both = np.sort(owners[0] * span + keys[0])
        at = np.flatnonzero(np.diff(both, prepend=-1))
        return both[at] % span, np.diff(at, append=len(both)), np.bincount(both[at] // span, minlength=rows), links
    uses = [np.ones(len(keys[0]), np.int64)]
    for one in np.flatnonzero(large):
        ids_a, times_a = np.unique(a[group_a == one].astype(np.int64), return_counts=True)
        ids_b, times_b = np.unique(b[group_b == one].astype(np.int64), return_counts=True)
        keys.append((ids_a[:, None] * size_b + ids_b).ravel())
        uses.append((times_a[:, None] * times_b).ravel())
        owners.append(np.full(len(keys[-1]), owner[one]))
    key, own, use = np.concatenate(keys), np.concatenate(owners), np.concatenate(uses)
    order = np.lexsort((key, own))
    key, own, use = key[order], own[order], use[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(first)
    return key[at], np.add.reduceat(use, at) if len(at) else use, np.bincount(own[at], minlength=rows), links


def fragments(part: pa.RecordBatch, tokenizers: Pair) -> pa.RecordBatch:
    """Fragments of ranges: columns row, key, no, text (whole units), ``low`` and ``high`` (the range within its bytes)."""
    rows = part.num_rows
    a, count_a, b, count_b, bad = tokenizers.tokens(part.column("text"))
    row_a, row_b = np.repeat(np.arange(rows), count_a), np.repeat(np.arange(rows), count_b)
    if bad.any():  # such a text has no tokens
        sure_a, sure_b = ~bad[row_a], ~bad[row_b]
        a, row_a, b, row_b = a[sure_a], row_a[sure_a], b[sure_b], row_b[sure_b]
    no, low, high = (part.column(name).to_numpy() for name in ("no", "low", "high"))
    end_a, end_b = np.cumsum(tokenizers.size_a[a]), np.cumsum(tokenizers.size_b[b])
    stops = np.concatenate([[0], end_a])[np.cumsum(np.bincount(row_a, minlength=rows))]
    sizes = np.diff(stops, prepend=0)
    in_part = (no > 0) | (high < sizes)
    if in_part.any():
        base = stops - sizes
        own_a, own_b = (
            (end - base[row] > low[row]) & (end - base[row] <= high[row]) for end, row in ((end_a, row_a), (end_b, row_b))
        )
        a, row_a, end_a, b, row_b, end_b = a[own_a], row_a[own_a], end_a[own_a], b[own_b], row_b[own_b], end_b[own_b]
    group_a, group_b = group_numbers(end_a, end_b, int(stops[-1]) if rows else 0)
    closed, inner = np.ones(rows, bool), None
    if in_part.any():
        group_a, group_b, owner, closed, is_head, is_tail = _open_ends(row_a, group_a, end_a, row_b, group_b, end_b, no)
        inner = ~is_head & ~is_tail
    else:
        owner = row_a[np.flatnonzero(np.diff(group_a, prepend=-1))]

    def some(kind: np.ndarray | None) -> list[pa.ListArray]:
        if kind is None:
            return [_lists(np.empty(0, np.int32), np.zeros(rows, np.int64), pa.int32())] * 2
        return [
            _lists(ids[kind[group]], np.bincount(row[kind[group]], minlength=rows), pa.int32())
            for ids, group, row in ((a, group_a, row_a), (b, group_b, row_b))
        ]

    ends = some(None) * 2 if inner is None else some(is_head) + some(is_tail)
    groups = (a, group_a, b, group_b, owner, rows)
    if inner is not None:
        renamed = np.cumsum(inner) - 1
        in_a, in_b = inner[group_a], inner[group_b]
        groups = (a[in_a], renamed[group_a[in_a]], b[in_b], renamed[group_b[in_b]], owner[inner], rows)
    sizes_of = (len(tokenizers.size_a), len(tokenizers.size_b))
    pairs, uses, per_row, links = link_counts(*groups, *sizes_of)
    kind = pa.int32() if pair_type(*sizes_of) == "int" else pa.int64()
    counted = [np.bincount(row, minlength=rows).astype(np.int64) for row in (row_a, row_b, groups[4])]
    columns = {
        "row": part.column("row"), "key": part.column("key"), "no": part.column("no"), "bad": pa.array(bad),
        "n_a": pa.array(counted[0]), "n_b": pa.array(counted[1]), "n_groups": pa.array(counted[2]), "n_links": pa.array(links),
        "closed": pa.array(closed), **dict(zip(("head_a", "head_b", "tail_a", "tail_b"), ends, strict=True)),
        "body": pa.array(group_texts(*groups, tokenizers.written), pa.string()),
        "pairs": _lists(pairs, per_row, kind), "uses": _lists(uses, per_row, pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _open_ends(row_a, group_a, end_a, row_b, group_b, end_b, no) -> tuple[np.ndarray, ...]:
    """Groups of ranges, some of which are open: numbers by token, owners, whether a range has a byte where both end, heads, tails."""
    # a group is named by row and number, as an open end has the number of the next row's first group
    width = int(max(group_a.max(initial=0), group_b.max(initial=0))) + 1
    names, at = np.unique(np.concatenate([row_a * width + group_a, row_b * width + group_b]), return_inverse=True)
    group_a, group_b = at[: len(group_a)], at[len(group_a) :]
    owner = names // width
    last_a, last_b = np.full(len(names), -1), np.full(len(names), -2)
    np.maximum.at(last_a, group_a, end_a)
    np.maximum.at(last_b, group_b, end_b)
    is_closed = last_a == last_b
    first_closed = np.full(len(no), -1)
    places = np.flatnonzero(is_closed)[::-1]
    first_closed[owner[places]] = places
    closed = (first_closed >= 0) | (no == 0)
    is_head = ~closed[owner] | ((np.arange(len(names)) == first_closed[owner]) & (no[owner] > 0))
    return group_a, group_b, owner, closed, is_head, ~is_closed & closed[owner]


def ranges(text: str, size: int) -> Iterator[tuple[int, str, int, int]]:
    """(no, text of whole units, low, high) of the ranges of a long text, a space put before it.

    ``low`` and ``high`` bound the range within the bytes of that text. A range with no unit border
    in or right after it is joined to the next.
    """
    data = (" " + text).encode()
    borders = np.array([0, *(found.start() for found in _CUT_BYTES.finditer(data)), len(data)])
    no, low = 0, 0
    while low < len(data):
        high = min(low + size, len(data))
        left = int(borders[np.searchsorted(borders, low, side="right") - 1])
        right = int(borders[np.searchsorted(borders, high, side="left")])
        if right - high > size:  # a long unit: it is read once
            high = right
        if len(data) - high <= 0:
            high = right = len(data)
        yield no, data[left:right].decode(), low - left, high - left
        no, low = no + 1, high


# ---------------------------------------------------------------- tree of open ends

NODE = "row long, node int, at int, seam boolean, closed boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>"


def composed(nodes: list[dict]) -> tuple[dict, list[dict]]:
    """Neighbouring fragments as one, and the groups that closed between them.

    A node has closed (whether it has a byte where both end), heads, tails, and ``at``, the number of its first
    fragment with such a byte, which the group that its head closes stands before. Without
    such a byte all its tokens are head.
    """
    total, seams = dict(nodes[0]), []
    for right in nodes[1:]:
        if not total["closed"]:
            total = {**right, "head_a": total["head_a"] + right["head_a"], "head_b": total["head_b"] + right["head_b"]}
            continue
        open_a, open_b = total["tail_a"] + right["head_a"], total["tail_b"] + right["head_b"]
        if right["closed"]:
            seams.append({"at": right["at"], "head_a": open_a, "head_b": open_b})
            open_a, open_b = right["tail_a"], right["tail_b"]
        total = {**total, "tail_a": open_a, "tail_b": open_b}
    return total, seams


def _compose(table: pa.Table) -> pa.Table:
    """One parent of the tree from its children (at most ``FAN``), which have the columns of ``NODE`` and ``parent``."""
    children = sorted(table.to_pylist(), key=lambda child: child["node"])
    total, seams = composed(children)
    nothing = {"seam": True, "closed": True, "tail_a": [], "tail_b": []}
    found = [{**total, "seam": False}, *[{**nothing, **seam} for seam in seams]]
    named = [{"row": children[0]["row"], "node": children[0]["parent"]} for _ in found]
    names = [name for name in table.column_names if name != "parent"]
    return pa.Table.from_pylist([{**one, **name} for one, name in zip(found, named, strict=True)], schema=table.select(names).schema)


def seam_groups(found: DataFrame, fan: int = FAN) -> DataFrame:
    """Groups that close between fragments: row, at, head_a, head_b; ``found`` is a written table of fragments.

    Each round puts ``fan`` neighbours together, so that a text of n fragments takes log n rounds;
    a node holds open ends only, no closed groups.
    """
    nodes = found.select(
        "row", F.col("no").alias("node"), F.col("no").alias("at"), F.lit(False).alias("seam"), "closed", "head_a", "head_b", "tail_a", "tail_b"
    )
    last = found.agg(F.max("no")).first()[0] or 0
    rounds, seams = [], []
    while last:
        parent = F.floor(F.col("node") / F.lit(fan)).cast("int")
        both = written(nodes.withColumn("parent", parent).groupBy("row", "parent").applyInArrow(_compose, NODE))
        rounds.append(both)
        seams.append(both.where("seam").select("row", "at", "head_a", "head_b"))
        nodes, last = both.where("NOT seam"), last // fan
    if not seams:
        return found.select("row", F.col("no").alias("at"), "head_a", "head_b").where("false")
    result = seams[0]
    for more in seams[1:]:
        result = result.unionByName(more)
    kept = written(result)
    release(*rounds)
    return kept


def _seam_parts(batches: Iterator[pa.RecordBatch], tokenizers: Pair, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("head_a"), batch.column("head_b")
        rows = batch.num_rows
        ids = [side.flatten().to_numpy() for side in (a, b)]
        group = [np.repeat(np.arange(rows), side.value_lengths().to_numpy()) for side in (a, b)]
        groups = (ids[0], group[0], ids[1], group[1], np.arange(rows), rows)
        pairs, uses, per_row, links = link_counts(*groups, len(tokenizers.size_a), len(tokenizers.size_b))
        arrays = [batch.column("row"), batch.column("at"), pa.array(links), pa.array(group_texts(*groups, tokenizers.written), pa.string())]
        arrays += [_lists(pairs, per_row, kind), _lists(uses, per_row, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "at", "n_links", "body", "pairs", "uses"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the groups of each row, whose parts come in order: nothing of a text is held but the hash's state."""
    row, digest, empty = None, None, True

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([digest.hexdigest()])], names=["row", "groups_sha256"])

    for batch in batches:
        for one, body in zip(batch.column("row").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if one != row:
                if row is not None:
                    yield done()
                row, digest, empty = one, hashlib.sha256(), True
            if body:
                digest.update(body.encode() if empty else b";" + body.encode())
                empty = False
    if row is not None:
        yield done()


# ---------------------------------------------------------------- documents

DOC_COLUMNS = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


class Alignment:
    """Documents aligned: ``docs`` (row, key, n_a, n_b, n_groups, n_links, groups_sha256) and ``links`` (row, pair, uses).

    ``row`` numbers the rows of the input; ``pair`` is the id of A times ``size_b`` plus the id of B.
    """

    def __init__(self, docs: DataFrame, links: DataFrame, size_b: int, tables: list[DataFrame]):
        self.docs, self.links, self.size_b, self._tables = docs, links, size_b, tables

    def release(self) -> None:
        release(*self._tables)


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE) -> Alignment:
    """Align each text's tokens by A (of a space and the text) with those by B (of the text).

    Null and empty texts, and those whose joined tokens do not give the space and text back
    (a literal U+2581), have no tokens: zeros, and an empty ``groups_sha256``. Special tokens' strings
    are plain text. Repeated rows and null keys are rows of their own.
    """
    loaded = pair(path_a, path_b)
    size_a, size_b = len(loaded.size_a), len(loaded.size_b)
    kind = pair_type(size_a, size_b)
    arrow_kind = pa.int32() if kind == "int" else pa.int64()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), text_or_empty(f"`{text}`").alias("text")
    )
    key_type = rows.schema["key"].dataType.simpleString()
    schema = FRAGMENT.format(key=key_type, pair=kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, chars=BATCH):
                yield fragments(part, pair(path_a, path_b))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, whole in enumerate(batch.column("text").to_pylist()):
                for no, own, low, high in ranges(whole, range_bytes):
                    one = [batch.column("row").slice(at, 1), batch.column("key").slice(at, 1), pa.array([no], pa.int32()), pa.array([own])]
                    one += [pa.array([low], pa.int64()), pa.array([high], pa.int64())]
                    yield pa.RecordBatch.from_arrays(one, names=["row", "key", "no", "text", "low", "high"])

    one_range = F.octet_length("text") < range_bytes
    whole = F.when(F.length("text") > 0, F.concat(F.lit(" "), "text")).otherwise("")
    short = rows.where(one_range).select(
        "row", "key", F.lit(0).alias("no"), whole.alias("text"), F.lit(0).cast("long").alias("low"), F.lit(1 << 62).alias("high")
    )
    digest = F.when(F.col("n_groups") > 0, F.sha2("body", 256)).otherwise("").alias("groups_sha256")
    ready = written(short.mapInArrow(read, schema).select(*DOC_COLUMNS[:-1], digest, "pairs", "uses"))

    # ranges of one text are dealt over the tasks
    parts = rows.where(~one_range).mapInArrow(cut, f"row long, key {key_type}, no int, text string, low long, high long")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(parts.repartition(tasks, "row", "no").mapInArrow(read, schema))
    bad = found.where("bad").select("row").distinct()
    good = found.join(bad, "row", "left_anti")
    seams = seam_groups(found)
    seam_schema = f"row long, at int, n_links long, body string, pairs array<{kind}>, uses array<int>"
    closed = written(seams.mapInArrow(lambda batches: _seam_parts(batches, pair(path_a, path_b), arrow_kind), seam_schema).join(bad, "row", "left_anti"))
    release(seams)
    places = good.select("row", F.col("no").alias("at"), F.lit(1).alias("side"), "body").unionByName(
        closed.select("row", "at", F.lit(0).alias("side"), "body")
    )
    hashed = places.repartition("row").sortWithinPartitions("row", "at", "side").drop("at", "side")
    hashed = hashed.mapInArrow(_digests, "row long, groups_sha256 string")
    zero = F.lit(0).cast("long")
    counts = good.select("row", "n_a", "n_b", "n_groups", "n_links").unionByName(
        closed.select("row", zero.alias("n_a"), zero.alias("n_b"), F.lit(1).cast("long").alias("n_groups"), "n_links")
    )
    summed = counts.groupBy("row").agg(*[F.sum(name).alias(name) for name in DOC_COLUMNS[2:6]])
    every = found.where("no = 0").select("row", "key")
    long = every.join(summed, "row", "left").join(hashed, "row", "left").na.fill(0, DOC_COLUMNS[2:6]).na.fill("", ["groups_sha256"])
    long = written(long.select((-F.col("row") - 1).alias("row"), *DOC_COLUMNS[1:]))
    long_links = good.select("row", "pairs", "uses").unionByName(closed.select("row", "pairs", "uses"))
    long_links = _exploded(long_links).groupBy("row", "pair").agg(F.sum("uses").alias("uses"))
    long_links = written(long_links.select((-F.col("row") - 1).alias("row"), "pair", "uses"))
    release(found, closed)
    links = _exploded(ready).unionByName(long_links)
    return Alignment(ready.select(*DOC_COLUMNS).unionByName(long), links, size_b, [ready, long, long_links])


def _exploded(rows: DataFrame) -> DataFrame:
    one = rows.select("row", F.inline(F.arrays_zip("pairs", "uses")).alias("pair", "uses"))
    return one.select("row", "pair", F.col("uses").cast("long").alias("uses"))


def link_table(found: Alignment) -> DataFrame:
    """The corpus's links: pair, a, b, documents, best (whether no other pair of the same ``a`` is in more documents).

    ``documents`` counts the rows that hold the pair linked. Written; release it when it is read no more.
    """
    counted = written(found.links.groupBy("pair").agg(F.count("*").alias("documents")))
    a = F.floor(F.col("pair") / F.lit(found.size_b)).cast("int")
    counted_a = counted.select("pair", a.alias("a"), (F.col("pair") % F.lit(found.size_b)).cast("int").alias("b"), "documents")
    # one row an id of A: bounded by its vocabulary
    most = counted_a.groupBy("a").agg(F.max("documents").alias("_most"))
    table = written(counted_a.join(F.broadcast(most), "a").select("pair", "a", "b", "documents", (F.col("documents") == F.col("_most")).alias("best")))
    release(counted)
    return table


def scored(found: Alignment, table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of the documents: row, key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``count_sum`` adds up ``documents`` over the row's links, ``n_best`` counts those that are best
    for their id of A. The most frequent pairs, at most ``most``, are broadcast, which leaves few
    links to be shuffled to the others.
    """
    lookup = table.select("pair", "documents", F.col("best").cast("long").alias("best"))
    cut = 0 if fits_broadcast(lookup, rows=most) else _threshold(table, most)
    frequent = lookup.where(F.col("documents") >= cut)
    sums = [F.sum(F.col("uses") * F.col("best")).alias("n_best"), F.sum(F.col("uses") * F.col("documents")).alias("count_sum")]
    by_row = found.links.join(F.broadcast(frequent), "pair").groupBy("row").agg(*sums)
    if cut:
        rare = found.links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(lookup.where(F.col("documents") < cut), "pair")
        by_row = by_row.unionByName(rare.groupBy("row").agg(*sums)).groupBy("row").agg(
            *[F.sum(name).alias(name) for name in ("n_best", "count_sum")]
        )
    return found.docs.join(by_row, "row", "left").na.fill(0, ["n_best", "count_sum"]).select(
        *DOC_COLUMNS[:6], "n_best", "count_sum", "groups_sha256"
    )


def _threshold(table: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` pairs are in as many documents."""
    level = F.floor(F.log2(F.col("documents").cast("double"))).cast("int")
    at_level = {row["level"]: row["n"] for row in table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    cut = 63
    while cut and sum(n for found, n in at_level.items() if found >= cut - 1) <= most:
        cut -= 1
    return 1 << cut
