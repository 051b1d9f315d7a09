"""Alignment of two tokenizers against a plain restatement over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parlance.llm import alignment, queries
from parlance.llm.units import byte_signs

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    signs = {char: byte for byte, char in byte_signs().items()}

    def tokens(text):
        """[(id, bytes)] by A and by B, or nothing."""
        if not text:
            return [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        by_a = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in ids_a]
        by_b = []
        for i in ids_b:
            piece = b.id_to_piece(i)
            by_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if any(b"".join(data for _, data in side) != whole for side in (by_a, by_b)):
            return [], []
        return by_a, by_b

    def groups(text):
        by_a, by_b = tokens(text)
        ends = []
        for side in (by_a, by_b):
            at, found = 0, []
            for i, data in side:
                at += len(data)
                found.append((at, i))
            ends.append(found)
        both = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        result, start = [], 0
        for end in both:
            result.append(tuple([i for e, i in side if start < e <= end] for side in ends))
            start = end
        return result

    return groups


def expected(plain, docs):
    """doc_id, counts and digest of each (doc_id, text), by brute force."""
    found = [(key, plain(text)) for key, text in docs]
    links = [Counter((x, y) for one in groups for x in one[0] for y in one[1]) for _, groups in found]
    held = Counter(pair for counted in links for pair in counted)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    result = []
    for (key, groups), counted in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        n_best = sum(n for pair, n in counted.items() if held[pair] == best[pair[0]])
        total = sum(n * held[pair] for pair, n in counted.items())
        sizes = [sum(len(one[side]) for one in groups) for side in (0, 1)]
        result.append((key, *sizes, len(groups), sum(counted.values()), n_best, total, digest))
    return sorted(result, key=str)


def result_of(found, most=None):
    table = alignment.link_table(found)
    rows = alignment.scored(found, table, *([] if most is None else [most]))
    columns = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(row) for row in rows.select(*columns).collect()), key=str)


TRICKY = [
    "", " ", "  two  spaces ", "a\nb\n\nc \n d", "▁ sign", "<|endoftext|> and <s>", "don't we'll", "日本語のテキスト。", "é́ ́x",
    "tab\tand\x1cfs and nbsp 　wide", "x" * 500, "ab" * 300, "😀😃 👩‍👩‍👧", "\nstart", "end\n", "1234567 3.14 1,000", "\u0000 nul \x00", "A  B\n C",
]


def test_query_equals_brute_force(spark, plain, documents):
    docs = [(row["doc_id"], row["text"]) for row in documents.collect()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = queries.op12_token_alignment(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted((tuple(row) for row in rows), key=str) == expected(plain, docs)


@pytest.mark.parametrize("size", [7, 40, 300, alignment.RANGE])
def test_any_range_gives_the_same_result(spark, plain, size):
    draw = random.Random(size)
    docs = [(at, text) for at, text in enumerate(TRICKY)]
    for at in range(100, 112):
        words = ["".join(draw.choice("abcdéł日.,'-") for _ in range(draw.randint(1, 9))) for _ in range(60)]
        docs.append((at, "".join(word + draw.choice([" ", " ", " ", "\n", "  ", "\t"]) for word in words)))
    docs += [(200, "x" * 40 + " some words then " + "y" * 700 + " end"), (201, None), (201, "twice"), (None, "no id"), (201, "twice")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = alignment.aligned(frame, *PATHS, range_bytes=size)
    assert result_of(found) == expected(plain, docs)


def test_rare_pairs_are_shuffled_to_the_same_result(spark, plain, documents):
    docs = [(row["doc_id"], row["text"]) for row in documents.limit(40).collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = alignment.aligned(frame, *PATHS)
    assert result_of(found, most=200) == expected(plain, docs)


def test_composition_is_associative():
    draw = random.Random(3)
    nodes = []
    for at in range(30):
        tokens = [[draw.randrange(9) for _ in range(draw.randint(1, 3))] for _ in range(4)]
        closed = at == 0 or draw.random() < 0.6
        heads = [[], []] if at == 0 else tokens[:2]
        nodes.append({"at": at, "closed": closed, "head_a": heads[0], "head_b": heads[1], "tail_a": tokens[2] if closed else [], "tail_b": tokens[3] if closed else []})
    whole, seams = alignment.composed(nodes)
    for cut in range(1, 30):
        left, first = alignment.composed(nodes[:cut])
        right, second = alignment.composed(nodes[cut:])
        both, between = alignment.composed([left, right])
        assert both == whole
        assert sorted([*first, *second, *between], key=lambda one: one["at"]) == seams


def test_many_links_in_one_group(spark, monkeypatch, plain):
    monkeypatch.setattr(alignment, "MANY_LINKS", 2)
    tokenizers = alignment.pair(*PATHS)
    import pyarrow as pa

    texts = [" " + "antidisestablishmentarianism " * 5, " " + "日本語" * 20]
    part = pa.RecordBatch.from_pydict(
        {"row": [0, 1], "key": [0, 1], "no": pa.array([0, 0], pa.int32()), "text": texts, "low": [0, 0], "high": [1 << 62] * 2}
    )
    found = alignment.fragments(part, tokenizers).to_pylist()
    for row, text in zip(found, texts, strict=True):
        links = Counter(x * 32000 + y for one in plain(text[1:]) for x in one[0] for y in one[1])
        assert dict(zip(row["pairs"], row["uses"], strict=True)) == dict(links)


def test_awkward_rows_and_no_rows(spark, awkward, nothing, plain):
    docs = [(row["doc_id"], row["text"]) for row in awkward.select("doc_id", "text").collect()]
    assert result_of(alignment.aligned(awkward, *PATHS, range_bytes=100)) == expected(plain, docs)
    assert result_of(alignment.aligned(nothing, *PATHS)) == []
