import random
import re

import xxhash

from parlance.llm import fuzzy_lines


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words_of(line):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", re.sub("[0-9]", "0", line.lower())).encode().split()


def fingerprint(words):
    hashes = []
    for at, word in enumerate(words):
        value = xxhash.xxh64_intdigest(word) + words[:at].count(word) * 0xD6E8FEB86659FD93
        value = value * 0xA0761D6478BD642F % 2**64
        hashes.append(value ^ value >> 32)
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(docs):
    """Removed lines by document: every pair of different lines is compared."""
    places = {}
    for key, text in docs:
        for number, line in enumerate((text or "").split("\n")):
            words = words_of(line)
            if len(words) >= fuzzy_lines.LEAST_WORDS:
                places.setdefault(b" ".join(words).decode(), set()).add((fuzzy_lines.LAST_KEY if key is None else key, number))
    lines = list(places)
    prints = [fingerprint(line.encode().split()) for line in lines]
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= fuzzy_lines.MOST_BITS and label[i] != label[j]:
                if table_distance(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9:
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label]
    removed = {}
    for g in set(label):
        group = sorted(place for line, x in zip(lines, label) if x == g for place in places[line])
        for key, number in group[1:]:
            removed.setdefault(key, []).append((number, *group[0]))
    return {key: sorted(found) for key, found in removed.items()}


def report(docs):
    return {r.doc: [tuple(x) for x in r.removed] for r in fuzzy_lines.repeated_lines(docs).collect()}


def variants(seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9))) for _ in range(150)]
    bases = [[draw.choice(words) for _ in range(draw.randrange(6, 60))] for _ in range(12)]
    docs = []
    for key in range(60):
        lines = []
        for _ in range(draw.randrange(1, 6)):
            line = list(draw.choice(bases))
            for _ in range(draw.choice([0, 0, 1, 1, 2])):
                line[draw.randrange(len(line))] = draw.choice(words)
            lines.append(draw.choice([" ".join(line), " ".join(line).upper() + ".", "  ".join(line), " ".join(draw.choice(words) for _ in range(4))]))
        docs.append((key * 5 % 61, "\n".join(lines)))
    return docs


def test_variants_by_brute_force(spark):
    docs = variants()
    found = report(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    expected = brute(docs)
    assert expected and found == expected


def test_documents_by_brute_force(documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert report(documents) == brute(docs)


def test_lists_and_groups_that_are_cut(spark, monkeypatch):
    cut = fuzzy_lines.linked
    monkeypatch.setattr(fuzzy_lines, "linked", lambda *args: cut(*args, chunk=3))
    docs = variants(2)
    assert report(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_distance():
    draw = random.Random(0)
    for _ in range(300):
        a, b = ("".join(draw.choice("abcé") for _ in range(draw.randrange(12))) for _ in range(2))
        assert fuzzy_lines.distance(a, b) == table_distance(a, b)
        for least in (0.5, 0.8):
            assert fuzzy_lines.alike(a, b, least) == (table_distance(a, b) <= (1 - least) * max(len(a), len(b)) + 1e-9)


def test_texts_without_their_repeats(spark):
    first = "this line is about a thing\nshort one\nthat line is on 1999 things"
    rows = [(1, first, 9), (2, "That line is on 2024 things!\nshort one\nnew words in a new line", 9), (3, "This line is about a thing.", 9), (4, "short one", 9), (5, None, 9), (6, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = {r.doc_id: r.text for r in fuzzy_lines.without_repeats(docs).collect()}
    assert found == {1: first, 2: "short one\nnew words in a new line", 4: "short one", 5: None, 6: ""}
    lines = {r.doc_id: (r.n_lines, r.n_removed, [tuple(x) for x in r.removed]) for r in fuzzy_lines.line_report(docs).collect()}
    assert lines == {1: (3, 0, []), 2: (3, 1, [(0, 1, 2)]), 3: (1, 1, [(0, 1, 0)]), 4: (1, 0, []), 5: (0, 0, []), 6: (1, 0, [])}


def test_awkward(awkward, nothing):
    rows = fuzzy_lines.line_report(awkward).collect()
    assert len(rows) == awkward.count()
    by_key = {r.doc_id: [tuple(x) for x in r.removed] for r in rows}
    # the same text under key 1, 5 and null: the smallest key keeps its lines, null is last
    assert by_key[1] == [] and by_key[5] == by_key[None] == [(0, 1, 0), (1, 1, 1)]
    left = fuzzy_lines.without_repeats(awkward)
    assert left.columns == awkward.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 2, 3, 3, 4, 6, 7, 8, 9], key=str)
    assert fuzzy_lines.line_report(nothing).collect() == [] and fuzzy_lines.without_repeats(nothing).collect() == []
