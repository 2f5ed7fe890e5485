"""Near-duplicates against brute force over full shingle sets."""

import random

import numpy as np
import pytest

from corpusflow.llm import common, near_dedup
from corpusflow.llm.components import components


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) >= width:
        return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows, width):
    """Component per row, by comparing every pair of texts."""
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc_id)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[root(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def check(spark, rows, width):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows],
                               "doc_id long, text string, node string, class_id string, signature string")
    got = near_dedup.near_duplicates(df, width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(
        brute(rows, width), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return got


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\ttwo"), (8, "É one"),
            (9, "é one"), (10, "a b c d e f"), (None, "a b c d e f"), (None, "lonely text of none"),
            (None, "lonely text of none"), (4, "one"), (12, "a\xa0b"), (13, "a b"), (None, None)]
    for width in (1, 2, 5):
        check(spark, rows, width)


def test_group_of_variants_and_chain(spark, words):
    rng = random.Random(2)
    base = words[:150]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 260):  # near copies with up to a fifth of the words changed
        text = list(base)
        for _ in range(rng.randrange(0, 22)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    for i in range(300, 330):  # a chain: only neighbours are alike
        rows.append((i, " ".join(words[200 + 8 * (i - 300):360 + 8 * (i - 300)])))
    rng.shuffle(rows)
    got = check(spark, rows, 2)
    assert len({r.component_id for r in got if r.doc_id >= 300}) == 1


def test_open_buckets_are_compared_in_blocks(spark, words, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = random.Random(9)
    rows, n = [], 0
    for family in range(12):
        base = words[family * 120:family * 120 + 100]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(0, 16)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    check(spark, rows, 2)


def test_one_document_of_a_group_stays(spark):
    df = spark.createDataFrame(
        [(3, "a b c d e f", "en", "s", 11), (1, "A B C D E F", "en", "s", 11), (2, "other words", None, None, None),
         (5, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = near_dedup.deduplicated(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 5]


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def variants(words, n):
    """A long text and texts near to it."""
    text = words[n:n + 100]
    return [" ".join(text), " ".join(text[:-1] + ["changed"]), " ".join(["changed"] + text[1:])]


def test_two_texts_of_one_doc_id(spark, words):
    a, near_a, other_a = variants(words, 0)
    b, near_b, _ = variants(words, 200)
    rows = [(5, a), (5, b), (9, near_a), (11, near_b), (2, other_a)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENT)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(2, 2, True), (5, 2, False), (5, 5, True), (9, 2, False), (11, 5, False)]
    assert sorted((r.doc_id, r.text) for r in near_dedup.deduplicated(df).collect()) == [(2, other_a), (5, b)]


def test_every_group_keeps_exactly_one_row(spark, words):
    a, near_a, _ = variants(words, 0)
    b, near_b, _ = variants(words, 200)
    c, near_c, _ = variants(words, 400)
    rows = [(5, a), (5, a), (5, near_a), (3, b), (5, near_b), (None, c), (None, near_c), (None, c), (7, " "), (7, " "), (8, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENT)
    got = [(r.doc_id, r.text) for r in near_dedup.deduplicated(df).collect()]
    assert sum(t in (a, near_a) for _, t in got) == 1 and (3, b) in got and (5, near_b) not in got
    assert sum(t in (c, near_c) for _, t in got) == 1
    assert sorted(i for i, t in got if not t or not t.split()) == [7, 7, 8] and len(got) == 6


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_follow_words():
    texts = ["a b", "b a", "", "c", "x" * 70_000 + " b", " b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    hashes, begin = common.word_hashes(data, offsets)
    words = [w for t in texts for w in t.split()]
    assert len(hashes) == len(words)
    for a in range(len(words)):
        for b in range(len(words)):
            assert (hashes[a] == hashes[b]) == (words[a] == words[b])


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x
    for u, v in links:
        a, b = root(u), root(v)
        label[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links + [(None, 5)], "u long, v long")).collect()
    expected = {x: root(x) for x in label if any(x in e and e[0] != e[1] for e in links)}
    assert {r.node: r.component for r in got} == expected and len(got) == len(expected)
