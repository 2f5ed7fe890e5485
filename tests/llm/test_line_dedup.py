"""Line dedup: what has to go, what has to stay."""

import random
import time

import pytest

from corpusflow.llm import line_dedup

P = "this passage of ten words stands in many a document"
Q = "another passage that has nine words stands here too"


def run(spark, rows, least=8):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows],
                               "doc_id long, text string, pos string, lines string, h string")
    return {(r.doc_id, i): r for i, r in enumerate(line_dedup.dedup_lines(df, least).collect())}.values()


def test_texts(spark):
    rows = [(1, f"one\n{P}\ntwo"), (2, f"three\n{P}\n\nfour"), (3, f"{P}\n{Q}"), (4, f"x\n{Q}\n{P}\ny"), (5, None),
            (6, ""), (7, "a b\nc d"), (8, "a b\nc d"), (9, "same short"), (10, "same short"), (None, f"z\n{P}"),
            (11, f"{P}\nmiddle\n{P}")]
    got = {r.doc_id: r for r in run(spark, rows)}
    assert got[1].text == f"one\n{P}\ntwo" and got[1].n_removed_lines == 0
    assert got[2].text == "three\n\nfour" and got[2].n_removed_words == 10 and got[2].n_lines == 4
    assert got[3].text == Q
    assert got[4].text == "x\ny"
    assert got[5].text is None and got[5].n_lines == 0
    assert got[6].text == "" and got[6].n_lines == 1
    assert got[8].text == "a b\nc d" and got[10].text == "same short"
    assert got[None].text == "z"
    assert got[11].text == "middle"


def test_short_lines_go_as_a_block(spark):
    block = "one two three\nfour five six\nseven eight nine"
    got = {r.doc_id: r.text for r in run(spark, [(1, f"a\n{block}\nb"), (2, f"c\n{block}\nd"), (3, "four five six\ne")])}
    assert got == {1: f"a\n{block}\nb", 2: "c\nd", 3: "four five six\ne"}


def test_repeated_rows_are_one_document(spark):
    got = list(run(spark, [(1, P), (1, P), (2, P), (2, P)]))
    assert sorted((r.doc_id, r.text) for r in got) == [(1, P), (1, P), (2, ""), (2, "")]


@pytest.mark.parametrize("seed", range(3))
def test_every_long_line_keeps_its_first_holder_only(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 16))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < .6 else f"own {i} {k}" for k in range(12)))
            for i in range(60)]
    first = {}
    for i, text in rows:
        for line in text.split("\n"):
            first.setdefault(line, i)
    for r in run(spark, rows):
        text = dict(rows)[r.doc_id].split("\n")
        left = r.text.split("\n")
        for line in set(text):
            if first[line] == r.doc_id:
                assert left.count(line) == text.count(line)
            elif len(line.split()) >= 8:
                assert line not in left
        assert r.n_removed_lines == len(text) - (len(left) if r.text or r.n_removed_lines < len(text) else 0)


def test_patience_anchors():
    assert line_dedup.anchors([1, 2, 3, 4], [1, 3, 2, 4]) in ([(0, 0), (1, 2), (3, 3)], [(0, 0), (2, 1), (3, 3)])
    assert line_dedup.anchors([1, 1], [1, 1]) == []
    many = [(i, 5, 9) for i in range(3000)]
    assert len(line_dedup.deleted(many[:1], many, 8)) == 3000


def test_pipeline_form_drops_emptied_documents(spark):
    df = spark.createDataFrame([(1, P, "en", None, 5), (2, P, "en", "s", 5), (3, "", "en", "s", 0)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    got = line_dedup.cleaned(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.n_chars) for r in got.collect()) == [(1, len(P)), (3, 0)]


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def common_runs(first, later, least):
    """Places of the later list of (hash, words) that lie in a run of ``least`` words which the first has too."""
    places = set()
    for i in range(len(later)):
        for j in range(i + 1, len(later) + 1):
            run = later[i:j]
            if sum(w for _, w in run) >= least and any(first[k:k + j - i] == run for k in range(len(first) - (j - i) + 1)):
                places |= set(range(i, j))
    return places


def test_lines_with_earlier_single_holders_go_as_a_block(spark):
    block = ["one two three", "four five six", "seven eight nine"]
    rows = [(n, f"{line}\nown {n}") for n, line in enumerate(block, 1)]
    rows += [(4, "\n".join(["d", *block, "e"])), (5, "\n".join(["f", *block, "g"]))]
    got = {r.doc_id: r.text for r in run(spark, rows)}
    assert got == dict(rows) | {5: "f\ng"}


@pytest.mark.parametrize("seed", range(3))
def test_no_block_of_any_earlier_document_stays(spark, seed):
    rng = random.Random(seed)
    short = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 8))) for _ in range(40)]
    blocks = [[rng.choice(short) for _ in range(rng.randrange(2, 6))] for _ in range(15)]
    rows = [(n, line) for n, line in enumerate(short)]
    for n in range(len(short), 100):
        parts = [rng.choice(blocks) if rng.random() < .5 else [f"own {n} {k}"] for k in range(5)]
        rows.append((n, "\n".join(line for part in parts for line in part)))
    listed = {n: [(line, len(line.split())) for line in text.split("\n")] for n, text in rows}
    lost = 0
    for r in run(spark, rows):
        must = set().union(*(common_runs(listed[e], listed[r.doc_id], 8) for e in range(r.doc_id)))
        left = [line for k, (line, _) in enumerate(listed[r.doc_id]) if k not in must]
        kept = iter(left)
        assert all(line in kept for line in (r.text.split("\n") if r.text else [])), r.doc_id
        lost += len(must)
    assert lost > 50


def test_blocks_that_the_alignment_cuts():
    first = [(0, 1, 1), (1, 2, 4), (2, 2, 4), (3, 3, 4)]
    assert sorted(line_dedup.deleted(first, [(0, 1, 1), (1, 2, 4), (2, 3, 4)], 8)) == [1, 2]


@pytest.mark.parametrize("gap", ["\n\n", "\n \t\n\n"])
def test_lines_without_words_do_not_part_a_block(spark, gap):
    verses = [f"verse {n} of song" for n in range(15)]
    rows = [(1, "\n".join(verses)), (2, "a\n" + gap.join(verses) + "\nb"), (3, gap.join(verses[:2])),
            (4, gap.join(verses[:1])), (5, f"{verses[3]}\nown line\n{verses[4]}")]
    got = {r.doc_id: r for r in run(spark, rows)}
    assert got[1].text == rows[0][1]
    assert got[2].text.split() == ["a", "b"] and got[2].n_removed_lines == 15 and got[2].n_removed_words == 60
    assert not got[3].text.split() and got[3].n_removed_words == 8
    assert [got[n].text for n in (4, 5)] == [text for n, text in rows if n in (4, 5)]


def brute(texts, least=8):
    """What is left of each document, by all common runs of worded lines with any earlier one."""
    worded = [[(k, line, len(line.split())) for k, line in enumerate(t.split("\n")) if line.split()] for t in texts]
    out = []
    for n, text in enumerate(texts):
        later = [(line, w) for _, line, w in worded[n]]
        gone = set().union(*(common_runs([(line, w) for _, line, w in worded[e]], later, least) for e in range(n)))
        lines = {worded[n][k][0] for k in gone}
        out.append("\n".join(line for k, line in enumerate(text.split("\n")) if k not in lines))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_exactly_the_common_blocks_go(spark, seed):
    """Both ways, with few different lines, so that documents repeat them in any order."""
    rng = random.Random(seed)
    pool = [" ".join("abc"[seed % 3] * (k + 1) for k in range(n)) for n in (1, 2, 3, 3, 4, 5, 9)] + ["x y z", "p q r s", "  "]
    texts = ["\n".join(rng.choice(pool) if rng.random() < .8 else f"own {n} {k}" for k in range(rng.randrange(1, 14)))
             for n in range(50)]
    got = {r.doc_id: r.text for r in run(spark, list(enumerate(texts)))}
    assert [got[n] for n in range(len(texts))] == brute(texts)


def test_lines_in_another_order_stay(spark):
    a, b, c = "one two three", "four five six", "seven eight nine"
    texts = ["\n".join([a, a, b, b, c, c]), "\n".join([c, b, a, c, b, a]), "\n".join(["nine words " * 5, a, a, b, b, c, c]),
             "\n".join(["nine words " * 5, c, b, a, c, b, a])]
    got = {r.doc_id: r.text for r in run(spark, list(enumerate(texts)))}
    assert got[1] == texts[1] and got == dict(enumerate(brute(texts)))


@pytest.mark.parametrize("seed", range(20))
def test_two_documents_by_brute_force(seed):
    rng = random.Random(seed)
    def document():
        return [(k, rng.randrange(5), 0) for k in range(rng.randrange(1, 25))]
    words = [rng.randrange(1, 6) for _ in range(5)]
    first, later = ([(k, h, words[h]) for k, h, _ in document()] for _ in "ab")
    gone = common_runs([(h, w) for _, h, w in first], [(h, w) for _, h, w in later], 8)
    assert line_dedup.deleted(first, later, 8) == sorted(gone)


def test_blocks_are_aligned_by_patience():
    shared = [(0, 10, True), (1, 11, True), (2, 3, True), (3, 12, True), (4, 13, False), (5, 14, False)]
    assert line_dedup.blocks(shared) == [[0, 1], [3], [2], [4, 5]]
    assert sorted(map(len, line_dedup.chains([(k, -k) for k in range(4)]))) == [1, 1, 1, 1]
    assert line_dedup.chains([(0, 5), (1, 6), (2, 1), (3, 7), (4, 2)]) == [[2, 4], [0, 1, 3]]


@pytest.mark.parametrize("forward", [True, False])
def test_one_long_document_with_very_many_partners_is_linear(spark, forward):
    lines = [f"line number {k} of a long list with words" for k in range(20_000)]
    rest = [(k + (1 if forward else -5000), lines[k * 6]) for k in range(3000)]
    rows = [(0, "\n".join(lines))] + rest
    begin = time.perf_counter()
    got = {r.doc_id: r for r in run(spark, rows)}
    assert time.perf_counter() - begin < 20
    assert sum(r.n_removed_lines for r in got.values()) == 3000
    assert got[0].n_removed_lines == (0 if forward else 3000)
