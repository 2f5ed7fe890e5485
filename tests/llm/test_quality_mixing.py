"""Quality rules and mixing on small hard tables, against plain Python."""

import re
from collections import Counter

import pytest

from corpusflow.llm import mixing, quality

PROSE = "These words make a sentence that ends with a stop, and another one follows it here. " * 8
DOCS = [(1, None), (2, ""), (3, " \n\t "), (4, PROSE), (5, "word " * 60), (6, "a b c " * 40 + "end."),
        (7, PROSE + "\nHome | News | Sport | More\nAll rights reserved.\n" + PROSE), (8, "Home | News | Sport\n" * 30),
        (9, "x### y### z### " * 30), (None, PROSE), (4, PROSE), (10, "\n".join(["One line twice here."] * 14)),
        (11, "A\x0bB\x0c" * 40), (12, "é ñ … 日本 " * 20 + "。"), (13, PROSE * 300)]


def figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), failed)


def test_quality_figures(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, v string, n_words int")
    got = quality.judge(df).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted([(r.doc_id, *(r[n] for n in names)) for r in got], key=repr) == sorted(
        [(i, *figures(t)) for i, t in DOCS], key=repr)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_lines_are_removed_and_documents_rejected(spark):
    varied = "\n".join(" ".join(f"word{i}{k}" for k in range(9)) + "." for i in range(20))
    rows = [(1, varied + "\nHome | News | Sport | More\nAll rights reserved.\nno stop here", "en", "s", 1),
            (2, "\n".join(f"Item {i} | Entry {i} | Page {i} | More {i}" for i in range(40)), "en", "s", 1),
            (3, varied, None, None, None), (4, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = quality.keep(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == [(1, varied, len(varied)), (3, varied, len(varied))]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def fair(rows):
    """Targets by resharing round by round."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, free = {}, sum(sizes.values()), list(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        for s in over or free:
            target[s] = 3 * sizes[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    return sizes, target


@pytest.mark.parametrize("sources, buckets", [(["a", "b", "c", None, "é"], 3), (["a"], 2000), (list("abcdefgh"), 50)])
def test_mixing(spark, sources, buckets):
    rows = []
    for i in range(600):
        source = sources[0] if i % 3 == 0 else sources[(i * i) % len(sources)]
        size = 0 if i % 50 == 0 else 1 + (i * 7919) % 40
        if source == "c" and i > 100:
            continue
        rows.append((i, source, size))
    df = spark.createDataFrame([(i, s, "w " * n if n else None, "x") for i, s, n in rows],
                               "doc_id long, source string, text string, key string")
    got = mixing.mix(df, buckets).collect()
    sizes, target = fair(rows)
    assert sorted([(r.doc_id, r.source, r.size) for r in got], key=repr) == sorted(rows, key=repr)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert sum(taken.values()) <= sum(sizes.values())
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 40
    assert sorted(mixing.mix(df, buckets).collect(), key=repr) == sorted(got, key=repr)


def test_mixing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string, lang string, n_chars long")
    assert mixing.taken(none).count() == 0
    empty = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.size, r.taken) for r in mixing.taken(empty).collect()) == [(1, 0, 0), (2, 0, 0)]
    alike = spark.createDataFrame([(None, None, "a b")] * 3 + [(1, "s", "c d e")], "doc_id long, source string, text string")
    got = mixing.taken(alike).collect()
    assert len(got) == 4 and {r.target for r in got if r.doc_id is None} == {6.0}
    assert len({r.taken for r in got if r.doc_id is None}) == 1


def test_mixed_documents_repeat(spark):
    rows = [(i, f"word{i} " * 5, "en", "a" if i < 3 else "b", 5) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    got = mixing.mixed(df)
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({k: v for k, v in copies.items() if v})


def taken_words(got):
    out = Counter()
    for r in got:
        out[r.source] += r.copies * r.size
    return out


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_repeated_rows_are_served_one_by_one(spark, block_rows):
    rows = [(5, "a", 10)] * 600 + [(i, s, 10) for s in "bc" for i in range(600)] + [(None, "d", 3)] * 50 + [(None, "d", 0)] * 9
    df = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    got = mixing.mix(df, 100, block_rows).collect()
    sizes, target = fair(rows)
    taken = taken_words(got)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(rows)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 10, source
    for source in "a", "d":
        copies = Counter(r.copies for r in got if r.source == source and r.size)
        assert max(copies) - min(copies) <= 1


def test_mixed_documents_among_equal_rows(spark):
    rows = [(5, f"text {i % 7}", "en", "a", 5) for i in range(60)] + [(i, "other text here", "en", "b", 5) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    words = taken_words(mixing.mix(df).collect())
    got = mixing.mixed(df).collect()
    assert Counter(r.source for r in got) == {"a": words["a"] // 2, "b": words["b"] // 3}
    base = words["a"] // 2 // 60
    for text, n in Counter(r.text for r in got if r.source == "a").items():
        there = sum(t == text for _, t, *_ in rows)
        assert base * there <= n <= (base + 1) * there


def test_the_budget_is_found_in_small_slots(spark, monkeypatch):
    rows = [(i, "abc"[i % 3 if i % 5 else 0], 1 + i * 31 % 17) for i in range(900)]
    df = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    expected = sorted(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "SLOTS", 3)
    monkeypatch.setattr(mixing, "LAST_ROWS", 5)
    monkeypatch.setattr(mixing, "BUCKETS", 2)
    assert sorted(map(tuple, mixing.mix(df, 20).collect())) == expected


@pytest.mark.parametrize("sentence", ["यह एक साधारण वाक्य है।", "هل هذا سؤال بسيط جدا هنا؟", "これは簡単な文です 。", "Սա պարզ նախադասություն է։",
                                      "ይህ ቀላል ዓረፍተ ነገር ነው።"])
def test_sentences_of_all_scripts_stay(spark, sentence):
    text = "\n".join(" ".join(f"{word}{n}" for word in sentence[:-1].split()) + sentence[-1] for n in range(60))
    got = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.kept and got.n_removed_words == 0


def test_wrapped_lines_stay(spark):
    words = [f"word{n}" for n in range(300)]
    lines = [" ".join(words[n:n + 10]) for n in range(0, 300, 10)]
    prose = "\n".join(lines) + "."
    menu = "\n".join(f"Item{n} Of The Menu" for n in range(60))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(
        [(1, prose), (2, menu), (3, lines[0] + "\n \n" + lines[1])], "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].n_removed_words == 0
    assert not got[2].kept and got[2].n_removed_words == 240
    assert got[3].clean_text == lines[0]
