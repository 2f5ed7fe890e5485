"""Fill-in-the-middle against a plain version on strings; the wavelet matrix against counting."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import infill

SCHEMA = "doc_id long, text string, n int, form string, output string"
PATTERN = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+",
           "word": r"[^ \t\n\x0b\x0c\r]*[ \t\n\x0b\x0c\r]|[^ \t\n\x0b\x0c\r]+"}


def plain_version(doc_id, text, unit, seed, percent, spm):
    text = text or ""
    units = re.findall(PATTERN[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, len(units))))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_wavelet_matrix_counts():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 8, size).astype(np.uint8)
        matrix = infill.WaveletMatrix(values)
        places = np.arange(size + 1)
        for v in range(8):
            before = np.concatenate([[0], np.cumsum(values == v)])
            assert (matrix.rank(v, places) == before).all()
        both = np.concatenate([[0], np.cumsum((values == 1) | (values == 6))])
        numbers = np.arange(1, both[-1] + 1)
        found = matrix.select((1, 6), numbers, np.zeros_like(numbers), np.full_like(numbers, size))
        assert (found == np.searchsorted(both, numbers)).all()


@pytest.mark.parametrize("unit, seed, percent, spm", [("line", 7, 100, 50), ("word", 1, 70, 0), ("sentence", 2, 100, 100)])
def test_equals_plain_version(spark, unit, seed, percent, spm):
    rng = random.Random(seed)
    words = ["one", "two.", "ünï", "日本!", "🎉", "\n", "\n\n", " ", "<", "<P", "S>", "\r\n", "\t", "<M>" if rng.random() < .2 else ">"]
    texts = [None, "", "\n", "\n\n\n", "no end", "end\n", "a\r\nb", "x<P>y\nz", "<S>", "a<M>", "𝒳" * 5 + "\n" + "𝒳"]
    texts += ["".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts.append("a long line\n" * 60_000 + "end" * 100_000)
    rows = [(rng.choice([None, -1, 2**60, n, n, n]), t) for n, t in enumerate(texts)] + [(5, "the same\nrow\n")] * 3
    df = spark.createDataFrame([(i, t, 1, "f", "o") for i, t in rows], SCHEMA).repartition(4)
    made = infill.infilled(df, unit, seed, percent, spm)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert Counter(map(tuple, made.collect())) == Counter(plain_version(i, t, unit, seed, percent, spm) for i, t in rows)
    back = made.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in rows)


def test_empty_table_and_unknown_unit(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert infill.infilled(empty).count() == 0
    with pytest.raises(ValueError):
        infill.infilled(empty, "page")
