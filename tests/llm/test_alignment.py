"""Alignment against a plain version that encodes whole texts, and the laws of the fragments."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusflow.llm import alignment, tokens

A, B = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pair int, row int, n long"


def plain_version(rows):
    """The contract by loops over whole texts."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = alignment._byte_of()
    docs, total = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        names = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode()
                   for i, n in zip(ids_b, names)]
        if not text or b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            docs.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, links, m, x = [], [], 0, 0
        for i, end in enumerate(ends_a):
            if end in ends_b:
                j = ends_b.index(end)
                groups.append((ids_a[m:i + 1], ids_b[x:j + 1]))
                links.append((ids_a[i], ids_b[j]))
                m, x = i + 1, j + 1
        total.update(links)
        docs.append((doc_id, ids_a, ids_b, groups, links))
    best = Counter()
    for (_, q), n in total.items():
        best[q] = max(best[q], n)
    return [(i, len(p), len(q), len(g), len(k), sum(total[x] == best[x[1]] for x in k), sum(total[x] for x in k),
             hashlib.sha256(";".join(",".join(map(str, s)) + "|" + ",".join(map(str, t)) for s, t in g).encode()).hexdigest()
             if g else "") for i, p, q, g, k in docs]


def texts(rng, count):
    words = ["the", "word", "naïve", "日本語", "🎉🎉", "x1y2", "don't", "<|endoftext|>", "<s>", "</s>", "<0x41>", "A.B,c",
             "ﬁ", "é", "é", "12345", "_", "supercalifragilistic", "$%&", "Ωmega"]
    odd = ["  ", "\n\n", "\t", "\r\n", " \n", "▁", " ", "　", "\x00", "\x01", "\x7f", "   "]
    out = [None, "", " ", "\n", "a", " a", "a ", "▁", "<unk>", "a\n", "\na", "日本"]
    for _ in range(count):
        parts = [rng.choice(words) for _ in range(rng.randrange(1, 30))]
        gaps = [rng.choice([" ", " ", "\n", rng.choice(odd) if rng.random() < .3 else " "]) for _ in parts]
        out.append("".join(p + g for p, g in zip(parts, gaps[:-1] + [""])))
    return out


@pytest.mark.parametrize("whole, chunk", [(1 << 16, 1 << 15), (0, 40), (30, 7)])
def test_equals_plain_version(spark, whole, chunk):
    rng = random.Random(chunk)
    pool = texts(rng, 120) + [" ".join(rng.choice(["some", "plain", "words", "zzzzzzzzz"]) for _ in range(400)),
                              "nospaceatall" * 50]
    rows = [(rng.choice([None, -1, n, n, n]), t) for n, t in enumerate(pool)] + [(5, "the same row")] * 3
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], SCHEMA).repartition(3)
    got = alignment.compared(df, A, B, whole=whole, chunk=chunk)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_version(rows))


def test_counts_too_large_to_send(spark, monkeypatch):
    rng = random.Random(9)
    rows = list(enumerate(texts(rng, 40)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(alignment, "COUNT_BYTES", 0)
    assert Counter(map(tuple, alignment.compared(df, A, B).collect())) == Counter(plain_version(rows))


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = Counter(plain_version(rows))
    assert Counter(map(tuple, alignment.compared(df, A, B).collect())) == expected
    assert Counter(map(tuple, alignment.compared(df, A, B, whole=2000, chunk=500).collect())) == expected


def random_fragment(rng, begin, end):
    def side():
        ends = sorted(rng.sample(range(begin + 1, end + 1), rng.randrange(0, end - begin + 1)))
        return np.array([rng.randrange(50) for _ in ends], np.int64), np.array(ends, np.int64)
    return alignment.fragment(*side(), *side())


def test_fragments_are_a_monoid():
    rng = random.Random(1)
    for _ in range(300):
        f, g, h = (random_fragment(rng, a, a + rng.randrange(1, 6)) for a in (0, 10, 20))
        assert (f + g) + h == f + (g + h)
        assert alignment.Fragment() + f == f == f + alignment.Fragment()


def test_any_cut_composes_to_the_whole():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.randrange(1, 40)
        sides = []
        for _ in "ab":
            ends = np.array(sorted({*rng.sample(range(1, size + 1), rng.randrange(size)), size}), np.int64)
            sides.append((np.array([rng.randrange(50) for _ in ends], np.int64), ends))
        whole = alignment.fragment(*sides[0], *sides[1])
        cuts = sorted({0, size, *rng.sample(range(size + 1), min(3, size))})
        out = alignment.Fragment()
        for a, b in zip(cuts, cuts[1:]):
            out = out + alignment.fragment(*(x[(e > a) & (e <= b)] for ids, e in sides for x in (ids, e)))
        assert out == whole and out.finished() == whole.finished()


def test_what_a_worker_holds_does_not_grow_with_the_batch():
    rng = random.Random(4)
    words = [f"word{n}" for n in range(2000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(4000)]
    texts[7], texts[2000] = "two  spaces", None
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    run = alignment._whole(A, B)
    for _ in run(iter([batch.slice(0, 100)])):
        pass
    rows, held, worst = [], [], 0
    tracemalloc.start()
    try:
        for out in run(iter([batch])):
            worst = max(worst, tracemalloc.get_traced_memory()[1])
            tracemalloc.reset_peak()
            rows += out.column("doc_id").to_pylist()
            held.append(out.nbytes)
    finally:
        tracemalloc.stop()
    assert sorted(rows) == list(range(len(texts)))
    assert max(held) < 0.5 * sum(held)
    # With all results of the batch at once, as dicts, it is 130 MB.
    assert worst < 80e6


def test_empty_table(spark):
    assert alignment.compared(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
