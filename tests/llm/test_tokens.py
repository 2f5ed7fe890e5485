"""Token counts, packing and token files against the library on whole texts."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import packing, token_counts, token_files, tokens
from corpusflow.session import work_path

TEXTS = [None, "", " ", "\n", "a", "a b", "a  b", "a\nb", "a\n\nb c", " a", "a ", "it's we'll 'x", "x<|endoftext|>y z",
         "<|startoftext|> a", "tab\there", "é́ ñ 12ab34 … ¿", " a b", "a\x1cb \x00 c\x01", "日本語 のテキスト",
         "İSTANBUL ΣΑΣ Σ", "a" * 5000, "word " * 3000, "don't stop\nnow or 100 % " * 40]
SCHEMA = "doc_id long, text string, n_tokens string, piece string, part string, row string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", "z", "w") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "x", "y", "z", "w"), (3, "\n", "x", "y", "z", "w"), (5, "other text", "x", "y", "z", "w")]
    return spark.createDataFrame(rows, SCHEMA)


def library(name):
    found = tokens.load(tokens.tokenizer_path(name))
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_unit_encoder_equals_library():
    encoder, whole = tokens.UnitEncoder(tokens.tokenizer_path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for texts in (TEXTS, TEXTS[::-1], ["a b c"] * 3, []):
        got = []
        for rows, lengths, ids in encoder.encode(pa.array(texts, pa.string())):
            bounds = tokens.pieces_of(lengths)
            got += [(int(r), ids[a:b].tolist()) for r, a, b in zip(rows, bounds, bounds[1:])]
        assert got == [(i, whole(t)) for i, t in enumerate(texts)]


def encoded(encoder, texts):
    """Ids of every text, in order."""
    got = {}
    for rows, lengths, ids in encoder.encode(pa.array(texts, pa.string())):
        bounds = tokens.pieces_of(lengths)
        got |= {int(r): ids[a:b].tolist() for r, a, b in zip(rows, bounds, bounds[1:])}
    return [got[i] for i in range(len(texts))]


def test_words_are_encoded_once_whatever_mark_follows():
    encoder, whole = tokens.UnitEncoder(tokens.tokenizer_path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    seen, encode = [], encoder.whole
    encoder.whole = lambda text: seen.append(text) or encode(text)
    words, marks = [f"word{chr(97 + i)}" for i in range(20)], [",", ".", "!?", "...", ");", "'", '",', "_", "s'."]
    texts = ["a " + " ".join(w + m for w in words for m in marks), "b " + " ".join(words)]
    assert encoded(encoder, texts) == [whole(t) for t in texts]
    # The last of the marks begins with a letter, so with it a word is another one.
    assert sum(t.count(w) for t in seen for w in words) == 40
    before = len(seen)
    assert encoded(encoder, texts[::-1]) == [whole(t) for t in texts[::-1]]
    assert len(seen) == before


@pytest.mark.parametrize("remembered, size", [(600_000, 1 << 25), (7, 1 << 25), (600_000, 2000), (0, 0)])
def test_marks_after_words_equal_library(monkeypatch, remembered, size):
    monkeypatch.setattr(tokens, "_REMEMBERED", remembered)
    monkeypatch.setattr(tokens, "_REMEMBERED_BYTES", size)
    rng = np.random.default_rng(5)
    parts = [*"aZ09é߀²½ªº…“”’'\",.;:!?-_()[]{}<>|/\\`~@#$%^&*+=", "don't", "we'll", "x's", "日本", "e\u0301", "ß", "İ", "😀",
             "the", "\u00d7", "\u00f7", "\u0660", "ⅷ", "ǅ", " ", " ", " ", " ", "\n"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(1500)]
    encoder, whole = tokens.UnitEncoder(tokens.tokenizer_path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for first in range(0, len(texts), 50):
        part = texts[first:first + 50]
        assert encoded(encoder, part) == [whole(t) for t in part]
    assert len(encoder.known) <= remembered and encoder.known.nbytes <= size + 8


@pytest.mark.parametrize("step, overlap", [(1 << 15, 256), (400, 60), (64, 24)])
def test_counts(spark, docs, step, overlap):
    whole = library("word_bpe_49k.json")
    got = token_counts.count_tokens(docs, tokens.tokenizer_path("word_bpe_49k.json"), 100, step, overlap).collect()
    expected = [(r.doc_id, len((r.text or "").encode()), len(whole(r.text)), len(whole(r.text)) > 100)
                for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_splice_needs_agreement():
    same = [{"at": i * 2, "id": i, "blank": True} for i in range(20)]
    assert token_counts.splice(same, same) == (16, 4)
    other = [{**t, "id": t["id"] + 1} for t in same]
    assert token_counts.splice(same, other) is None
    assert token_counts.splice(same, [{**t, "blank": False} for t in same]) is None


def check_packing(rows, docs, capacity):
    whole = library("byte_bpe_50k.json")
    by_doc = collections.Counter()
    for r in docs:
        ids = whole(r.text) + [0]
        start = 0
        for piece, length in enumerate(packing.cut_lengths(len(ids), capacity)):
            by_doc[(r.doc_id, piece, start, length, crc(ids[start:start + length]))] += 1
            start += length
    assert by_doc == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for got in bins.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity, per_partition", [(2048, 50_000), (40, 7)])
def test_packing(spark, docs, capacity, per_partition):
    got = packing.pack_documents(docs, tokens.tokenizer_path("byte_bpe_50k.json"), capacity, 0, per_partition).collect()
    used = check_packing(got, docs.collect(), capacity)
    least = packing.lower_bound(np.array([r.length for r in got]), capacity)
    assert least <= used <= least + 3


def test_lower_bound_holds():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = rng.integers(1, 21, rng.integers(1, 30))
        assert packing.lower_bound(lengths, 20) <= packing.best_fit_decreasing(lengths, 20)[2]
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3


def test_token_files(spark, docs):
    whole = library("byte_bpe_50k.json")
    target = work_path(spark, "ids")
    token_files.write_ids(docs, tokens.tokenizer_path("byte_bpe_50k.json"), target)
    got = sorted(token_files.describe(spark, target).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda i: -1 if i is None else i)
    expected = collections.Counter((r.doc_id, len(ids := whole(r.text) + [2]), crc(ids)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    one = token_files.read_ids(spark, target).filter("doc_id = 12").collect()
    assert [r.ids for r in one] == [whole(TEXTS[12]) + [2]]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    assert token_counts.count_tokens(none, tokens.tokenizer_path("word_bpe_49k.json")).count() == 0
    assert packing.pack_documents(none, path).count() == 0
    target = work_path(spark, "ids")
    token_files.write_ids(none, path, target)
    assert token_files.describe(spark, target).count() == 0
