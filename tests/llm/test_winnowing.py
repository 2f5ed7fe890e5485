"""Winnowing against a brute-force version, the neighbours in small blocks, and the guarantee on common passages."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusflow.llm import winnowing

SCHEMA = "doc_id long, text string, _key string, next_text string, block int"


def chosen(text, k, w):
    """(hash, position) of the rightmost minimum of every window of w grams."""
    if not text:
        return []
    grams = [text[i:i + k] for i in range(max(1, len(text) - k + 1))]
    values = [(xxhash.xxh64_intdigest(g.encode("utf-32-be"), seed=42), i) for i, g in enumerate(grams)]
    windows = [values[i:i + w] for i in range(max(1, len(values) - w + 1))]
    # Hashes are compared as signed numbers, without the bits that hold places.
    found = {min(x, key=lambda v: (((v[0] ^ 1 << 63) - (1 << 63)) >> 15, -v[1])) for x in windows}
    return [(h >> 32, i) for h, i in sorted(found, key=lambda v: v[1])]


def near(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, k, w):
    def key(row):
        i, t = row
        h = xxhash.xxh64_intdigest(t.encode(), seed=42)
        return (i is None, i or 0, h)
    rows = sorted(((i, t or "") for i, t in rows), key=key)
    out = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[:len(t) - q] + after[:q]
        f, g, h = (chosen(x, k, w) for x in (t, e, after))
        show = [" ".join(f"{a:x}:{b}" for a, b in x) for x in (f, g)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *show, near(f, g), near(f, h)))
    return out


def texts(rng):
    words = ["alpha", "beta", "ünï", "日本", "🎉🎉", "a", "\n", "  ", "zz\tz"]
    pool = ["", None, "a", "🎉", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 60, "x" * 11, "y" * 12, "z" * 27]
    pool += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    return pool


@pytest.mark.parametrize("k, w", [(12, 16), (8, 32), (3, 5), (1, 1)])
def test_fingerprints_equal_brute_force(spark, k, w):
    pool = texts(random.Random(k))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pool)], "doc_id long, text string").repartition(3)
    for chunk in (7, 64, 4096) if k > 1 else (1, 4096):
        found = df.select("doc_id", F.transform(winnowing.winnowed(F.col("text"), k, w, chunk), lambda x: F.struct(
            winnowing.hash_of(x), winnowing.position_of(x))).alias("f")).collect()
        for r in found:
            assert [tuple(x) for x in r.f] == chosen(pool[r.doc_id], k, w), (r.doc_id, chunk)
    whole = winnowing.fingerprints(df, k, w).collect()
    assert all([tuple(x) for x in r.fingerprint] == chosen(pool[r.doc_id], k, w) and r.n_chars == len(pool[r.doc_id] or "")
               for r in whole)


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_query_form_equals_brute_force(spark, block_rows):
    rng = random.Random(block_rows)
    pool = texts(rng)
    rows = [(rng.choice([-5, 3, 2**53 + 1, 2**53 + 2, None, *range(40)]), rng.choice(pool)) for _ in range(120)]
    rows += [(7, "the same row again and again")] * 40
    df = spark.createDataFrame([(i, t, "k", "n", 1) for i, t in rows], SCHEMA).repartition(5)
    got = winnowing.compared(df, block_rows=block_rows, block_bytes=1 << 20)
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows, winnowing.K, winnowing.W))


def test_one_row_and_none(spark):
    one = winnowing.compared(spark.createDataFrame([(1, "a text of one row")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"a text of one" + b"a te").hexdigest()
    assert one.near_next == 1.0
    assert winnowing.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_common_run_of_the_guaranteed_length_is_found(spark):
    rng = random.Random(5)
    t = winnowing.K + winnowing.W - 1
    run = "".join(rng.choice("abcdefgh ") for _ in range(t))
    rows = [(n, "".join(rng.choice("nopqrstuv") for _ in range(rng.randrange(9000))) + run
             + "".join(rng.choice("NOPQRSTUV") for _ in range(rng.randrange(300)))) for n in range(12)]
    at = {n: text.index(run) for n, text in rows}
    found = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [{(f.hash, f.position - at[r.doc_id]) for f in r.fingerprint} for r in found]
    assert all(a & b for a in sets for b in sets)


def test_plan_is_native_and_moves_texts_once(spark):
    df = spark.createDataFrame([(i, "x") for i in range(30)], "doc_id long, text string").repartition(2)
    plan = winnowing.compared(df, block_rows=5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("hashpartitioning(_block") == 1
