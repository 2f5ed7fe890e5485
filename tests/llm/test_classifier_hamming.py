"""Classifier by held-out accuracy, Hamming search against all pairs."""

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from corpusflow.llm import classifier, common, hamming

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    got = classifier.score(docs, classifier.fit(docs, labels)).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    known = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert len(known) > 50 and (known["predicted"] == known["quality"]).mean() > 0.95


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    turned = labels.withColumn("quality", (1 - labels.quality).cast("int")).filter(classifier.held_out(labels.doc_id))
    mixed = labels.filter(~classifier.held_out(labels.doc_id)).unionByName(turned)
    assert (classifier.fit(docs, labels) == classifier.fit(docs, mixed)).all()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "a " * 5000, "z"), (3, "b", "z")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = classifier.score(docs, classifier.fit(docs, labels, bits=10)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    nothing = classifier.fit(docs, labels.limit(0), bits=10)
    assert {r.score for r in classifier.score(docs, nothing).collect()} == {0.5}
    assert classifier.score(docs.limit(0), nothing).count() == 0


def test_features_by_text():
    texts = ["a b a b", "", "one", "b a", "a a"]
    for first, data, offsets in common.text_buffers(pa.array(texts)):
        found, bounds = classifier.features(data, offsets, 20)
    assert np.diff(bounds).tolist() == [14, 0, 2, 6, 6]
    alone = [classifier.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 20)[0] for t in texts]
    for a, b, own in zip(bounds, bounds[1:], alone):
        assert sorted(found[a:b]) == sorted(own)


def brute(rows, queries, k):
    width = max(len(v) for _, v in rows if v is not None)
    bits = lambda v: [x is not None and x > 0 for x in v] + [False] * (width - len(v))
    out = []
    for q, v in queries:
        found = sorted((sum(a != b for a, b in zip(bits(v), bits(w))), -1 if i is None else i) for i, w in rows
                       if w is not None)
        out += [(q, n + 1, None if i < 0 else i, d) for n, (d, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("part_codes, query_block, k", [(100_000, 20_000, 10), (40, 3, 5), (7, 2, 400)])
def test_top_k(spark, part_codes, query_block, k):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 220)]  # a very common vector
    rows += [(220, None), (221, [None] * 40), (222, [1.0] * 7), (None, rows[5][1]), (223, [])]
    queries = [r for r in rows[::17] if r[1] is not None] + [rows[3], rows[-2], rows[-1]]
    make = lambda found: spark.createDataFrame([(*r, "x", 1) for r in found],
                                               "vec_id long, embedding array<float>, code string, distance int")
    got = hamming.top_k(make(rows), make(queries), "vec_id", "embedding", k, part_codes, query_block).collect()
    expected = brute(rows, {(q, tuple(v)) for q, v in queries}, k)
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_radius_search_covers_all():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    queries = codes[:5] ^ np.uint16(5)
    for radius in range(4):
        for own, got in zip(queries, hamming.search(codes, queries, radius)):
            near = (np.bitwise_count(codes ^ own) == radius).any(axis=1)
            assert got.tolist() == np.flatnonzero(near).tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame(pd.DataFrame({"vec_id": [1], "embedding": [[1.0]]})).limit(0)
    assert hamming.top_k(none, none, "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("k", [3, 10, 40])
def test_repeated_rows_are_results_of_their_own(spark, k):
    rng = random.Random(9)
    vectors = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(6)]
    rows = [(4, vectors[0])] * 5 + [(i, vectors[0]) for i in (5, 6, 7)] + [(10 + i, v) for i, v in enumerate(vectors)]
    turned = [[-x if n == m else x for n, x in enumerate(vectors[0])] for m in (0, 1)]
    rows += [(1, turned[0]), (1, turned[1]), (1, turned[1]), (None, vectors[1]), (None, vectors[1])]
    queries = [(100 + i, v) for i, v in enumerate(vectors)]
    make = lambda found: spark.createDataFrame(found, "vec_id long, embedding array<float>")
    got = hamming.top_k(make(rows), make(queries), "vec_id", "embedding", k, part_codes=3).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, queries, k), key=repr)


def test_labels_without_a_document_take_no_training_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i % 2} of {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    more = labels.unionByName(spark.range(1000, 5000).selectExpr("id AS doc_id", "1 AS quality"))
    alone = classifier.fit(docs, labels, bits=10, training_rows=20)
    assert alone.any() and (classifier.fit(docs, more, bits=10, training_rows=20) == alone).all()


@pytest.mark.parametrize("part_codes", [1, 100_000])
def test_ids_are_exact_beside_null(spark, part_codes):
    big = 2**53
    rows = [(None, [1.0] * 16), (-5, [1.0] * 16), (big + 1, [1.0] * 16), (big + 3, [1.0] * 16), (1, [-1.0] * 16), (2, [1.0] * 15 + [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    own = spark.createDataFrame([(7, [1.0] * 16), (None, [-1.0] * 16)], "vec_id long, embedding array<float>")
    got = hamming.top_k(df, own, "vec_id", "embedding", 4, part_codes).collect()
    assert sorted((r["rank"], r.id, r.distance) for r in got if r.query_id == 7) == [
        (1, None, 0), (2, -5, 0), (3, big + 1, 0), (4, big + 3, 0)]
    assert [(r.id, r.distance) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id is None] == [
        (1, 0), (2, 15), (None, 16), (-5, 16)]


def test_the_index_is_shuffled_once_whatever_the_radius(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plan = hamming.top_k(df, df.limit(5), "vec_id", "embedding", 3, 100)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 1
