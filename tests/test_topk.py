import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import retrieval
from corpusflow.operators.topk import add_bucket, top_k, top_k_lsh, top_k_probed
from corpusflow.sources.tables import scan, write_by


def expected(vectors, questions, k, metric, scoped):
    """Best k by full enumeration; rows are (id, group, vector)."""
    found = []
    for qid, qgroup, q in questions:
        scored = []
        for (doc, pos), group, v in vectors:
            if not len(v) or not len(q) or scoped and group != qgroup:
                continue
            a, b = np.array(v, dtype=np.float32).astype(float), np.array(q, dtype=np.float32).astype(float)
            if metric == "cosine":
                same = len(a) == len(b) and a.any() and b.any()
                score = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if same else 0.0
            elif len(a) != len(b):
                continue
            else:
                score = 1 / (1 + ((a - b) ** 2).sum())
            scored.append((-round(score, 9), doc, pos))
        found += [(qid, doc, pos, rank + 1, round(-s, 6)) for rank, (s, doc, pos) in enumerate(sorted(scored)[:k])]
    return sorted(found)


def collected(hits):
    return sorted((r["query_id"], r["document_id"], r["chunk_index"], r["rank"], round(r["score"], 6))
                  for r in hits.collect())


@pytest.fixture(scope="module")
def tables(spark):
    """A third of the rows in one group, copies, zero vectors, other widths, empty vectors."""
    random = np.random.default_rng(1)
    vectors = []
    for i in range(400):
        v = random.standard_normal(8).round(3)
        if i % 10 == 0:
            v = np.ones(8)
        elif i % 37 == 0:
            v = np.zeros(8)
        elif i % 41 == 0:
            v = v[:5]
        elif i % 43 == 0:
            v = v[:0]
        vectors.append(((f"d{i % 90:02d}", i // 90), "hot" if i % 3 == 0 else f"g{i % 7}", v.tolist()))
    questions = [(i, "hot" if i % 3 == 0 else f"g{i % 8}", vectors[i * 3][2]) for i in range(40)]
    questions.append((99, "hot", []))
    vdf = spark.createDataFrame([(d, p, g, v) for (d, p), g, v in vectors],
                                "document_id string, chunk_index int, kb string, embedding array<float>").repartition(5)
    qdf = spark.createDataFrame(questions, "query_id int, kb string, embedding array<float>")
    return vectors, questions, vdf.cache(), qdf


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("form", ["sent", "grid"])
def test_top_k_equals_enumeration(tables, metric, scoped, form):
    vectors, questions, vdf, qdf = tables
    limits = {} if form == "sent" else {"question_bytes": 0, "tile_bytes": 1200}
    hits = top_k(vdf, qdf, 4, metric, within="kb" if scoped else None, **limits)
    assert collected(hits) == expected(vectors, questions, 4, metric, scoped)


def test_small_score_blocks(tables, monkeypatch):
    vectors, questions, vdf, qdf = tables
    monkeypatch.setattr("corpusflow.operators.topk.SCORE_CELLS", 100)
    assert collected(top_k(vdf, qdf, 2)) == expected(vectors, questions, 2, "cosine", False)


@pytest.mark.parametrize("limits", [{}, {"question_bytes": 0, "tile_bytes": 2000}])
def test_lsh_scores_are_exact_and_recall_is_high(spark, limits):
    random = np.random.default_rng(3)
    centres = random.standard_normal((20, 16))
    points = [(f"d{i:03d}", 0, (centres[i % 20] + 0.1 * random.standard_normal(16)).tolist()) for i in range(400)]
    vdf = spark.createDataFrame(points, "document_id string, chunk_index int, embedding array<float>")
    qdf = spark.createDataFrame([(i, points[i][2]) for i in range(40)], "query_id int, embedding array<float>")
    exact = collected(top_k(vdf, qdf, 3))
    near = collected(top_k_lsh(vdf, qdf, 16, 3, tables=8, bits=4, **limits))
    score = {row[:3]: row[4] for row in exact}
    shared = [row for row in near if row[:3] in score]
    assert len(shared) >= 0.9 * len(exact)
    assert all(row[4] == score[row[:3]] for row in shared)
    assert len({row[:3] for row in near}) == len(near)


@pytest.mark.parametrize("within", [None, "kb"])
def test_lsh_forms_agree(tables, within):
    _, _, vdf, qdf = tables
    sent = collected(top_k_lsh(vdf, qdf, 8, 3, within=within, tables=3, bits=3))
    grid = collected(top_k_lsh(vdf, qdf, 8, 3, within=within, tables=3, bits=3, question_bytes=0, tile_bytes=1500))
    assert sent == grid and sent


def test_lsh_with_no_bits_is_the_exact_search(tables):
    vectors, questions, vdf, qdf = tables
    same_width = [v for v in vectors if len(v[2]) == 8]
    asked = [q for q in questions if len(q[2]) == 8]
    near = collected(top_k_lsh(vdf.where("size(embedding) = 8"), qdf.where("size(embedding) = 8"), 8, 4,
                               within="kb", tables=2, bits=0))
    assert near == expected(same_width, asked, 4, "cosine", True)


@pytest.mark.parametrize("limits", [{}, {"question_bytes": 0, "tile_bytes": 1500}])
def test_visiting_all_buckets_is_the_exact_search(tables, limits):
    vectors, questions, vdf, qdf = tables
    fit = "size(embedding) = 8"
    hits = top_k_probed(add_bucket(vdf.where(fit), 8, 4), qdf.where(fit), 8, 4, 16, k=4, **limits)
    assert collected(hits) == expected([v for v in vectors if len(v[2]) == 8], [q for q in questions if len(q[2]) == 8],
                                       4, "cosine", False)


def test_probing_reads_only_visited_folders(spark, tables, tmp_path):
    _, _, vdf, qdf = tables
    path = str(tmp_path / "bucketed")
    write_by(add_bucket(vdf.where("size(embedding) = 8"), 8, 5), path, "bucket")
    one = qdf.where("query_id = 1")
    hits = top_k_probed(scan(spark, path), one, 8, 5, 3, k=1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: []" in plan
    # The stored vector that equals the question is in the first bucket visited.
    assert hits.first()["score"] == pytest.approx(1.0)


def test_parameters_are_checked(tables):
    _, _, vdf, qdf = tables
    with pytest.raises(ValueError):
        top_k(vdf, qdf, 0)
    with pytest.raises(ValueError):
        top_k(vdf, qdf, 3, "dot")


def test_scan_form_shuffles_candidates_only(tables):
    _, _, vdf, qdf = tables
    plan = top_k(vdf.select("*"), qdf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan
    assert "NestedLoop" not in plan and "WindowGroupLimit" in plan


@pytest.fixture(scope="module")
def collection(spark):
    documents = spark.createDataFrame(
        [("a", "k1", "COMPLETED"), ("b", "k1", "EMBEDDING"), ("c", "k2", "COMPLETED"), ("d", "k2", "FAILED")],
        "document_id string, knowledge_base_id string, status string")
    chunks = spark.createDataFrame(
        [("a", 0, [1.0, 0.0], "k1"), ("a", 2, [0.9, 0.1], "k1"), ("b", 0, [1.0, 0.0], "k1"), ("c", 0, [1.0, 0.1], "k2"),
         ("d", 0, [1.0, 0.0], "k2"), ("gone", 0, [1.0, 0.0], "k1"), ("a", 3, [], "k1")],
        "document_id string, chunk_index int, embedding array<float>, knowledge_base_id string")
    questions = spark.createDataFrame([(1, "k1", [1.0, 0.0]), (2, "k2", [1.0, 0.0]), (3, "k9", [1.0, 0.0])],
                                      "query_id int, knowledge_base_id string, embedding array<float>")
    return documents, chunks, questions


def test_scopes(collection):
    documents, chunks, questions = collection
    kb = collected(retrieval.retrieve(documents, chunks, questions, 2))
    assert [r[:4] for r in kb] == [(1, "a", 0, 1), (1, "a", 2, 2), (2, "c", 0, 1)]
    filtered = collected(retrieval.retrieve(documents, chunks, questions, 2, scope="global_then_filter"))
    assert [r[:4] for r in filtered] == [(1, "a", 0, 1)]
    assert {r[:3] for r in filtered} <= {r[:3] for r in kb}
    with pytest.raises(ValueError):
        retrieval.retrieve(documents, chunks, questions, scope="other")


@pytest.mark.parametrize("limit", [0, 40, 1 << 20])
def test_kb_chunks_whatever_fits_a_broadcast(collection, limit):
    documents, chunks, _ = collection
    got = retrieval.kb_chunks(documents, chunks, limit)
    assert sorted((r["document_id"], r["chunk_index"], r["knowledge_base_id"]) for r in got.collect()) == [
        ("a", 0, "k1"), ("a", 2, "k1"), ("a", 3, "k1"), ("c", 0, "k2")]


def test_single_question(collection):
    _, chunks, _ = collection
    hits = retrieval.top_k_single(chunks, [1.0, 0.0], 2).collect()
    assert [(h["rank"], h["document_id"]) for h in sorted(hits, key=lambda h: h["rank"])] == [(1, "a"), (2, "b")]
    assert retrieval.top_k_single(chunks, []).count() == 0
    scored = retrieval.score_chunks(chunks, [1.0, 0.0])
    assert scored.count() == 6 and scored.agg(F.max("score")).first()[0] == pytest.approx(1.0)


def _block(values, **columns):
    import pyarrow as pa

    return pa.table({**columns, "embedding": pa.array(list(values), pa.list_(pa.float32()))})


def test_hash_tables_share_the_questions():
    """Questions are held once, whatever the number of hash tables; a table has their row numbers."""
    from corpusflow.operators import topk

    values = np.random.default_rng(1).normal(size=(500, 64)).astype(np.float32)
    asked = topk._Questions(_block(values, query_id=range(500)), topk._Buckets(None, topk.hyperplanes(64, 20, 4, 7), 20), "l2")
    held = sum(rows.nbytes for parts in asked.parts for by_width in parts.values() for rows in by_width.values())
    assert held == 20 * 500 * 8


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("scale,offset", [(1, 0), (1e-12, 0), (1e-3, 3), (1e17, 0)])
def test_single_precision_loses_no_hit(metric, scale, offset):
    """Neighbours closer to each other than single precision can tell, with the scores of double precision."""
    import pyarrow as pa

    from corpusflow.operators import topk

    values = (offset + np.random.default_rng(2).normal(size=(1500, 8)) * scale).astype(np.float32)
    values[10:60], values[3] = values[10], 0
    schema = pa.schema([("query_id", pa.int64()), ("document_id", pa.int64()), ("chunk_index", pa.int64()), ("score", pa.float64())])
    asked = topk._Questions(_block(values[:600], query_id=range(600)), topk._Buckets(None), metric)
    batches = _block(values, document_id=range(1500), chunk_index=[0] * 1500).to_batches(max_chunksize=400)
    got = topk._top_of(asked, batches, 3, schema)
    found = np.array(got["score"]).reshape(600, 3)
    exact = values.astype(float)
    if metric == "cosine":
        exact = topk._unit(exact)
        scores = exact[:600] @ exact.T
    else:
        scores = 1 / (1 + ((exact[:600, None] - exact[None]) ** 2).sum(-1))
    expected = -np.sort(-np.round(scores, 9), axis=1)[:, :3]
    assert np.allclose(-np.sort(-found, axis=1), expected, atol=2e-9) or scale > 1e9
    assert sorted(set(np.array(got["query_id"]))) == list(range(600))


def test_keys_of_two_types_meet_in_the_grid(spark, tmp_path):
    """Of a table stored by bucket the folder is read as int, while a question's bucket is a bigint."""
    rng = np.random.default_rng(4)
    values = [v.tolist() for v in rng.normal(size=(300, 8))]
    vectors = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "document_id long, chunk_index int, embedding array<float>")
    questions = spark.createDataFrame(list(enumerate(values)), "query_id long, embedding array<float>")
    path = str(tmp_path / "bucketed")
    write_by(add_bucket(vectors, width=8, bits=4), path, "bucket")
    stored = scan(spark, path)
    assert dict(stored.dtypes)["bucket"] == "int"
    rows = lambda hits: sorted(map(tuple, hits.select("query_id", "document_id", "score", "rank").collect()))
    # Tables as small as this one would come together in one partition.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for probes in (5, 16):
            sent = rows(top_k_probed(stored, questions, 8, 4, probes, metric="l2"))
            dealt = rows(top_k_probed(stored, questions, 8, 4, probes, metric="l2", question_bytes=1, tile_bytes=1 << 12))
            assert dealt == sent and len(sent) == 900
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
