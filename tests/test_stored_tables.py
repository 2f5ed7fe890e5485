"""Stored tables and streams where ids look like numbers, batches are empty and parsers fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.operators import catalog, retrieval
from corpusflow.operators.embedding import embed, hashing_encoder
from corpusflow.operators.topk import add_bucket, add_probes, top_k, top_k_probed
from corpusflow.session import table_size
from corpusflow.plans import answering, processing
from corpusflow.sources import files, tables
from corpusflow.streaming import jobs

CHUNK = "document_id string, chunk_index int, embedding array<float>, knowledge_base_id string"


def triples(df):
    return sorted((r["document_id"], r["knowledge_base_id"], r["chunk_index"]) for r in df.collect())


@pytest.mark.parametrize("stored", [True, False])
def test_kb_chunks_mean_the_same_at_every_size(spark, stored):
    documents = spark.createDataFrame(
        [("a", "k1", "COMPLETED"), ("a", "k1", "COMPLETED"), ("b", "k1", "FAILED"), ("c", None, "COMPLETED"),
         (None, "k1", "COMPLETED"), ("d", "k2", "COMPLETED")], "document_id string, knowledge_base_id string, status string")
    chunks = spark.createDataFrame(
        [("a", 0, [1.0], "k1"), ("a", 1, [1.0], None), (None, 0, [1.0], "k1"), (None, 1, [1.0], None), ("b", 0, [1.0], "k1"),
         ("c", 0, [1.0], None), ("d", 0, [1.0], "k1"), ("d", 1, [1.0], "k2"), ("e", 0, [1.0], "k1")], CHUNK)
    chunks = chunks if stored else chunks.drop("knowledge_base_id")
    found = [sorted(map(repr, retrieval.kb_chunks(documents, chunks, limit).select(
        "document_id", "chunk_index", "knowledge_base_id").collect())) for limit in (0, 64 << 20)]
    assert found[0] == found[1]
    if stored:
        assert triples(retrieval.kb_chunks(documents, chunks, 0)) == [("a", "k1", 0), ("d", "k2", 1)]


def test_deleting_documents_keeps_the_others_of_the_folder(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [("007", 0, [1.0], "007"), ("1e5", 0, [1.0], "007"), ("c", 0, [1.0], "12"), ("d", 0, [1.0], "a b/ü"), ("e", 0, [1.0], None)]
    tables.write_chunks(spark.createDataFrame(rows, CHUNK), path)
    listed = spark.createDataFrame([("007", "007"), ("c", "12"), ("d", "a b/ü"), ("x", "none")],
                                   "document_id string, knowledge_base_id string")
    tables.delete_documents_from(spark, path, listed)
    assert [tuple(r) for r in tables.scan(spark, path).select("document_id", "knowledge_base_id").orderBy("document_id")
            .collect()] == [("1e5", "007"), ("e", None)]
    tables.delete_knowledge_bases_from(spark, path, spark.createDataFrame([("007",), ("9",)], "knowledge_base_id string"))
    assert [r["document_id"] for r in tables.scan(spark, path).collect()] == ["e"]


def test_ids_stay_text(spark, tmp_path):
    documents = spark.createDataFrame([("007", "007", "some text"), ("1e5", "1e5", "more text")],
                                      "document_id string, knowledge_base_id string, text string")
    processing.process_to(documents, str(tmp_path / "c"), hashing_encoder(16))
    assert triples(processing.stored_outcomes(spark, str(tmp_path / "c"))) == [("007", "007", 0), ("1e5", "1e5", 0)]


def test_no_documents_at_all(spark, tmp_path):
    none = spark.createDataFrame([], "document_id string, knowledge_base_id string, text string")
    assert processing.process_to(none, str(tmp_path / "c"), hashing_encoder(16)).count() == 0


def test_file_types_and_failing_parsers(spark, tmp_path):
    for name, data in {"k/a.txt": b"plain", "k/b.pdf": b"pages", "k/c.pdf": b"broken", "k/d.exe": b"MZ", "k/e.doc": b"x"}.items():
        (tmp_path / "up" / "k").mkdir(parents=True, exist_ok=True)
        (tmp_path / "up" / name).write_bytes(data)

    def parse(content):
        if content == b"broken":
            raise ValueError("no pages")
        return content.decode().upper()

    documents = files.ingest_files(spark, str(tmp_path / "up"))
    names = documents.select("document_id", "file_name")
    statuses = processing.process_to(documents, str(tmp_path / "c"), hashing_encoder(16), parsers={"pdf": parse})
    got = {r["file_name"]: (r["status"], r["progress"], r["error_message"]) for r in statuses.join(names, "document_id").collect()}
    unknown = lambda kind: ("FAILED", 30, f"{K.MSG_TYPE_UNSUPPORTED}{kind}{K.MSG_TYPE_HINT}")
    assert got == {"a.txt": ("COMPLETED", 100, None), "b.pdf": ("COMPLETED", 100, None), "c.pdf": ("FAILED", 30, "no pages"),
                   "d.exe": unknown(""), "e.doc": unknown("doc")}
    found = processing.usable_chunks(processing.stored_outcomes(spark, str(tmp_path / "c")))
    assert {r["content"] for r in found.collect()} == {"plain", "PAGES"}


def test_stream_goes_on_after_a_refused_batch(spark, tmp_path):
    up, out, checkpoint = tmp_path / "up", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    kbs = spark.createDataFrame([("k1", "one")], "id string, name string")

    def run(name):
        (up / name).parent.mkdir(parents=True, exist_ok=True)
        (up / name).write_text("some text")
        jobs.ingest(spark, str(up), out, checkpoint, hashing_encoder(16), "*", knowledge_bases=kbs).awaitTermination()
        return sorted(r["file_name"] for r in jobs.ingested_documents(spark, out).collect())

    assert run("none/a.txt") == []
    assert jobs.ingested_chunks(spark, out).count() == 0
    assert run("k1/b.txt") == ["b.txt"]
    stages = [(r["status"], r["progress"]) for r in jobs.ingested_stages(spark, out).orderBy("progress").collect()]
    assert stages == [("PARSING", 30), ("CHUNKING", 50), ("EMBEDDING", 70), ("COMPLETED", 100)]


def test_message_log_takes_no_repeat_of_any_time(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    schema = "id string, content string, created_at timestamp"

    def run(*rows):
        spark.createDataFrame(rows, "id string, content string, t string").selectExpr(
            "id", "content", "cast(t AS timestamp) AS created_at").write.mode("append").parquet(source)
        jobs.log_messages(spark.readStream.schema(schema).parquet(source), out, checkpoint).awaitTermination()
        return sorted((r["id"] or "", r["content"]) for r in jobs.logged_messages(spark, out).collect())

    assert run(("1", "a", "2024-01-01 23:59:59"), ("2", "b", None), ("007", "z", None)) == [("007", "z"), ("1", "a"), ("2", "b")]
    more = run(("1", "a", "2024-01-02 00:00:00"), ("2", "b", None), ("2", "b", "2024-05-01 00:00:00"), ("3", "c", None),
               (None, "n", None), (None, "m", None))
    assert more == [("", "m"), ("", "n"), ("007", "z"), ("1", "a"), ("2", "b"), ("3", "c")]


def test_status_table_is_compacted(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    schema = "document_id string, ts timestamp, event_id int, status string"
    for n in range(6):
        spark.createDataFrame([(f"d{n % 4}", f"2024-01-0{n + 1}", n, f"S{n}")], "document_id string, t string, event_id int, status string"
                              ).selectExpr("document_id", "cast(t AS timestamp) AS ts", "event_id", "status").write.mode("append").parquet(source)
        jobs.follow_status(spark.readStream.schema(schema).parquet(source), out, checkpoint, compact=2).awaitTermination()
    got = {r["document_id"]: r["status"] for r in jobs.followed_status(spark, out).collect()}
    assert got == {"d0": "S4", "d1": "S5", "d2": "S2", "d3": "S3"}
    assert sorted(p.name for p in (tmp_path / "out").glob("batch=*")) == ["batch=4", "batch=5"]


def test_deleting_a_knowledge_base_takes_orphans_along(spark):
    kbs = spark.createDataFrame([("k1",), ("k2",)], "id string")
    documents = spark.createDataFrame([("a", "k1"), ("b", "k2")], "document_id string, knowledge_base_id string")
    chunks = spark.createDataFrame([("a", 0, [1.0], "k1"), ("gone", 0, [1.0], "k1"), ("b", 0, [1.0], "k2")], CHUNK)
    history = spark.createDataFrame([("k1",), ("k2",)], "knowledge_base_id string")
    listed = spark.createDataFrame([("k1",)], "id string")
    left = catalog.delete_kbs(kbs, documents, chunks, history, listed)
    assert [df.count() for df in left] == [1, 1, 1, 1] and triples(left[2]) == [("b", "k2", 0)]


def test_unknown_document(spark):
    documents = spark.createDataFrame([("a",)], "document_id string")
    assert catalog.document_by_id(documents, "a").count() == 1
    with pytest.raises(LookupError, match="文档不存在: x"):
        catalog.document_by_id(documents, "x")


def test_null_vectors_have_a_bucket(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0])], "i int, embedding array<float>")
    got = {r["i"]: r["bucket"] for r in add_bucket(df, 2, 3).collect()}
    assert got[1] >= 0 and got[2] == got[3] == got[4] == -1


def test_each_question_is_encoded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        inner = hashing_encoder(16)()

        def encode(texts):
            calls.add(len(texts))
            return inner(texts)
        return encode

    documents = spark.createDataFrame([("d", "k", "COMPLETED")], "document_id string, knowledge_base_id string, status string")
    chunks = embed(spark.createDataFrame([("d", 0, "some text", "k")], "document_id string, chunk_index int, content string, "
                                         "knowledge_base_id string"), hashing_encoder(16))
    questions = embed(spark.createDataFrame([(i, "k", f"text {i}") for i in range(10)], "query_id int, knowledge_base_id string, "
                                            "message string"), counting, text="message")
    assert answering.answer_questions(documents, chunks, questions).count() == 10
    assert calls.value == 10


def test_contents_are_read_from_the_folders_asked_for(spark, tmp_path):
    path = str(tmp_path / "chunks")
    stored = spark.createDataFrame([(f"d{i}", 0, f"text {i}", [1.0, float(i)], f"k{i % 4}") for i in range(20)],
                                   "document_id string, chunk_index int, content string, embedding array<float>, knowledge_base_id string")
    tables.write_chunks(stored, path)
    documents = stored.select("document_id", "knowledge_base_id", F.lit("COMPLETED").alias("status"))
    questions = spark.createDataFrame([(1, "k2", [1.0, 0.0])], "query_id int, knowledge_base_id string, embedding array<float>")
    found = answering.hits_with_content(documents, tables.scan(spark, path), questions)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [part for part in plan.split("FileScan parquet")[1:]]
    assert scans and all("knowledge_base_id" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)
    assert sorted(r["content"] for r in found.collect()) == ["text 10", "text 2", "text 6"]


def test_an_encoder_that_breaks_its_contract_ends_the_job(spark):
    def factory():
        return lambda texts: [[1.0]] * (len(texts) + 1)

    df = spark.createDataFrame([("a",), ("b",)], "content string")
    with pytest.raises(Exception, match="one vector per text"):
        embed(df, factory).collect()


def test_an_encoder_that_is_down_ends_the_job(spark):
    def factory():
        def encode(texts):
            raise RuntimeError("down")
        return encode

    df = spark.range(1500).selectExpr("cast(id AS string) AS content").coalesce(1)
    with pytest.raises(Exception, match="texts in a row"):
        embed(df, factory).collect()
    assert embed(df.limit(900), factory).where("size(embedding) = 0").count() == 900


def test_recall_of_the_approximate_search_on_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 64))
    vectors = np.concatenate([c + 0.15 * rng.standard_normal((20, 64)) for c in centres])
    rows = [(str(i), 0, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "document_id string, chunk_index int, embedding array<float>")
    asked = df.where("cast(document_id AS int) % 6 = 0").withColumnRenamed("document_id", "query_id").drop("chunk_index")
    exact = {tuple(r) for r in top_k(df, asked, 5).select("query_id", "document_id").collect()}
    kept = add_bucket(df, 64, 6)
    found = {tuple(r) for r in top_k_probed(kept, asked, 64, 6, 12, 5).select("query_id", "document_id").collect()}
    assert len(exact & found) >= 0.95 * len(exact)
    size = {r["bucket"]: r["count"] for r in kept.groupBy("bucket").count().collect()}
    visited = sum(size.get(r["bucket"], 0) for r in add_probes(asked, 64, 6, 12).collect())
    assert visited <= 0.25 * len(rows) * asked.count()


@pytest.mark.parametrize("within", [None, "knowledge_base_id"])
def test_blocks_of_questions_are_scanned_in_turn(spark, within):
    rng = np.random.default_rng(2)
    rows = [(f"d{i}", 0, rng.standard_normal(8).tolist(), f"k{i % 3}") for i in range(120)]
    df = spark.createDataFrame(rows, CHUNK)
    asked = df.limit(40).withColumnRenamed("document_id", "query_id").drop("chunk_index")
    got = top_k(df, asked, 4, within=within, question_bytes=table_size(asked)[1] // 3)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, top_k(df, asked, 4, within=within).collect()))
