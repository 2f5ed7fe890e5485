import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.operators.embedding import embed, hashing_encoder
from corpusflow.operators import retrieval
from corpusflow.operators.generation import generate
from corpusflow.plans import answering, processing
from corpusflow.session import broadcast_if_small, table_size, work_path
from corpusflow.sources import files, tables
from corpusflow.streaming import jobs


@pytest.fixture
def uploads(tmp_path):
    folder = tmp_path / "uploads"
    contents = {
        "k1/plain.txt": "knowledge about spark tables".encode(),
        "k1/gbk 文.txt": "你好 世界".encode("gbk"),
        "k1/a+b%20c.txt": b"plus and percent",
        "k2/blank.txt": b" \n\t ",
        "k2/long.txt": ("word " * 300).encode(),
        "k2/program.exe": b"MZ",
    }
    for name, data in contents.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return folder


@pytest.fixture
def failing_encoder():
    """An encoder that breaks down on texts with "bad"; local, so workers get it by value."""

    def factory():
        inner = hashing_encoder(16)()

        def encode(texts):
            if any("bad" in t for t in texts.to_pylist()):
                raise RuntimeError("model down")
            return inner(texts)

        return encode

    return factory


def test_files_become_documents(spark, uploads):
    got = {(r["knowledge_base_id"], r["file_name"]): r for r in files.ingest_files(spark, str(uploads)).collect()}
    assert set(got) == {("k1", "plain.txt"), ("k1", "gbk 文.txt"), ("k1", "a+b%20c.txt"), ("k2", "blank.txt"),
                        ("k2", "long.txt"), ("k2", "program.exe")}
    one = got["k1", "plain.txt"]
    assert (one["status"], one["progress"], one["file_type"], one["chunk_count"]) == ("UPLOADING", 10, "txt", 0)
    assert got["k2", "program.exe"]["file_type"] == ""
    again = {r["document_id"] for r in files.ingest_files(spark, str(uploads)).collect()}
    assert again == {r["document_id"] for r in got.values()} and len(again) == 6


def test_decoding(spark):
    cases = ["grün".encode(), "你好".encode("gbk"), b"", None, b"ok\xff\xff"]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(cases)], "i int, c binary")
    got = [r[1] for r in df.select("i", files.decode_text(F.col("c"))).orderBy("i").collect()]
    assert got[:4] == ["grün", "你好", "", None] and got[4].startswith("ok") and "�" in got[4]


def test_failing_texts_get_empty_vectors(spark, failing_encoder):
    df = spark.createDataFrame([(1, "good one"), (2, "bad"), (3, None), (4, " "), (5, "two good")], "i int, content string")
    got = {r["i"]: r["embedding"] for r in embed(df.coalesce(1), failing_encoder).collect()}
    assert [len(got[i]) for i in range(1, 6)] == [16, 0, 0, 0, 16]
    assert np.linalg.norm(got[1]) == pytest.approx(1.0)


def test_statuses_of_processing(spark, tmp_path, failing_encoder):
    documents = spark.createDataFrame(
        [("ok", "k1", "fine text"), ("blank", "k1", " \x01\n"), ("none", "k2", "bad"), ("null", "k2", None),
         ("part", "k2", "g" * 470 + " bad")], "document_id string, knowledge_base_id string, text string")
    path = str(tmp_path / "chunks")
    statuses = processing.process_to(documents, path, failing_encoder)
    got = {r["document_id"]: (r["status"], r["progress"], r["chunk_count"], r["error_message"]) for r in statuses.collect()}
    assert got == {
        "ok": ("COMPLETED", 100, 1, None), "blank": ("FAILED", 30, 0, K.MSG_NO_TEXT), "null": ("FAILED", 30, 0, K.MSG_NO_TEXT),
        "none": ("FAILED", 100, 0, K.MSG_ALL_CHUNKS_FAILED), "part": ("FAILED", 100, 0, K.MSG_ALL_CHUNKS_FAILED)}
    chunks = processing.usable_chunks(processing.stored_outcomes(spark, path))
    assert [tuple(r) for r in chunks.select("document_id", "chunk_index").collect()] == [("ok", 0)]


def test_model_errors_are_rows(spark):
    def model():
        def call(prompt):
            if prompt == "boom":
                raise RuntimeError("insufficient_balance")
            return prompt.upper()
        return call

    df = spark.createDataFrame([("a",), ("boom",), (None,)], "prompt string")
    got = sorted((r["prompt"] or "", r["answer"], r["error"]) for r in generate(df, model).collect())
    assert got == [("", None, None), ("a", "A", None), ("boom", None, "insufficient_balance")]


def test_answers(spark):
    encoder = hashing_encoder(64)
    documents = spark.createDataFrame([("d1", "k1", "COMPLETED"), ("d2", "k2", "FAILED"), ("d3", "k3", "COMPLETED")],
                                      "document_id string, knowledge_base_id string, status string")
    chunks = embed(spark.createDataFrame(
        [("d1", 0, "spark joins tables", "k1"), ("d1", 1, "cats sleep", "k1"), ("d2", 0, "spark", "k2")],
        "document_id string, chunk_index int, content string, knowledge_base_id string"), encoder)
    questions = embed(spark.createDataFrame(
        [(1, "k1", "how do cats sleep"), (2, "k2", "spark"), (3, "k3", "spark"), (4, "k4", "spark")],
        "query_id int, knowledge_base_id string, message string"), encoder, text="message")
    got = {r["query_id"]: r for r in answering.answer_questions(documents, chunks, questions, k=2).collect()}
    assert got[1]["answer"] == "cats sleep"
    assert [(s["rank"], s["source"]) for s in got[1]["sources"]] == [(1, "d1_1"), (2, "d1_0")]
    assert all(got[i]["answer"] == K.ANSWER_NO_DOCUMENTS for i in (2, 3, 4))
    calls = spark.sparkContext.accumulator(0)

    def counting_model():
        def call(prompt):
            calls.add(1)
            raise RuntimeError("timeout")
        return call

    told = answering.answer_questions(documents, chunks, questions, counting_model).collect()
    assert {r["query_id"]: r["answer"] for r in told}[1] == K.ANSWER_UNAVAILABLE
    assert calls.value == 1


def test_from_files_to_answers(spark, uploads, tmp_path):
    encoder = hashing_encoder(32)
    documents = files.ingest_files(spark, str(uploads), "*.txt")
    statuses = processing.process_to(documents, str(tmp_path / "chunks"), encoder)
    chunks = processing.usable_chunks(processing.stored_outcomes(spark, str(tmp_path / "chunks")))
    questions = spark.createDataFrame([(1, "k1", "what are Spark tables"), (2, "k3", "anything")],
                                      "query_id int, knowledge_base_id string, message string")
    got = {r["query_id"]: r["answer"] for r in answering.answer_questions(
        statuses, chunks, embed(questions, encoder, text="message")).collect()}
    assert got == {1: "knowledge about spark tables", 2: K.ANSWER_NO_DOCUMENTS}


def test_stored_chunks_lose_deleted_documents(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [("a", 0, "k/1"), ("b", 0, "k/1"), ("c", 0, "7"), ("d", 0, "9")]
    tables.write_chunks(spark.createDataFrame(rows, "document_id string, chunk_index int, knowledge_base_id string"), path)
    listed = spark.createDataFrame([("a", "k/1"), ("c", "7")], "document_id string, knowledge_base_id string")
    tables.delete_documents_from(spark, path, listed)
    left = tables.scan(spark, path).select("document_id", F.col("knowledge_base_id").cast("string"))
    assert sorted(map(tuple, left.collect())) == [("b", "k/1"), ("d", "9")]
    tables.delete_knowledge_bases_from(spark, path, spark.createDataFrame([("k/1",)], "knowledge_base_id string"))
    assert [r["document_id"] for r in tables.scan(spark, path).collect()] == ["d"]


def test_retrieval_reads_only_the_folders_asked_for(spark, tmp_path):
    path = str(tmp_path / "chunks")
    stored = spark.createDataFrame([(f"d{i}", 0, [1.0, float(i)], f"k{i % 4}") for i in range(20)],
                                   "document_id string, chunk_index int, embedding array<float>, knowledge_base_id string")
    tables.write_chunks(stored, path)
    documents = stored.select("document_id", "knowledge_base_id", F.lit("COMPLETED").alias("status"))
    questions = spark.createDataFrame([(1, "k2", [1.0, 0.0])], "query_id int, knowledge_base_id string, embedding array<float>")
    hits = retrieval.retrieve(documents, tables.scan(spark, path), questions)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(knowledge_base_id" in plan and "= k2" in plan
    assert [r["document_id"] for r in hits.orderBy("rank").collect()] == ["d2", "d6", "d10"]


def test_stream_ingest_takes_each_file_once(spark, uploads, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        jobs.ingest(spark, str(uploads), out, checkpoint, hashing_encoder(16)).awaitTermination()
        return {r["file_name"]: (r["status"], r["chunk_count"]) for r in jobs.ingested_documents(spark, out).collect()}

    first = run()
    assert first == {"plain.txt": ("COMPLETED", 1), "gbk 文.txt": ("COMPLETED", 1), "a+b%20c.txt": ("COMPLETED", 1),
                     "blank.txt": ("FAILED", 0), "long.txt": ("COMPLETED", 4)}
    assert run() == first
    (uploads / "k1" / "later.txt").write_text("arrived later")
    assert run() == {**first, "later.txt": ("COMPLETED", 1)}
    chunks = jobs.ingested_chunks(spark, out)
    assert chunks.count() == 8 and "你好 世界" in {r["content"] for r in chunks.collect()}


def test_stream_ingest_opens_a_file_once(spark, uploads, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    query = jobs.ingest(spark, str(uploads), out, checkpoint, hashing_encoder(16))
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    assert read == jobs.ingested_documents(spark, out).count() == 5


def test_stream_ingest_checks_uploads(spark, uploads, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    kbs = spark.createDataFrame([("k1", "one")], "id string, name string")

    def upper(documents):
        return documents.withColumn("text", F.upper(files.decode_text(F.col("content"))))

    def run():
        jobs.ingest(spark, str(uploads), out, checkpoint, hashing_encoder(16), "*", knowledge_bases=kbs,
                    extractor=upper).awaitTermination()
        return sorted(r["file_name"] for r in jobs.ingested_documents(spark, out).collect())

    assert run() == ["a+b%20c.txt", "gbk 文.txt", "plain.txt"]
    refused = {r["file_name"]: r["reason"] for r in jobs.rejected_files(spark, out).collect()}
    assert set(refused) == {"blank.txt", "long.txt", "program.exe"} and refused["long.txt"] == "知识库不存在: k2"
    (uploads / "k1" / "tool.exe").write_bytes(b"MZ")
    (uploads / "k1" / "late.txt").write_text("late")
    assert run() == ["a+b%20c.txt", "gbk 文.txt", "late.txt", "plain.txt"]
    assert jobs.rejected_files(spark, out).where("file_name = 'tool.exe'").first()["reason"].startswith("不支持的文件类型")
    assert "KNOWLEDGE ABOUT SPARK TABLES" in {r["content"] for r in jobs.ingested_chunks(spark, out).collect()}


def test_message_log_is_free_of_repeats(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    schema = "id string, content string, created_at timestamp"

    def add(*ids):
        spark.createDataFrame([(i, f"text {i}") for i in ids], "id string, content string").withColumn(
            "created_at", F.lit("2024-01-01 10:00:00").cast("timestamp")).write.mode("append").parquet(source)

    def run():
        jobs.log_messages(spark.readStream.schema(schema).parquet(source), out, checkpoint).awaitTermination()
        return sorted(r["id"] for r in jobs.logged_messages(spark, out).collect())

    add("1", "2", "2")
    assert run() == ["1", "2"]
    add("2", "3")
    assert run() == ["1", "2", "3"]
    assert run() == ["1", "2", "3"]


def test_status_stream_over_several_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    schema = "document_id string, ts timestamp, event_id int, status string"

    def add(*events):
        spark.createDataFrame(events, "document_id string, t string, event_id int, status string").selectExpr(
            "document_id", "cast(t AS timestamp) AS ts", "event_id", "status").write.mode("append").parquet(source)

    def run():
        jobs.follow_status(spark.readStream.schema(schema).parquet(source), out, checkpoint).awaitTermination()
        return {r["document_id"]: r["status"] for r in jobs.followed_status(spark, out).collect()}

    add(("a", "2024-01-01", 1, "UPLOADING"), ("a", "2024-01-02", 2, "PARSING"), ("b", "2024-01-01", 3, "UPLOADING"))
    assert run() == {"a": "PARSING", "b": "UPLOADING"}
    add(("a", "2024-01-01 12:00:00", 4, "CHUNKING"), ("b", "2024-01-03", 5, "COMPLETED"))
    assert run() == {"a": "PARSING", "b": "COMPLETED"}


@pytest.mark.parametrize("rows,limit,sent", [(1000, 1 << 26, True), (60_000, 1 << 26, True), (1000, 1000, False),
                                             (60_000, 1 << 20, False)])
def test_broadcast_only_within_the_limit(spark, rows, limit, sent):
    df = spark.range(rows).selectExpr("id", "repeat('x', 100) AS t")
    got = broadcast_if_small(df, limit)
    assert ("ResolvedHint" in got._jdf.queryExecution().analyzed().toString()) == sent
    assert table_size(got) == table_size(df) and table_size(df)[1] >= rows * 108


def test_work_path_is_fresh(spark):
    assert work_path(spark, "x") != work_path(spark, "x")


def test_jdbc_options(spark, monkeypatch):
    seen = {}

    class Reader:
        def format(self, name):
            seen["format"] = name
            return self

        def option(self, key, value):
            seen[key] = value
            return self

        def options(self, **more):
            seen.update(more)
            return self

        def load(self):
            return "frame"

    session = type("Session", (), {"read": Reader()})()
    assert tables.read_jdbc(session, "jdbc:x", "document", "id", 0, 10, 4, user="u") == "frame"
    assert seen == {"format": "jdbc", "url": "jdbc:x", "dbtable": "document", "partitionColumn": "id", "lowerBound": 0,
                    "upperBound": 10, "numPartitions": 4, "user": "u"}
