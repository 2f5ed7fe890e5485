"""The collection tables as views over the given parquet tables.

Each function reads whole tables; see FIXTURES.md for the mapping.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators.chunking import chunk_documents, fixed_chunks
from corpusflow.operators.embedding import embed, hashing_encoder
from corpusflow.session import spread


# Columns of the given tables.  With the schema stated no file has to be opened
# before the query runs.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _moment(days="0", minutes="0", seconds="0"):
    return F.expr("timestamp_ntz'2024-01-01 00:00:00' + "
                  f"make_dt_interval(cast({days} as int), 0, cast({minutes} as int), {seconds})")


def knowledge_base(spark, folder) -> DataFrame:
    names = table(spark, folder, "documents").select(F.col("source").alias("id")).distinct()
    created = _moment(days="substring(id, 4)")
    return names.select("id", F.col("id").alias("name"),
                        F.concat(F.lit("collection "), "id").alias("description"),
                        created.alias("created_at"), created.alias("updated_at"))


def document(spark, folder) -> DataFrame:
    """document_id, knowledge_base_id, file_name, file_type, status, text."""
    return _document(spark, folder, table(spark, folder, "documents"))


def _document(spark, folder, texts) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    status = (F.when(F.col("quality") == 0, "FAILED")
              .when(F.col("quality").isNull() & (F.col("doc_id") % 10 == 0), "EMBEDDING")
              .otherwise("COMPLETED"))
    return (texts.join(labels, "doc_id", "left")
            .select(F.col("doc_id").alias("document_id"), F.col("source").alias("knowledge_base_id"),
                    name.alias("file_name"), tx.file_type(name).alias("file_type"),
                    status.alias("status"), "text"))


def extracted(spark, folder) -> DataFrame:
    """Documents as text extraction leaves them: nothing but white space for failed ones."""
    blank = F.lit("\t \n\x01")
    documents = _document(spark, folder, spread(table(spark, folder, "documents"), "doc_id"))
    return documents.withColumn(
        "text", F.when(F.col("status") == "FAILED", blank).otherwise(F.col("text")))


def source_text(spark, folder) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("knowledge_base_id"), "text")


def chunk_text(spark, folder) -> DataFrame:
    """document_id, knowledge_base_id, chunk_index, content."""
    return chunk_documents(source_text(spark, folder))


def paragraph_text(spark, folder) -> DataFrame:
    return source_text(spark, folder).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def documents_count(spark, folder) -> int:
    """Number of documents, which comes from file footers."""
    return max(1, table(spark, folder, "documents").count())


def chunk_vector(spark, folder, n: int | None = None) -> DataFrame:
    """document_id, chunk_index, embedding, label of the stored vectors, dealt over all ``n`` documents."""
    n = n or documents_count(spark, folder)
    return table(spark, folder, "embeddings").select(
        (F.col("vec_id") % n).alias("document_id"),
        F.expr(f"cast(vec_id div {n} as int)").alias("chunk_index"), "embedding", "label", "vec_id")


def vector_text(spark, folder, n: int | None = None) -> DataFrame:
    """Text of the stored vectors: positions beyond the last chunk start again at the first."""
    places = chunk_vector(spark, folder, n).select("document_id", "chunk_index")
    # Only documents that have vectors are cut.
    wanted = (table(spark, folder, "documents").withColumnRenamed("doc_id", "document_id")
              .join(places.select("document_id").distinct(), "document_id", "left_semi")
              .select("document_id", fixed_chunks(F.col("text")).alias("chunks")))
    return (places.join(wanted, "document_id")
            .select("document_id", "chunk_index",
                    F.try_element_at("chunks", (F.try_mod(F.col("chunk_index"), F.size("chunks")) + 1)
                                     .cast("int")).alias("content")))


def question(spark, folder, n: int | None = None) -> DataFrame:
    """query_id, knowledge_base_id, session_id, message, embedding: every stored vector asks."""
    document_id = F.col("vec_id") % (n or documents_count(spark, folder))
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("src"), (document_id % 20).cast("string")).alias("knowledge_base_id"),
        F.col("vec_id").cast("string").alias("session_id"),
        F.concat(F.lit("question "), F.col("vec_id").cast("string"), F.lit(" about "),
                 F.col("label").cast("string")).alias("message"), "embedding")


def asked_text(spark, folder) -> DataFrame:
    """query_id, knowledge_base_id, message: questions in words, some to unknown knowledge bases."""
    return _asked(table(spark, folder, "benchmark"))


def asked_text_stream(spark, folder) -> DataFrame:
    return _asked(_stream(spark, folder, "benchmark"))


def _asked(items: DataFrame) -> DataFrame:
    return items.select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("knowledge_base_id"),
        F.col("text").alias("message"))


def hashed_chunks(spark, folder) -> DataFrame:
    return embed(chunk_text(spark, folder), hashing_encoder())


def hashed_questions(spark, folder) -> DataFrame:
    return embed(asked_text(spark, folder), hashing_encoder(), text="message")


def chat_history(spark, folder) -> DataFrame:
    return _history(table(spark, folder, "conversations"))


def _history(conversations: DataFrame) -> DataFrame:
    session = F.col("conv_id").cast("string")
    return conversations.select(
        F.concat_ws("_", session, F.col("turn").cast("string")).alias("id"),
        session.alias("session_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("knowledge_base_id"),
        "role", F.col("text").alias("content"),
        _moment(minutes="conv_id", seconds="turn").alias("created_at"))


def _stream(spark, folder, name) -> DataFrame:
    # The last letter as a pattern: a stream takes a pattern that one file answers, or a folder of files, but no plain file.
    plain = re.sub(r"([][{}*?\\])", r"\\\1", folder)
    return spark.readStream.schema(SCHEMAS[name]).parquet(f"{plain}/{name}.parque[t]")


def chat_history_stream(spark, folder) -> DataFrame:
    return _history(_stream(spark, folder, "conversations"))


def _status_events(events: DataFrame) -> DataFrame:
    names = {"signup": "UPLOADING", "view": "PARSING", "click": "CHUNKING",
             "purchase": "COMPLETED", "error": "FAILED"}
    status = F.lit(None).cast("string")
    for kind, name in names.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return events.select("event_id", "ts", F.col("user_id").alias("document_id"), status.alias("status"))


def status_event(spark, folder) -> DataFrame:
    return _status_events(table(spark, folder, "events"))


def status_event_stream(spark, folder) -> DataFrame:
    return _status_events(_stream(spark, folder, "events"))


def upload(spark, folder) -> DataFrame:
    """upload_id, knowledge_base_id, file_name: known and unknown bases, all kinds of names."""
    number = F.col("page_id").cast("string")
    name = lambda before, after: F.concat(F.lit(before), number, F.lit(after))
    kind = F.col("page_id") % 10
    file_name = (F.when(kind == 0, name("page_", ".pdf")).when(kind == 1, name("Page ", ".DOCX"))
                 .when(kind == 2, name("setup", ".exe")).when(kind == 3, F.lit(None).cast("string"))
                 .when(kind == 4, F.concat(F.lit("doc_"), (F.col("page_id") % 25).cast("string"), F.lit(".txt")))
                 .when(kind == 5, F.lit("shared.txt")).when(kind == 6, name("notes", ""))
                 .when(kind == 7, name("talk.", ".pptx")).when(kind == 8, name("sheet.tar.", ".xls"))
                 .otherwise(F.lit("Shared.TXT")))
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("upload_id"),
        F.concat(F.lit("src"), (F.col("page_id") % 25).cast("string")).alias("knowledge_base_id"),
        file_name.alias("file_name"))


def kb_request(spark, folder) -> DataFrame:
    """request_id, name of knowledge bases to create."""
    kind = F.col("page_id") % 5
    name = (F.when(kind == 0, F.lit(" \t\n")).when(kind == 2, F.lit(None).cast("string"))
            .when(kind == 1, F.concat(F.lit("src"), (F.col("page_id") % 30).cast("string")))
            .when(kind == 3, F.concat(F.lit("new "), (F.col("page_id") % 7).cast("string")))
            .otherwise(F.concat(F.lit("kb "), F.col("page_id").cast("string"))))
    return table(spark, folder, "pages").select(F.col("page_id").alias("request_id"), name.alias("name"))


def model_outcome(spark, folder) -> DataFrame:
    """query_id, answer, error as a model might return them."""
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    error = (F.when(kind == "error", F.concat(F.lit("timeout after "), F.col("user_id").cast("string")))
             .when((kind == "click") & (F.col("user_id") % 3 == 0), F.lit("code 1008"))
             .when((kind == "click") & (F.col("user_id") % 3 == 1), F.lit("402 insufficient_balance"))
             .when((kind == "click") & (F.col("user_id") % 3 == 2), F.lit("insufficient balance!")))
    answer = (F.when(kind == "view", F.concat(F.lit("answer "), number))
              .when(kind == "signup", F.lit("")))
    return table(spark, folder, "events").select(F.col("event_id").alias("query_id"),
                                                 answer.alias("answer"), error.alias("error"))
