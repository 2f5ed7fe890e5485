"""Knowledge bases, documents and chunks as keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions import text as tx
from corpusflow.session import broadcast_if_small


# --- lookups ----------------------------------------------------------------------

def kb_list(knowledge_bases: DataFrame) -> DataFrame:
    return knowledge_bases.select("id", "name", "description", "created_at", "updated_at")


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns hold the given values; pushed to the scan."""
    for column, value in values.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def require(df: DataFrame, message: str) -> DataFrame:
    """The frame itself, or ``LookupError`` if it has no row."""
    if df.isEmpty():
        raise LookupError(message)
    return df


def kb_by_id(knowledge_bases: DataFrame, kb_id: str) -> DataFrame:
    """The knowledge base, or an error naming the missing id."""
    return require(where_equal(knowledge_bases, id=kb_id), K.MSG_KB_MISSING + kb_id)


def document_by_id(documents: DataFrame, document_id) -> DataFrame:
    """The document, or an error naming the missing id."""
    return require(where_equal(documents, document_id=document_id), f"{K.MSG_DOCUMENT_MISSING}{document_id}")


def vector_ids(chunks: DataFrame, document_id, limit: int | None = None) -> DataFrame:
    """Ids of the vectors of a document; without ``limit`` all of them."""
    found = where_equal(chunks, document_id=document_id).select(
        tx.chunk_key(F.col("document_id"), F.col("chunk_index")).alias("id"))
    return found if limit is None else found.limit(limit)


def document_counts(knowledge_bases: DataFrame, documents: DataFrame) -> DataFrame:
    """Number of documents per knowledge base, 0 included; counted before the join."""
    counts = documents.groupBy("knowledge_base_id").agg(F.count("*").alias("n"))
    return (knowledge_bases.select("id")
            .join(counts.withColumnRenamed("knowledge_base_id", "id"), "id", "left")
            .select("id", F.coalesce("n", F.lit(0)).alias("document_count")))


# --- creation and upload ----------------------------------------------------------

def validate_new_kbs(requests: DataFrame, knowledge_bases: DataFrame) -> DataFrame:
    """Requests (request_id, name, …) with ``reason``: null if the name may be created.

    Of equal names in one batch the first request wins.  The winner per name is
    found by aggregation and joined back by request id, so a name repeated very
    often stays spread over all tasks.
    """
    named = requests.where(tx.has_text(F.col("name")))
    first = named.groupBy("name").agg(F.min("request_id").alias("request_id"))
    fresh = first.join(knowledge_bases.select("name").distinct(), "name", "left_anti").select("request_id")
    taken = F.concat(F.lit(K.MSG_KB_NAME_EXISTS), "name")
    reason = (F.when(~tx.has_text(F.col("name")), F.lit("name is blank"))
              .when(F.col("_fresh").isNull(), taken))
    return (requests.join(fresh.withColumn("_fresh", F.lit(True)), "request_id", "left")
            .withColumn("reason", reason).drop("_fresh"))


def create_kbs(requests: DataFrame, knowledge_bases: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of the knowledge bases that may be created from (request_id, name, description)."""
    now = F.current_timestamp() if now is None else now
    return validate_new_kbs(requests, knowledge_bases).where("reason IS NULL").select(
        tx.stable_id(F.col("name")).alias("id"), "name", "description",
        now.alias("created_at"), now.alias("updated_at"))


def validate_renames(changes: DataFrame, knowledge_bases: DataFrame) -> DataFrame:
    """Changes (id, name, …), unique by id, with ``reason``: null if the knowledge base may have the name.

    A name is taken by any other knowledge base that has it, also by one that
    is renamed in the same batch, and by a change of a smaller id.
    """
    named = changes.where(tx.has_text(F.col("name"))).select("id", "name")
    holders = knowledge_bases.select("name", F.col("id").alias("_holder"))
    first = named.groupBy("name").agg(F.min("id").alias("id"))
    refused = (named.join(holders, "name").where("_holder <> id").select("id")
               .unionByName(named.join(first, ["name", "id"], "left_anti").select("id")).distinct())
    reason = (F.when(~tx.has_text(F.col("name")), F.lit("name is blank"))
              .when(F.col("_refused"), F.concat(F.lit(K.MSG_KB_NAME_EXISTS), "name")))
    return (changes.join(refused.withColumn("_refused", F.lit(True)), "id", "left")
            .withColumn("reason", reason).drop("_refused"))


def update_kbs(knowledge_bases: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """Knowledge bases with name and description of ``changes`` (id, name, description) put in.

    Changes that :func:`validate_renames` gives a reason against are left out.
    """
    now = F.current_timestamp() if now is None else now
    kept = knowledge_bases.select("id", *[c for c in knowledge_bases.columns
                                          if c not in ("id", "name", "description", "updated_at")])
    accepted = validate_renames(changes, knowledge_bases).where("reason IS NULL").select(*changes.columns)
    changed = accepted.join(kept, "id").withColumn("updated_at", now)
    return upsert(knowledge_bases, changed, ["id"])


def validate_uploads(uploads: DataFrame, knowledge_bases: DataFrame, documents: DataFrame) -> DataFrame:
    """Uploads (upload_id, knowledge_base_id, file_name, …) with file_type and ``reason``.

    ``reason`` is null for accepted uploads.  Checks, in this order: the
    knowledge base exists, the type is supported, the name is new in the
    knowledge base.  A name is taken by any document, also by one that failed,
    and by an earlier upload of the batch.
    """
    typed = uploads.withColumn("file_type", tx.file_type(F.col("file_name")))
    known = broadcast_if_small(knowledge_bases.select(F.col("id").alias("knowledge_base_id")).distinct())
    checked = typed.join(known.withColumn("_kb", F.lit(True)), "knowledge_base_id", "left")
    key = ["knowledge_base_id", "file_name"]
    # One candidate per name; names already stored lose it.  Joined back by the
    # unique upload id, so no often-repeated name is gathered in one task.
    first = typed.groupBy(*key).agg(F.min("upload_id").alias("upload_id"))
    fresh = first.join(documents.select(*key), key, "left_anti").select("upload_id")
    reason = (
        F.when(F.col("_kb").isNull(), F.concat(F.lit(K.MSG_KB_MISSING), F.coalesce("knowledge_base_id", F.lit("null"))))
        .when(~tx.is_supported_type(F.col("file_type")),
              F.concat(F.lit(K.MSG_TYPE_UNSUPPORTED), "file_type", F.lit(K.MSG_TYPE_HINT)))
        .when(F.col("_fresh").isNull(), F.concat(F.lit(K.MSG_FILE_EXISTS), "file_name")))
    return (checked.join(fresh.withColumn("_fresh", F.lit(True)), "upload_id", "left")
            .withColumn("reason", reason).drop("_kb", "_fresh"))


# --- changes ----------------------------------------------------------------------

def upsert(stored: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows with the changed ones put in by key; keys in ``changed`` are unique."""
    listed = broadcast_if_small(changed.select(*keys))
    return stored.join(listed, list(keys), "left_anti").select(*stored.columns).unionByName(
        changed.select(*stored.columns))


def delete_by_key(df: DataFrame, listed: DataFrame, key: str, listed_key: str | None = None) -> DataFrame:
    """Rows whose key is not listed."""
    names = listed.select(F.col(listed_key or key).alias(key)).distinct()
    return df.join(broadcast_if_small(names), key, "left_anti").select(*df.columns)


def delete_documents(documents: DataFrame, chunks: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without the listed document ids."""
    return (delete_by_key(documents, listed, "document_id"),
            delete_by_key(chunks, listed, "document_id"))


def delete_kbs(knowledge_bases: DataFrame, documents: DataFrame, chunks: DataFrame, history: DataFrame,
               listed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All four tables without the listed knowledge bases (column ``id``) and what is below them."""
    if "knowledge_base_id" in chunks.columns:
        # Also chunks whose document is gone already.
        left = delete_by_key(chunks, listed, "knowledge_base_id", "id")
    else:
        inside = documents.join(
            broadcast_if_small(listed.select(F.col("id").alias("knowledge_base_id")).distinct()),
            "knowledge_base_id", "left_semi")
        left = delete_by_key(chunks, inside, "document_id")
    return (delete_by_key(knowledge_bases, listed, "id"),
            delete_by_key(documents, listed, "knowledge_base_id", "id"),
            left,
            delete_by_key(history, listed, "knowledge_base_id", "id"))


def orphan_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose document is gone."""
    return delete_by_key(chunks, documents, "document_id")
