"""Retrieval: which chunks answer which question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions import text as tx
from corpusflow.functions import vectors as vx
from corpusflow.operators.topk import top_k, within_scopes
from corpusflow.session import BROADCAST_BYTES, broadcast_if_small, broadcast_or_none


def completed(documents: DataFrame) -> DataFrame:
    """Documents that may be used for answers."""
    return documents.where(F.col("status") == "COMPLETED")


def kb_chunks(documents: DataFrame, chunks: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Chunks of completed documents, with the knowledge base of the document.

    A chunk without document, or a stored one without knowledge base, belongs
    to no document; a document listed twice gives its chunks once.

    Vectors are not shuffled as long as one of two lists is small: the
    completed documents or, for stored chunks that carry their knowledge base,
    the documents among them that are not completed.  The second list costs a
    shuffle of ids only.
    """
    stored = "knowledge_base_id" in chunks.columns
    on = ["document_id", "knowledge_base_id"] if stored else ["document_id"]
    keys = completed(documents).select("document_id", "knowledge_base_id").distinct()
    small = broadcast_or_none(keys, limit)
    if not stored:
        return chunks.join(keys if small is None else small, on)
    if small is not None:
        return chunks.join(small, on, "left_semi")
    named = chunks.where("document_id IS NOT NULL AND knowledge_base_id IS NOT NULL")
    others = named.select(*on).distinct().join(keys, on, "left_anti")
    return named.join(broadcast_if_small(others, limit), on, "left_anti")


def asked_chunks(documents: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Chunks of completed documents of the knowledge bases asked for.

    To be used before chunks are encoded: Catalyst moves no filter below an encoder.
    """
    scopes = broadcast_if_small(questions.select("knowledge_base_id").distinct())
    return kb_chunks(documents.join(scopes, "knowledge_base_id", "left_semi"), chunks)


def score_chunks(chunks: DataFrame, question: Sequence[float], metric: str = "cosine") -> DataFrame:
    """Every chunk with its score against one question vector; nothing is dropped
    but chunks without a vector."""
    asked = F.array(*[F.lit(float(x)) for x in question]).cast("array<float>")
    vector = F.col("embedding")
    if metric == "cosine":
        norm2 = float(sum(float(x) * float(x) for x in question))
        score = vx.cosine(vector, asked, norm2_b=F.lit(norm2))
    else:
        score = vx.distance_score(vx.squared_distance(vector, asked))
    return chunks.where(vx.is_usable(vector)).withColumn("score", score)


def top_k_single(chunks: DataFrame, question: Sequence[float], k: int = K.TOP_K,
                 metric: str = "cosine") -> DataFrame:
    """The k best chunks for one question vector; an empty vector finds nothing."""
    one = chunks.sparkSession.createDataFrame(
        [(0, [float(x) for x in question])], "query_id int, embedding array<float>")
    return top_k(chunks, one, k, metric).drop("query_id")


def _renumber(hits: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_index")
    return hits.withColumn("rank", F.row_number().over(order))


def retrieve(documents: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = K.TOP_K,
             metric: str = "cosine", scope: str = "kb", chosen: bool = False) -> DataFrame:
    """Hits per question: query_id, document_id, chunk_index, score, rank.

    ``kb``: the k best among the completed documents of the question's
    knowledge base.  ``global_then_filter``: the k best of all chunks, of which
    those of completed documents of that knowledge base are kept, so there may
    be fewer than k.  ``chosen``: the chunks are those of :func:`asked_chunks`
    already, for scope ``kb``.
    """
    if scope == "kb":
        if chosen:
            return top_k(chunks, questions, k, metric, within="knowledge_base_id")
        return top_k(kb_chunks(documents, chunks), questions, k, metric, within="knowledge_base_id")
    if scope != "global_then_filter":
        raise ValueError("scope must be kb or global_then_filter")
    asked = questions.select("query_id", "knowledge_base_id")
    hits = top_k(chunks, questions, k, metric).drop("rank").join(asked, "query_id")
    usable = completed(documents).select("document_id", "knowledge_base_id")
    # document_id is unique, so this join only filters; written this way round
    # the few hits are what travels.
    kept = usable.join(broadcast_if_small(hits), ["document_id", "knowledge_base_id"])
    return _renumber(kept.select("query_id", "document_id", "chunk_index", "score"))


def with_content(hits: DataFrame, chunks: DataFrame, questions: DataFrame, scope: str = "kb",
                 chosen: bool = False) -> DataFrame:
    """Fetch the text of the hits only after they are chosen.

    Hits within the knowledge base of the question are looked for only there:
    of chunks stored by knowledge base the other folders are not read.
    ``chosen``: the chunks are those of :func:`asked_chunks` already.
    """
    on = ["document_id", "chunk_index"]
    texts = chunks.select(*on, "content")
    if not chosen and scope == "kb" and {"knowledge_base_id"} <= set(chunks.columns) & set(questions.columns):
        texts = within_scopes(chunks, questions, "knowledge_base_id").select(*on, "content", "knowledge_base_id")
        hits = hits.join(questions.select("query_id", "knowledge_base_id"), "query_id")
        on = [*on, "knowledge_base_id"]
    return texts.join(broadcast_if_small(hits), on).drop("knowledge_base_id")


def project_hits(hits: DataFrame) -> DataFrame:
    """Hits as query_id, rank, content, source, score."""
    source = tx.chunk_key(F.col("document_id"), F.col("chunk_index"))
    return hits.select("query_id", "rank", "content", source.alias("source"), "score")


def read_metadata(records: DataFrame) -> DataFrame:
    """Document id and position from a metadata map, with '' and '0' for missing keys."""
    entry = lambda key, default: F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit(default))
    return (records.withColumn("document_id", entry("documentId", ""))
            .withColumn("chunk_index", entry("chunkIndex", "0")).drop("metadata"))


def valid_hits(hits: DataFrame) -> DataFrame:
    """Hits whose document id is a UUID."""
    return hits.where(tx.is_uuid(F.col("document_id")))
