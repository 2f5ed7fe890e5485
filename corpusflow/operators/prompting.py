"""Contexts, prompts and what is said when there is no model answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions import text as tx
from corpusflow.session import broadcast_if_small


def _items(hits: DataFrame) -> DataFrame:
    item = F.concat(F.lit(K.CONTEXT_ITEM_OPEN), F.col("rank").cast("string"),
                    F.lit(K.CONTEXT_ITEM_CLOSE), F.col("content"), F.lit(K.CONTEXT_ITEM_END))
    return hits.withColumn("item", item)


def _context() -> Column:
    body = F.expr("listagg(item, '') WITHIN GROUP (ORDER BY rank)")
    return F.concat(F.lit(K.CONTEXT_HEAD), body).alias("context")


def _sources() -> Column:
    entry = F.struct("rank", tx.chunk_key(F.col("document_id"), F.col("chunk_index")).alias("source"), "score")
    return F.array_sort(F.collect_list(entry)).alias("sources")


def build_context(hits: DataFrame) -> DataFrame:
    """One context per question from its ranked hits (query_id, rank, content)."""
    return _items(hits).groupBy("query_id").agg(_context())


def sources(hits: DataFrame) -> DataFrame:
    """Per question the ordered list of its sources; at most k entries each."""
    return hits.groupBy("query_id").agg(_sources())


def context_and_sources(hits: DataFrame) -> DataFrame:
    """Both in one aggregation, so that the retrieval behind them runs once."""
    return _items(hits).groupBy("query_id").agg(_context(), _sources())


def prompt_text(context: Column, message: Column, history: Column | None = None) -> Column:
    """The prompt; with ``history`` a section of earlier turns follows the context."""
    parts = [F.lit(K.PROMPT_HEAD), context]
    if history is not None:
        section = F.concat(F.lit(K.HISTORY_HEAD), history)
        parts.append(F.when(history != "", section).otherwise(F.lit("")))
    parts += [F.lit(K.PROMPT_QUESTION), message, F.lit(K.PROMPT_TAIL)]
    return F.concat(*parts)


def build_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """query_id, message, prompt for every question that has a context."""
    return (questions.select("query_id", "message").join(contexts, "query_id")
            .select("query_id", "message",
                    prompt_text(F.col("context"), F.col("message")).alias("prompt")))


def history_text(window: DataFrame) -> DataFrame:
    """One text of the turns of a history window (session_id, role, content, created_at, id)."""
    turn = F.concat_ws(": ", "role", "content")
    return (window.select("session_id", "created_at", "id", turn.alias("turn"))
            .groupBy("session_id")
            .agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("created_at", "id", "turn"))),
                lambda t: t["turn"]), "\n").alias("history")))


def build_prompts_with_history(questions: DataFrame, contexts: DataFrame, window: DataFrame) -> DataFrame:
    """Prompts of questions (query_id, session_id, message) with their dialogue so far."""
    prompt = prompt_text(F.col("context"), F.col("message"), F.coalesce("history", F.lit("")))
    return (questions.join(contexts, "query_id")
            .join(history_text(window), "session_id", "left")
            .select("query_id", "session_id", "message", prompt.alias("prompt")))


def readiness(documents: DataFrame) -> DataFrame:
    """Per knowledge base: any completed document, any document in progress."""
    return documents.groupBy("knowledge_base_id").agg(
        F.bool_or(F.coalesce(F.col("status") == "COMPLETED", F.lit(False))).alias("has_completed"),
        F.bool_or(F.coalesce(F.col("status").isin(*K.IN_PROGRESS_STATUSES), F.lit(False)))
        .alias("has_processing"))


def guard_answers(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ``ready`` and, for a knowledge base without completed document, the fixed ``answer``."""
    flags = broadcast_if_small(readiness(documents).select("knowledge_base_id", "has_completed"))
    ready = F.coalesce("has_completed", F.lit(False))
    return (questions.join(flags, "knowledge_base_id", "left")
            .withColumn("ready", ready)
            .withColumn("answer", F.when(~ready, F.lit(K.ANSWER_NO_DOCUMENTS)))
            .drop("has_completed"))


def classify_answer(answer: Column, error: Column) -> Column:
    """What the asker is told for a model's answer or error."""
    broke = F.lit(False)
    for mark in K.BALANCE_ERROR_MARKS:
        broke = broke | error.contains(mark)
    failed = F.when(broke, K.ANSWER_NO_BALANCE).otherwise(K.ANSWER_UNAVAILABLE)
    silent = answer.isNull() | (answer == "")
    return (F.when(error.isNotNull(), failed)
            .when(silent, F.lit(K.ANSWER_NO_BALANCE)).otherwise(answer))
