"""Conversation history: (id, session_id, knowledge_base_id, role, content, created_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.session import broadcast_if_small


def by_session(history: DataFrame, session_id: str) -> DataFrame:
    """Messages of one session, oldest first."""
    return history.where(F.col("session_id") == session_id).orderBy("created_at", "id")


def by_knowledge_base(history: DataFrame, knowledge_base_id: str) -> DataFrame:
    """Messages of one knowledge base, newest first."""
    return history.where(F.col("knowledge_base_id") == knowledge_base_id).orderBy(
        F.desc("created_at"), F.desc("id"))


def messages(history: DataFrame) -> DataFrame:
    """The part of a message a model is given."""
    return history.select("role", "content")


def sessions(history: DataFrame) -> DataFrame:
    """Session list, newest first: title and time from the first message of each.

    Titles are cut before the aggregation, so message texts are not shuffled.
    """
    order = F.struct("created_at", "id")
    title = tx.session_title(F.col("content"))
    return (history.select("session_id", "created_at", "id", title.alias("title"))
            .groupBy("session_id")
            .agg(F.min_by("title", order).alias("title"), F.min("created_at").alias("last_time"))
            .withColumn("last_date", tx.display_date(F.col("last_time")))
            .orderBy(F.desc("last_time"), "session_id"))


def last_messages(history: DataFrame, n: int) -> DataFrame:
    """The last n messages of every session, with ``position`` 1 for the newest.

    Spark limits every group to n rows before the shuffle, so a long session is
    never gathered whole.
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return history.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= n)


def prior_turns(history: DataFrame) -> DataFrame:
    """All messages but the last of each session.

    The last ids are found by a partial aggregation and removed by a join on
    the unique id, which no long session can skew.
    """
    newest = F.max(F.struct("created_at", "id"))["id"]
    last = history.groupBy("session_id").agg(newest.alias("id")).select("id")
    return history.join(last, "id", "left_anti")


def delete_by(history: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """History without the rows whose ``column`` is listed (a session or a knowledge base)."""
    return history.join(broadcast_if_small(keys.select(column).distinct()), column, "left_anti")
