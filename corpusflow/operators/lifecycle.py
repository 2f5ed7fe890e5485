"""Status of documents from the outcome of their chunks and from status events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K


def final_status(succeeded: Column) -> Column:
    return F.when(succeeded == 0, "FAILED").otherwise("COMPLETED")


def final_message(succeeded: Column, failed: Column) -> Column:
    partly = F.concat(F.lit(K.MSG_SOME_CHUNKS_FAILED), succeeded.cast("string"),
                      F.lit(K.MSG_SOME_CHUNKS_FAILED_2), failed.cast("string"))
    return F.when(succeeded == 0, F.lit(K.MSG_ALL_CHUNKS_FAILED)).when(failed > 0, partly)


def document_status(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Final status per document from chunk outcomes (document_id, ok).

    Outcomes are counted before the shuffle; a document without any is FAILED.
    """
    counts = outcomes.groupBy("document_id").agg(
        F.count_if(F.col("ok")).alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
    ok, failed = F.coalesce("n_ok", F.lit(0)), F.coalesce("n_failed", F.lit(0))
    return documents.select("document_id").join(counts, "document_id", "left").select(
        "document_id", final_status(ok).alias("status"), F.lit(100).alias("progress"),
        ok.cast("int").alias("chunk_count"), failed.cast("int").alias("failed_count"),
        final_message(ok, failed).alias("error_message"))


def latest_status(events: DataFrame) -> DataFrame:
    """Last status per document from (document_id, ts, event_id, status); also for streams."""
    last = F.max(F.struct("ts", "event_id", "status"))
    return (events.groupBy("document_id").agg(last.alias("last"))
            .select("document_id", "last.status", "last.ts"))
