"""Structured Streaming jobs.

Every job writes micro-batch n to its own folder ``batch=<n>`` in overwrite
mode, so a micro-batch that runs again after a failure replaces its own output.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusflow import constants as K
from corpusflow.operators.catalog import validate_uploads
from corpusflow.operators.embedding import EncoderFactory, embed
from corpusflow.operators.generation import ModelFactory, first_chunk_model
from corpusflow.operators.lifecycle import latest_status
from corpusflow.plans import answering, processing
from corpusflow.schemas import DOCUMENT, OUTCOME, REJECTED, STAGE
from corpusflow.session import broadcast_if_small, local_if_short
from corpusflow.sources.files import can_list, note_arrivals, stream_arrivals, stream_files, to_documents, with_content
from corpusflow.sources.tables import drop_folders, exists

LOG_PARTS = 64  # folders of the message log


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
           mode: str = "append", every: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, encoder: EncoderFactory,
           pattern: str = "*.txt", strategy: str = "fixed", every: str | None = None,
           files_per_trigger: int | None = None, knowledge_bases: DataFrame | None = None,
           extractor=None, parsers=None) -> StreamingQuery:
    """Process every newly arrived file once: documents, chunks, stages and statuses below ``out``.

    With ``knowledge_bases`` a file has to pass the upload checks first; refused
    ones are listed with their reason in ``out``/rejected.  A batch may be empty
    or all refused.  Stages a document passes are listed in ``out``/stages, as
    :func:`follow_status` takes them.

    Files are listed by tasks and noted in ``checkpoint``/arrivals, which is
    what is streamed, so the driver doesn't hold their names.  A store that
    Python can't open, a pattern for ``folder`` and a checkpoint that was begun
    without that table use Spark's own source of files.
    """
    log = f"{checkpoint}/arrivals"
    own = can_list(spark, folder) and (exists(spark, log) or not exists(spark, f"{checkpoint}/offsets"))

    def each(files: DataFrame, batch: int) -> None:
        listed = files.persist(StorageLevel.DISK_ONLY) if own else None
        # Several jobs need the files, which are opened once.
        documents = to_documents(files if listed is None else with_content(listed)).persist(StorageLevel.DISK_ONLY)
        try:
            process(documents if knowledge_bases is None else accepted(documents, batch), batch)
        finally:
            documents.unpersist()
            if listed is not None:
                listed.unpersist()

    def process(documents: DataFrame, batch: int) -> None:
        stage(documents, "PARSING", batch)
        statuses = processing.process_to(documents, f"{out}/chunks/batch={batch}", encoder, strategy, extractor,
                                         parsers=parsers)
        # Cutting and encoding are one job here; a document that got so far has passed both.
        passed = statuses.where("chunk_count > 0")
        for name in ("CHUNKING", "EMBEDDING"):
            stage(passed, name, batch)
        (statuses.select("document_id", "status", "progress", F.current_timestamp().alias("ts"))
         .write.mode("overwrite").parquet(f"{out}/stages/batch={batch}/stage=FINAL"))
        final = statuses.drop("knowledge_base_id")
        head = documents.drop("content", "status", "progress", "error_message", "chunk_count", "processed_at")
        (head.join(final, "document_id").withColumn("processed_at", F.current_timestamp())
         .write.mode("overwrite").parquet(f"{out}/documents/batch={batch}"))

    def stage(documents: DataFrame, name: str, batch: int) -> None:
        (documents.select("document_id", F.lit(name).alias("status"), F.lit(K.STAGE_PROGRESS[name]).alias("progress"),
                          F.current_timestamp().alias("ts"))
         .hint("rebalance").write.mode("overwrite").parquet(f"{out}/stages/batch={batch}/stage={name}"))

    def accepted(documents: DataFrame, batch: int) -> DataFrame:
        own = documents.sparkSession
        uploads = documents.select(F.col("document_id").alias("upload_id"), "knowledge_base_id", "file_name")
        stored = uploads.where("false")
        if exists(own, f"{out}/documents"):
            stored = _batches(own, f"{out}/documents", DOCUMENT).where(F.col("batch") != batch)
        judged = validate_uploads(uploads, knowledge_bases, stored)
        path = f"{out}/rejected/batch={batch}"
        judged.where("reason IS NOT NULL").write.mode("overwrite").parquet(path)
        passed = judged.where("reason IS NULL").select(F.col("upload_id").alias("document_id"))
        return documents.join(broadcast_if_small(passed), "document_id", "left_semi").select(*documents.columns)

    if not own:
        return _start(stream_files(spark, folder, pattern, files_per_trigger), each, checkpoint, every=every)

    def look() -> None:
        note_arrivals(spark, folder, log, pattern, files_per_trigger)

    look()
    query = _start(stream_arrivals(spark, log, one_by_one=bool(files_per_trigger)), each, checkpoint, every=every)
    if every:
        _repeat(query, spark._jvm.org.apache.spark.sql.streaming.Trigger.ProcessingTime(every).intervalMs() / 1000, look)
    return query


def _repeat(query: StreamingQuery, seconds: float, do: Callable[[], None]) -> None:
    """``do`` every so many seconds while the query runs, in a thread; if it fails the query is stopped."""
    def run() -> None:
        try:
            while not query.awaitTermination(max(1.0, seconds)):
                do()
        except StreamingQueryException:  # told to who waits for the query
            return
        except Exception:
            if query.isActive:
                query.stop()
                raise

    threading.Thread(target=run, name="arrivals", daemon=True).start()


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What the micro-batches wrote; with the schema stated no footer is opened for it."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).option("basePath", path).parquet(path)


def rejected_files(spark: SparkSession, out: str) -> DataFrame:
    return _batches(spark, f"{out}/rejected", REJECTED).drop("batch")


def ingested_documents(spark: SparkSession, out: str) -> DataFrame:
    return _batches(spark, f"{out}/documents", DOCUMENT).drop("batch")


def ingested_chunks(spark: SparkSession, out: str) -> DataFrame:
    return processing.usable_chunks(_batches(spark, f"{out}/chunks", OUTCOME).drop("batch"))


def ingested_stages(spark: SparkSession, out: str) -> DataFrame:
    """document_id, status, progress, ts of every stage that a document has passed."""
    return _batches(spark, f"{out}/stages", STAGE).drop("batch", "stage")


def follow_status(events: DataFrame, out: str, checkpoint: str, every: str | None = None,
                  compact: int = 100) -> StreamingQuery:
    """Keep the last status per document: each micro-batch writes the documents that changed.

    Every ``compact``-th one writes the status of all documents instead, and the
    next removes the folders before it, when it is sure to be complete.
    """

    def each(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        full = batch - batch % compact
        if batch > full > 0:
            drop_folders(spark, out, "batch", lambda name: int(name) < full)
        elif batch == full > 0 and exists(spark, out):
            before = _batches(spark, out, changed.schema).where(F.col("batch") < batch)
            both = before.unionByName(changed.withColumn("batch", F.lit(batch).cast("long")))
            changed = _newest(both, changed.columns)
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return _start(latest_status(events), each, checkpoint, "update", every)


def followed_status(spark: SparkSession, out: str) -> DataFrame:
    """Current status per document from what :func:`follow_status` wrote; no rows before the first micro-batch."""
    if not exists(spark, out):
        return spark.createDataFrame([], "document_id bigint, status string, ts timestamp")
    return _newest(spark.read.option("basePath", out).parquet(out), ["document_id", "status", "ts"])


def _newest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The row of the last micro-batch per document."""
    others = [c for c in columns if c != "document_id"]
    last = rows.groupBy("document_id").agg(F.max_by(F.struct(*others), F.col("batch")).alias("last"))
    return last.select("document_id", *[f"last.{c}" for c in others]).select(*columns)


def log_messages(messages: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append messages of a history stream, each id once, however late it repeats and whatever its time is.

    The log is kept in folders by hash of the id; a micro-batch reads the ids of
    the folders that it has messages for.  Messages without id are all kept.
    """

    def each(arrived: DataFrame, batch: int) -> None:
        spark = arrived.sparkSession
        part = F.pmod(F.xxhash64("id"), F.lit(LOG_PARTS)).cast("int")
        # Ties among repeats in one batch go to the earliest, so a batch that runs again writes the same.
        order = Window.partitionBy("id").orderBy(*sorted(c for c in arrived.columns if c != "id"))
        named = arrived.where("id IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        new = named.withColumn("part", part)
        if exists(spark, out):
            schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("part", T.IntegerType())])
            asked = [r[0] for r in new.select("part").distinct().collect()]
            known = _batches(spark, out, schema).where((F.col("batch") != batch) & F.col("part").isin(asked))
            new = new.join(known.select("id"), "id", "left_anti")
        rows = new.unionByName(arrived.where("id IS NULL").withColumn("part", F.lit(0)))
        # Gathered by folder, else every task has a file in each.
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/batch={batch}")

    return _start(messages, each, checkpoint, every=every)


def logged_messages(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(out).drop("batch", "part")


def answer_stream(questions: DataFrame, snapshot: Callable[[DataFrame], tuple[DataFrame, DataFrame]], encoder: EncoderFactory,
                  out: str, checkpoint: str, model: ModelFactory = first_chunk_model, k: int = K.TOP_K,
                  every: str | None = None) -> StreamingQuery:
    """Answer a stream of questions (query_id, knowledge_base_id, message), each query_id once.

    ``snapshot`` gives the documents and the encoded chunks for the questions of
    a micro-batch, as ``retrieval.asked_chunks`` chooses them, and is called for
    each, so an answer knows what is stored when it is given.  Which ids have
    been answered is kept in the state of the stream, not read back; the first
    of several questions of one id counts.  Questions without id are left out.
    """

    def each(asked: DataFrame, batch: int) -> None:
        asked = local_if_short(asked)
        documents, chunks = snapshot(asked)
        answers = answering.answer_questions(documents, chunks, embed(asked, encoder, text="message"), model, k, chosen=True)
        answers.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    once = questions.where("query_id IS NOT NULL").dropDuplicates(["query_id"])
    return _start(once, each, checkpoint, every=every)


def stream_answered(spark: SparkSession, out: str) -> DataFrame:
    """query_id, message, answer, sources as :func:`answer_stream` wrote them."""
    return spark.read.option("basePath", out).parquet(out).drop("batch")
