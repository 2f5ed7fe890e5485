"""Documents to chunks with vectors and to a final status."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import constants as K
from corpusflow.functions import text as tx
from corpusflow.functions import vectors as vx
from corpusflow.operators import lifecycle
from corpusflow.operators.chunking import chunk_expression
from corpusflow.operators.embedding import EncoderFactory, embed
from corpusflow.schemas import OUTCOME
from corpusflow.sources.files import decode_text
from corpusflow.sources.tables import scan, write_chunks


# A parser turns the bytes of a file into its text, or raises.
Parser = Callable[[bytes], str]

_PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def _parse(parsers: Mapping[str, Parser]):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, contents in batches:
            found = []
            for kind, content in zip(kinds.to_pylist(), contents.to_pylist()):
                try:
                    found.append((None if content is None else parsers[kind](content), None))
                except Exception as problem:  # the document fails, not the job
                    found.append((None, str(problem) or type(problem).__name__))
            texts, errors = zip(*found) if found else ((), ())
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                                             names=["text", "error"])

    return F.arrow_udf(run, _PARSED).asNondeterministic()


def with_text(documents: DataFrame, extractor=None, parsers: Mapping[str, Parser] | None = None) -> DataFrame:
    """Replace ``content`` (bytes) by ``text`` and ``error``, chosen by file type.

    Plain text is decoded; for other types ``parsers`` has a function of the
    bytes, whose failure becomes the error of the document.  A type without
    parser is an error too, so no binary file is taken for text.  An
    ``extractor``, a function of the frame that adds ``text``, replaces all this.
    """
    if "text" in documents.columns:
        return documents
    if extractor is not None:
        return extractor(documents).drop("content")
    if "file_type" not in documents.columns:
        return documents.withColumn("text", decode_text(F.col("content"))).drop("content")
    kind, parsers = F.coalesce("file_type", F.lit("")), dict(parsers or {})
    plain = kind == "txt"
    known = kind.isin(list(parsers)) if parsers else F.lit(False)
    none = F.lit(None).cast("string")
    unknown = F.concat(F.lit(K.MSG_TYPE_UNSUPPORTED), kind, F.lit(K.MSG_TYPE_HINT))
    text, error = F.when(plain, decode_text(F.when(plain, F.col("content")))), F.when(~plain & ~known, unknown)
    if parsers:
        # Only files that need a parser travel to Python.
        asked = F.when(known & ~plain, F.col("content"))
        documents = documents.withColumn("_parsed", _parse(parsers)(F.when(known & ~plain, kind), asked))
        text = F.when(known & ~plain, F.col("_parsed.text")).otherwise(text)
        error = F.coalesce(error, F.when(known, F.col("_parsed.error")), none)
    return documents.withColumn("text", text).withColumn("error", error).drop("content", "_parsed")


def outcomes(documents: DataFrame, encoder: EncoderFactory, strategy: str = "fixed",
             size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, spread: int | None = None) -> DataFrame:
    """One row per chunk with its vector, and ``ok`` false where encoding failed.

    A document without text keeps one row with null ``chunk_index`` and its
    ``error``, if it has one.  Reading, cutting and encoding happen in one
    stage; with ``spread`` chunks are dealt over that many partitions before
    they are encoded, for documents so long that one task would take their all.
    """
    text = F.when(tx.has_text(F.col("text")), F.col("text"))
    error = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
    chunks = chunk_expression(strategy, text, size, overlap)
    cut = documents.select("document_id", "knowledge_base_id", error.alias("error"),
                           F.posexplode_outer(chunks).alias("chunk_index", "content"))
    if spread:
        cut = cut.repartition(spread, "document_id", "chunk_index")
    return embed(cut, encoder).withColumn("ok", vx.is_usable(F.col("embedding")))


def status_of(found: DataFrame) -> DataFrame:
    """Final status per document from :func:`outcomes`.

    Rows are counted before the shuffle, which carries about one row per
    document; of a stored table only the narrow columns are read.
    """
    counts = found.groupBy("document_id", "knowledge_base_id").agg(
        F.count("chunk_index").alias("n"), F.count_if("ok").alias("n_ok"), F.max("error").alias("error"))
    blank, good, bad = F.col("n") == 0, F.col("n_ok"), F.col("n") - F.col("n_ok")
    return counts.select(
        "document_id", "knowledge_base_id", lifecycle.final_status(good).alias("status"),
        F.when(blank, K.STAGE_PROGRESS["PARSING"]).otherwise(100).alias("progress"),
        good.cast("int").alias("chunk_count"),
        F.when(blank, F.coalesce("error", F.lit(K.MSG_NO_TEXT))).otherwise(lifecycle.final_message(good, bad)).alias("error_message"))


def usable_chunks(found: DataFrame) -> DataFrame:
    """The chunks that can be found; failed ones leave gaps in ``chunk_index``."""
    return found.where("ok").drop("ok", "error")


def process_to(documents: DataFrame, path: str, encoder: EncoderFactory, strategy: str = "fixed",
               extractor=None, mode: str = "overwrite", parsers: Mapping[str, Parser] | None = None,
               spread: int | None = None) -> DataFrame:
    """Process documents, store the outcomes at ``path`` and return the statuses.

    Outcomes are written once, by knowledge base; chunks
    (:func:`usable_chunks`) and statuses are read from there, so the encoder
    runs once per chunk.  No documents leave an empty folder.
    """
    found = outcomes(with_text(documents, extractor, parsers), encoder, strategy, spread=spread)
    write_chunks(found, path, mode)
    return status_of(stored_outcomes(documents.sparkSession, path, found.schema))


def stored_outcomes(spark: SparkSession, path: str, schema: T.StructType = OUTCOME) -> DataFrame:
    """What :func:`process_to` wrote, read with its schema: ids stay text and a folder may be empty."""
    return scan(spark, path, schema)
