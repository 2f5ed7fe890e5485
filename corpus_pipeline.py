"""Documents to packed training sequences, stage by stage.

Every stage works on all that the one before it kept, is written as Parquet and
read again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import common, line_dedup, mixing, near_dedup, packing, quality, tokens
from corpusflow.session import work_path


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Quality rules: documents that pass, without the lines that fail."""
    return quality.keep(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Line dedup: documents without blocks that an earlier one has."""
    return line_dedup.cleaned(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """MinHash near-dedup: one document of each group, by shingles of five words."""
    common.ready(spark)
    return near_dedup.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Mixing: documents as often as the target weights of their sources say."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Best-fit packing: the pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokens.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality rules", clean), ("line dedup", distinct_lines), ("near-duplicates", distinct_documents),
          ("source mixing", mixed), ("best-fit packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages, one after the other, over the documents of a folder."""
    common.ready(spark)
    docs = common.table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, folder)
