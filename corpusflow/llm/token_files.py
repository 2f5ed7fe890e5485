"""Token ids in ORC files: ascending by document id, integer run-length coded, with Bloom filters.

Documents are range-partitioned by id and each partition writes its own file,
so stripes are read in parallel, and the row indexes and Bloom filters on
doc_id let a reader skip what it doesn't ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import common, tokens
from corpusflow.session import work_path

END_ID = 2
ROWS_PER_FILE = 200_000
_FILE = "doc_id long, n_tokens long, ids array<int>, part int, row long"
_READ = "doc_id long, n_tokens long, ids_crc32 long, part int, row long"


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        encoder = tokens.unit_encoder(path)
        for batch in batches:
            for rows, lengths, ids in encoder.encode(batch.column("text")):
                ends = np.cumsum(lengths)
                values = np.insert(ids, ends, end_id).astype(np.int32)
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array(np.diff(offsets).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                     pa.array(np.full(len(rows), part, np.int32)), pa.array(row + rows)],
                    names=["doc_id", "n_tokens", "ids", "part", "row"])
            row += len(batch)
    return run


def write_ids(docs: DataFrame, path: str, target: str, end_id: int = END_ID,
              files: int | None = None, stripe_bytes: int = 64 << 20) -> None:
    """Write doc_id, n_tokens, ids, part (file number) and row (place in it) as ORC below ``target``.

    Rows are ascending by doc_id, null first; rows of one doc_id stand by the
    hash of their text.  A number drawn per row lets equal rows be split over files.
    """
    spark = docs.sparkSession
    common.ready(spark)
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = (common.take(docs, "doc_id", "text")
            .withColumn("_text", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
            .repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "_text", "_row")
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_text", "_row").select("doc_id", "text"))
    (rows.mapInArrow(_encode(path, end_id), _FILE).write
     .option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", 1000)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(target))


def read_ids(spark: SparkSession, target: str) -> DataFrame:
    """The stored rows; a filter on doc_id skips stripes and row groups."""
    return spark.read.schema(_FILE).orc(target)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        crc = [tokens.crc_of(values[a:b]) for a, b in zip(offsets, offsets[1:])]
        keep = ["doc_id", "part", "row"]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()),
             *[batch.column(c) for c in keep[1:]]],
            names=["doc_id", "n_tokens", "ids_crc32", "part", "row"])


def describe(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored row, all taken from the ids read back.

    start counts the ids before a row: sums per file, a running sum over files
    and one within each file.
    """
    read = common.stored(read_ids(spark, target).select("doc_id", "ids", "part", "row")
                         .mapInArrow(_digest, _READ), "token_rows")
    files = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("row")
    return (read.join(F.broadcast(before), "part")
            .withColumn("start", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
            .select("doc_id", "start", "n_tokens", "ids_crc32"))


def op7_token_files(spark, folder):
    """All documents encoded, written as ORC and described from the files.

    A null text is empty, so it gives the end id alone; null ids come first,
    repeated rows follow one another, extra columns are ignored, an empty table
    gives an empty one.
    """
    target = work_path(spark, "token_ids")
    write_ids(common.table(spark, folder, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"), target)
    return describe(spark, target)
