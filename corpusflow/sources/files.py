"""Uploaded files laid out as ``<folder>/<knowledge base>/<file name>``."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusflow import constants as K
from corpusflow.functions import text as tx
from corpusflow.session import ship_package
from corpusflow.sources.tables import _folder, exists

LISTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                       T.StructField("length", T.LongType())])
LISTED_ROWS = 10_000  # files of one batch of a list
SEGMENT_ROWS = 50_000  # files of one segment of the log of arrivals
READ_FILES, READ_BYTES = 8_192, 64 * 1024 * 1024  # files and bytes that a task reads, about
HANDED_BYTES = 8 * 1024 * 1024  # contents handed on together


def _from_path(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("knowledge_base_id"),
        F.element_at(parts, -1).alias("file_name"),
        F.col("path").alias("file_path"), "modificationTime", "length", "content")


def read_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Files below ``folder``; the content is read only if it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return _from_path(reader.load(folder))


def write_files(df: DataFrame, folder: str) -> int:
    """Write ``content`` (bytes) of each row to ``folder``/<knowledge base>/<file name>; returns the number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))
        made = set()
        for batch in batches:
            for base, name, content in zip(*(batch.column(c).to_pylist() for c in (
                    "knowledge_base_id", "file_name", "content"))):
                if base not in made:
                    system.create_dir(f"{root}/{base}", recursive=True)
                    made.add(base)
                with system.open_output_stream(f"{root}/{base}/{name}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    rows = df.select("knowledge_base_id", "file_name", "content")
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def stream_files(spark: SparkSession, folder: str, pattern: str | None = None,
                 files_per_trigger: int | None = None) -> DataFrame:
    """The same files as a stream: every path is delivered once.

    Spark's source keeps all names on the driver; see :func:`stream_arrivals`.
    """
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _from_path(reader.schema(schema).load(folder))


# --- files listed by tasks: neither the driver nor a task holds the names of all files ------

def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a qualified path, and the path there."""
    scheme, authority, inside = re.fullmatch(r"(?s)([\w+.-]+):(//[^/]*)?(/.*)?", path).groups("")
    if scheme == "file":
        return fs.LocalFileSystem(), inside
    system, base = fs.FileSystem.from_uri(f"{scheme}:{authority}/")
    return system, base.rstrip("/") + inside


def _qualified(spark: SparkSession, folder: str) -> str:
    path, system = _folder(spark, folder)
    return system.makeQualified(path).toString()


def can_list(spark: SparkSession, folder: str) -> bool:
    """Whether :func:`list_files` can: a folder that is there, no pattern, of a store that Python opens."""
    if re.search(r"[][{}*?\\]", folder) or not exists(spark, folder):
        return False
    path, system = _folder(spark, folder)
    try:
        _store(_qualified(spark, folder))
    except (pa.ArrowException, OSError):
        return False
    return system.getFileStatus(path).isDirectory()


def _taken(name: str, is_folder: bool, size: int) -> bool:
    """Spark's readers pass over hidden names and empty files, and so does a list."""
    hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    if is_folder:
        return not hidden or name.startswith(("_common_metadata", "_metadata"))
    return not hidden and size > 0


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """name, whether it is a folder, time of change in microseconds, bytes of what Spark takes from a folder."""
    return (entry for entry in _all_entries(system, folder) if _taken(entry[0], entry[1], entry[3]))


def _all_entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    # On a disk one by one, so that a folder may have any number of files.
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    entry.name.encode()
                    status = entry.stat()
                except (FileNotFoundError, UnicodeEncodeError):  # gone meanwhile; no name that Spark could open
                    continue
                yield entry.name, entry.is_dir(), status.st_mtime_ns // 1_000_000 * 1000, status.st_size
    else:
        for info in system.get_file_info(fs.FileSelector(folder)):
            yield (info.base_name, info.type == fs.FileType.Directory, (info.mtime_ns or 0) // 1_000_000 * 1000, info.size or 0)


def _below(folder: str) -> Iterator[tuple[str, int, int]]:
    """Qualified path, time and bytes of all files below a folder."""
    left = [folder]
    while left:
        at = left.pop()
        try:
            for name, is_folder, changed, size in _entries(*_store(at)):
                if is_folder:
                    left.append(f"{at}/{name}")
                else:
                    yield f"{at}/{name}", changed, size
        except FileNotFoundError:  # a folder that is gone meanwhile
            continue


def _in_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(itertools.islice(rows, LISTED_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length of the files that :func:`read_files` finds, listed by tasks.

    One task lists the folder itself, others what is below its subfolders.
    """
    ship_package(spark)
    root = _qualified(spark, folder).rstrip("/")
    schema = T.StructType([*LISTED.fields, T.StructField("is_folder", T.BooleanType())])
    arrow, listed = to_arrow_schema(schema), to_arrow_schema(LISTED)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from _in_batches(((f"{root}/{name}", changed, size, is_folder) for name, is_folder, changed, size
                                    in _entries(*_store(f"{root}/"))), arrow)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.filter(pc.invert(batch.column("is_folder"))).columns[:3], schema=listed)
            for name in batch.filter(batch.column("is_folder")).column("path").to_pylist():
                yield from _in_batches(_below(name), listed)

    tasks = spark.sparkContext.defaultParallelism
    found = spark.range(0, 1, 1, 1).mapInArrow(top, schema).repartition(tasks, "path").mapInArrow(below, LISTED)
    if pattern:
        glob = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
        found = found.where(F.element_at(F.split("path", "/"), -1).rlike(f"(?s)\\A(?:{glob})\\z"))
    return found


def note_arrivals(spark: SparkSession, folder: str, log: str, pattern: str | None = None,
                  files_per_segment: int | None = None) -> None:
    """Add the files below ``folder`` that the table ``log`` doesn't have yet, in new segments.

    With ``files_per_segment`` segments have so many files at most and are
    written one after the other, the oldest files first.
    """
    found = list_files(spark, folder, pattern)
    if exists(spark, log):
        found = found.join(spark.read.schema(LISTED).parquet(log).select("path"), "path", "left_anti").select(*LISTED.names)
    if files_per_segment:
        found = found.repartition(1).sortWithinPartitions("modificationTime", "path")
    found = found.persist(StorageLevel.DISK_ONLY)
    try:
        # An empty segment would be a micro-batch without files.
        if not exists(spark, log) or not found.isEmpty():
            found.write.mode("append").option("maxRecordsPerFile", files_per_segment or SEGMENT_ROWS).parquet(log)
    finally:
        found.unpersist()


def stream_arrivals(spark: SparkSession, log: str, one_by_one: bool = False) -> DataFrame:
    """What :func:`note_arrivals` writes as a stream; ``one_by_one``: a segment is a micro-batch."""
    reader = spark.readStream.schema(LISTED).option("maxFileAge", "36500d")
    return (reader.option("maxFilesPerTrigger", 1) if one_by_one else reader).parquet(log)


def with_content(listed: DataFrame) -> DataFrame:
    """Listed files as :func:`read_files` gives them, dealt over tasks by their number and size."""
    ship_package(listed.sparkSession)
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    schema = T.StructType([*LISTED.fields, T.StructField("content", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, first, held = [], 0, 0
            for path in batch.column("path").to_pylist():
                system, inside = _store(path)
                with system.open_input_file(inside) as file:
                    contents.append(file.read())
                held += len(contents[-1])
                last = first + len(contents)
                if held >= HANDED_BYTES or last == batch.num_rows:
                    part = batch.slice(first, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], schema=arrow)
                    contents, first, held = [], last, 0

    tasks = max(1, -(-n // READ_FILES), -(-size // READ_BYTES))
    tasks = max(tasks, min(n, listed.sparkSession.sparkContext.defaultParallelism))
    return _from_path(listed.select(*LISTED.names).repartition(tasks).mapInArrow(read, schema))


def to_documents(files: DataFrame) -> DataFrame:
    """New document rows for files, keeping ``content`` for the processing step.

    The id is a hash of knowledge base and file name, so a task that runs again
    gives the same id.
    """
    return files.select(
        tx.stable_id(F.col("knowledge_base_id"), F.col("file_name")).alias("document_id"),
        "knowledge_base_id", "file_name", tx.file_type(F.col("file_name")).alias("file_type"),
        "file_path", F.lit("UPLOADING").alias("status"),
        F.lit(K.STAGE_PROGRESS["UPLOADING"]).alias("progress"),
        F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("chunk_count"),
        F.current_timestamp().alias("uploaded_at"),
        F.lit(None).cast("timestamp").alias("processed_at"), "content")


def ingest_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    return to_documents(read_files(spark, folder, pattern))


def decode_text(content: Column) -> Column:
    """Bytes to text: strict UTF-8, else GBK with replacement characters.

    Only contents that are not UTF-8 travel to Python; for the others the
    function is handed nulls.
    """

    def gbk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([None if b is None else b.decode("gbk", errors="replace")
                            for b in column.to_pylist()], pa.string())

    text = content.cast("string")
    valid = F.is_valid_utf8(text)
    other = F.arrow_udf(gbk, "string")(F.when(~valid, content))
    return F.when(valid, text).otherwise(other)
