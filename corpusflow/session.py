"""Session settings, the shared working folder and size-checked broadcasts."""

from __future__ import annotations

import functools
import pathlib
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Largest estimated size of a side that is sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Longest list of keys that is computed once and kept as local data, and the
# most bytes one of its rows may have.
SHORT_ROWS = 50_000
SHORT_ROW_BYTES = 1024


def build_session(app: str = "corpusflow", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this package relies on.

    On a cluster leave ``master`` unset: master, memory and shuffle width then
    come from spark-submit, and only the settings below are added.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        # Short lists are read by one job instead of one for 1, 4, 16 ... partitions.
        "spark.sql.limit.initialNumPartitions": "64",
        # Streaming state on local disk instead of the heap.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Distribute the rows of a scan that would leave half of the cores idle.

    Small inputs and files of few large row groups are meant, where the work
    that follows costs more than moving the rows.  A large input has more
    partitions than there are cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Needed where it is neither installed on the executors nor given by
    ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="corpusflow-")) / "corpusflow.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


@functools.cache
def _local_root() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="corpusflow-", ignore_cleanup_errors=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names.

    Only a local session without ``spark.checkpoint.dir`` falls back to a
    temporary folder of this machine, which goes when the program ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root().name
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _width(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType) and not isinstance(
            field.dataType.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 16
    return F.lit(8)


def _row_width(df: DataFrame):
    return sum((_width(f) for f in df.schema.fields), F.lit(0)).cast("long")


def table_size(df: DataFrame) -> tuple[int, int]:
    """(rows, estimated bytes) of a frame, by one aggregation on the cluster."""
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(_row_width(df)), F.lit(0)).alias("b")).first()
    return got["n"], got["b"]


def _local(df: DataFrame, rows: list) -> DataFrame:
    """Collected rows as a frame again; plain keys go by Arrow."""
    plain = (T.StringType, T.IntegralType, T.BooleanType)
    if not rows or not all(isinstance(f.dataType, plain) for f in df.schema.fields):
        return df.sparkSession.createDataFrame(rows, df.schema)
    schema = to_arrow_schema(df.schema)
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return df.sparkSession.createDataFrame(pa.Table.from_arrays(columns, schema=schema), df.schema)


def short_rows(df: DataFrame, limit: int) -> pa.Table | None:
    """All rows of a short list within ``limit`` bytes, by one read, or None."""
    rows = min(SHORT_ROWS, limit // SHORT_ROW_BYTES)
    if not rows:
        return None
    short = F.when(_row_width(df) <= SHORT_ROW_BYTES, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    got = df.limit(rows + 1).select(short.alias("row")).toArrow()["row"].combine_chunks()
    if len(got) > rows or got.null_count:
        return None
    return pa.Table.from_struct_array(got).cast(to_arrow_schema(df.schema))


def local_if_short(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` as local data if it is a short list, so that what it is derived from runs once; else as it is."""
    rows = short_rows(df, limit)
    return df if rows is None else df.sparkSession.createDataFrame(rows, df.schema)


def broadcast_or_none(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame | None:
    """``df`` marked for broadcast if its measured size is within ``limit``, else None.

    A short list, of key columns as a rule, is computed here once and handed on
    as local data, so what it is derived from does not run a second time in the
    join.  Reading stops as soon as a list turns out not to be short, and a row
    of more than ``SHORT_ROW_BYTES`` is not handed over: with it the list isn't short.
    """
    rows = min(SHORT_ROWS, limit // SHORT_ROW_BYTES)
    if rows:
        short = F.when(_row_width(df) <= SHORT_ROW_BYTES, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        got = [r[0] for r in df.limit(rows + 1).select(short).collect()]
        if len(got) <= rows and None not in got:
            return F.broadcast(_local(df, got))
    return F.broadcast(df) if table_size(df)[1] <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is small, else as it is.

    In the second case the join shuffles, and adaptive execution splits hot keys.
    """
    small = broadcast_or_none(df, limit)
    return df if small is None else small
