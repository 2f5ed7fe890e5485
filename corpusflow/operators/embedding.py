"""Texts to vectors with a pluggable encoder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import clean_for_embedding
from corpusflow.session import ship_package
from corpusflow.sources.tables import listed_folders

# An encoder maps an Arrow array of texts, without nulls, to one vector per
# text: a sequence of vectors, a 2-D array or an Arrow list array.  The factory
# is called once per task, where it may load a model.
Encoder = Callable[[pa.Array], Sequence | np.ndarray | pa.Array]
EncoderFactory = Callable[[], Encoder]
# Texts that may fail one after the other before the encoder counts as down.
FAILURES_IN_A_ROW = 1000
# Texts of the first slice of a batch, which tells how long vectors are, and bytes of vectors of the others.
TEXTS_AT_ONCE = 1024
SLICE_BYTES = 32 * 1024 * 1024


def _lists(values: np.ndarray, widths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(widths))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.float32()))


def hashing_encoder(width: int = 64, normalise: bool = True) -> EncoderFactory:
    """Token counts hashed into ``width`` places, for use without a model.

    A token is what stands between blanks, in lower case; its place is given by
    the first eight hex digits of its md5.  A text without tokens gives an
    empty vector.
    """

    def factory() -> Encoder:
        places: dict[str, int] = {}

        def place(token: str) -> int:
            found = places.get(token)
            if found is None:
                if len(places) > 1_000_000:
                    places.clear()
                found = places[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % width
            return found

        def encode(texts: pa.Array) -> pa.Array:
            split = pc.split_pattern(pc.utf8_lower(texts), " ")
            tokens, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
            real = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)
            coded = tokens.dictionary_encode()
            # Each distinct token of the batch is hashed once.
            place_of = np.fromiter(map(place, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            cells = (owner * width + place_of[coded.indices.to_numpy()])[real]
            counts = np.bincount(cells, minlength=len(texts) * width).reshape(len(texts), width)
            found = counts.any(axis=1)
            counts = counts[found].astype(np.float64)
            if normalise:
                counts /= np.sqrt(np.einsum("ij,ij->i", counts, counts))[:, None]
            return _lists(counts.ravel(), found * width)

        return encode

    return factory


class EncoderContractError(ValueError):
    """The encoder itself is wrong; unlike a text it fails on, this ends the job."""


class _Failures:
    """Counts texts that failed in a row, so that an outage doesn't cost two calls for each of all texts."""

    def __init__(self, most: int | None):
        self.count, self.most = 0, most

    def add(self, problem: Exception) -> None:
        self.count += 1
        if self.most is not None and self.count > self.most:
            raise RuntimeError(f"the encoder failed on {self.count} texts in a row") from problem


def _encoded(encode: Encoder, texts: pa.Array) -> pa.ListArray:
    vectors = encode(texts)
    if not isinstance(vectors, pa.Array):
        vectors = [np.asarray(v, dtype=np.float32).ravel() for v in vectors]
        widths = np.fromiter(map(len, vectors), np.int64, len(vectors))
        vectors = _lists(np.concatenate(vectors) if len(vectors) else np.empty(0), widths)
    if len(vectors) != len(texts):
        raise EncoderContractError("the encoder must give one vector per text")
    return vectors


def _safely(encode: Encoder, texts: pa.Array, failures: _Failures) -> pa.ListArray:
    """One vector per text; a text the encoder fails on gets an empty one."""
    try:
        vectors = _encoded(encode, texts)
        failures.count = 0
        return vectors
    except EncoderContractError:
        raise
    except Exception as problem:
        if len(texts) <= 1:
            failures.add(problem)
            return _lists(np.empty(0), np.zeros(len(texts), np.int64))
    # Halve until only the failing texts stand alone.
    middle = len(texts) // 2
    return pa.concat_arrays([_safely(encode, part, failures) for part in (texts[:middle], texts[middle:])])


def _in_slices(encode: Encoder, texts: pa.Array, failures: _Failures) -> pa.ListArray:
    """Vectors of a batch, in slices whose vectors take a bounded number of bytes."""
    parts, at, step = [], 0, TEXTS_AT_ONCE
    while at < len(texts) or not parts:
        parts.append(_safely(encode, texts[at:at + step], failures))
        at += step
        widest = pc.max(parts[-1].value_lengths()).as_py() or 0
        if widest:
            step = max(1, SLICE_BYTES // (8 * widest))
    return pa.concat_arrays(parts)


def embed(df: DataFrame, encoder: EncoderFactory, text: str = "content", out: str = "embedding",
          clean: bool = True, failures_in_a_row: int | None = FAILURES_IN_A_ROW) -> DataFrame:
    """Add the vector of ``text`` as ARRAY<FLOAT>; null text and failures give ``[]``.

    A text the encoder fails on counts for itself only.  ``failures_in_a_row``:
    so many texts of a task failing one after the other are taken for an outage,
    which ends the job; None for never.

    Runs in Arrow batches.  The function counts as non-deterministic, which
    keeps Catalyst from evaluating a costly model twice for one row.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, failures = encoder(), _Failures(failures_in_a_row)
        for texts in batches:
            found = texts.drop_null()
            vectors = _in_slices(encode, found, failures)
            if texts.null_count:
                widths = np.zeros(len(texts), np.int64)
                widths[texts.is_valid().to_numpy(zero_copy_only=False)] = vectors.value_lengths().to_numpy()
                vectors = _lists(vectors.flatten().to_numpy(), widths)
            yield vectors

    ship_package(df.sparkSession)
    model = F.arrow_udf(run, T.ArrayType(T.FloatType())).asNondeterministic()
    source = clean_for_embedding(F.col(text)) if clean else F.col(text)
    return df.withColumn(out, model(source))


def embed_cached(df: DataFrame, encoder: EncoderFactory, store: str, text: str = "content", out: str = "embedding",
                 **options) -> DataFrame:
    """:func:`embed`, with the encoder called once per distinct content, in this run and in all that share ``store``.

    The key of a content is the SHA-256 of its cleaned text.  Contents that the
    store doesn't hold are encoded and added to it; failures, which give [], are
    not, so the next run tries them again.  Every run adds a folder of its own,
    so one that breaks off leaves nothing half written, and a content that two
    runs add at the same time is taken once.  Null texts are not encoded.
    """
    spark = df.sparkSession
    schema = T.StructType([T.StructField("content_key", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())),
                           T.StructField("part", T.IntegerType()), T.StructField("added", T.StringType())])
    part = F.conv(F.substring("content_key", 1, 2), 16, 10).cast("int")
    cleaned = clean_for_embedding(F.col(text))
    keyed = df.withColumn("content_key", F.sha2(cleaned, 256))
    contents = keyed.where("content_key IS NOT NULL").groupBy("content_key").agg(F.first(text).alias("_text"))
    # Folders are named one by one: two reads of one path count as equal, whatever was added between them.
    folders = listed_folders(spark, store, "added")
    if folders:
        known = spark.read.schema(schema).option("basePath", store).parquet(*folders)
        contents = contents.join(known.select("content_key"), "content_key", "left_anti")
    new = embed(contents, encoder, "_text", "vector", **options).where(F.size("vector") > 0)
    folders.append(f"{store.rstrip('/')}/added={uuid.uuid4().hex}")
    new.select("content_key", "vector", part.alias("part")).write.partitionBy("part").parquet(folders[-1])
    held = spark.read.schema(schema).option("basePath", store).parquet(*folders).select("content_key", "vector")
    vectors = held.dropDuplicates(["content_key"]).withColumnRenamed("vector", out)
    found = keyed.join(vectors, "content_key", "left")
    return found.withColumn(out, F.coalesce(out, F.array().cast("array<float>"))).select(*df.columns, out)
