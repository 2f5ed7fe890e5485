"""Best-fit packing of documents into sequences, certified by lower bounds.

Every document becomes its ids and an end id; only documents longer than a
sequence are cut.  Pieces are dealt over partitions by a number drawn when they
are made, and each partition packs its own by best-fit decreasing.  A lower
bound from dual-feasible functions certifies a partition whose count it equals.
The others form a pool: their pieces are dealt anew and packed again, and the
better result stays, until all are certified or the rounds are used up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common, tokens

CAPACITY = 2048
PIECES_PER_PARTITION = 50_000
ROUNDS = 3

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, draw long"
_NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "draw")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least number of bins by dual-feasible functions, applied to counts per length.

    The first family rounds sizes above half the capacity as lambda moves: those
    above capacity - lambda count as full, those below lambda as nothing.  The
    second one counts floor((k + 1) * size / capacity) parts of k, sizes that
    divide evenly as they are.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    total = int((count * size).sum())
    best = -(-total // capacity)
    above, within = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    for lam in range(1, capacity // 2 + 1):
        full = int(above[capacity - lam + 1])
        middle = int(within[capacity - lam] - within[lam - 1])
        best = max(best, -(-(full * capacity + middle) // capacity))
    for k in range(1, 101):
        parts = (k + 1) * size
        value = np.where(parts % capacity == 0, size * k, parts // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset of each piece, number of bins); each goes where it leaves least room.

    ``room`` has the bins by free space, and a bit mask tells which spaces occur,
    so a piece finds its bin without a search over bins.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fitting = mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = room[space].pop()
            if not room[space]:
                mask ^= 1 << space
        else:
            at, space = used, capacity
            used += 1
        bins[i], offsets[i] = at, capacity - space
        if space > size:
            if not room[space - size]:
                mask |= 1 << (space - size)
            room[space - size].append(at)
    return bins, offsets, used


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document; only the first may be shorter."""
    first = total % capacity
    return ([first] if first else []) + [capacity] * (total // capacity)


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.unit_encoder(path)
        row = TaskContext.get().partitionId() << 36  # so that no two pieces draw alike
        for batch in batches:
            docs = batch.column("doc_id")
            for rows, lengths, ids in encoder.encode(batch.column("text")):
                out: list[list] = [[] for _ in range(5)]
                bounds = tokens.pieces_of(lengths)
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    own = np.append(ids[a:b], end_id)
                    start = 0
                    for piece, length in enumerate(cut_lengths(len(own), capacity)):
                        out[0].append(rows[k])
                        out[1].append(piece)
                        out[2].append(start)
                        out[3].append(length)
                        out[4].append(tokens.crc_of(own[start:start + length]))
                        start += length
                n = len(out[0])
                draw = common.mixed(np.arange(row, row + n, dtype=np.uint64)) >> np.uint64(2)
                row += n
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()),
                     *[pa.array(c, pa.int64()) for c in out[2:]], pa.array(draw.astype(np.int64))],
                    names=list(_NAMES))
    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of all documents with the CRC of their ids; draw: a number to deal them by."""
    common.ready(docs.sparkSession)
    return common.take(docs, "doc_id", "text").mapInArrow(_tokenise(path, capacity, end_id), _PIECES)


def _packer(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        frame["sequence_id"] = bins
        frame["offset"] = offsets
        frame["bins"] = used
        frame["bound"] = lower_bound(lengths, capacity)
        return frame
    return run


def _dealt(df: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """``df`` (the columns of pieces) dealt over ``parts`` partitions and packed in each."""
    keyed = df.withColumn("part", F.pmod(F.xxhash64("draw", F.lit(turn)), F.lit(parts)))
    schema = f"{_PIECES}, part long, sequence_id long, offset long, bins long, bound long"
    return keyed.groupBy("part").applyInPandas(_packer(capacity), schema)


def pack(df: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION,
         rounds: int = ROUNDS) -> DataFrame:
    """Pieces with sequence_id and offset.  ``df`` has the columns of ``pieces`` and is stored."""
    part = [F.col(name) for name in _NAMES]
    full = df.filter(F.col("length") == capacity)
    # Each full piece is a sequence; the odd numbers are theirs.
    out = full.select(*part, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"),
                      F.lit(0).cast("long").alias("offset"))
    pool = df.filter(F.col("length") < capacity)
    size = pool.count()
    for turn in range(rounds + 1):
        if not size:
            break
        parts = -(-size // per_partition)
        packed = common.stored(_dealt(pool.select(*part), parts, turn, capacity), "packed")
        sums = packed.groupBy("part").agg(
            F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count("*").alias("n"))
        got = sums.agg(F.sum("bins").alias("bins"), F.sum(F.when(F.col("bins") > F.col("bound"), F.col("n")))
                       .alias("open"), F.sum((F.col("bins") > F.col("bound")).cast("long")).alias("gaps")).first()
        if turn and got["bins"] >= before:  # noqa: F821  the pool was packed no worse the round before
            packed, closing = earlier, True  # noqa: F821
        else:
            closing = not got["open"] or turn == rounds or parts == 1
        certified = F.lit(True) if closing else F.col("bins") <= F.col("bound")
        number = (F.lit(turn).cast("long") * (1 << 28) + F.col("part")) * (1 << 24) + F.col("sequence_id")
        out = out.unionByName(packed.filter(certified).select(*part, (number * 2).alias("sequence_id"), "offset"))
        if closing:
            break
        earlier = packed.filter(F.col("bins") > F.col("bound"))
        before = earlier.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0]
        pool, size = earlier, got["open"]
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0,
                   per_partition: int = PIECES_PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece.

    Uses doc_id and text; further columns are ignored.  A null or empty text is
    the end id alone.  Every row is packed, also those with a null or repeated
    doc_id, which then can't be told apart.  An empty table gives an empty one.
    """
    made = common.stored(pieces(docs, path, capacity, end_id), "pieces")
    return pack(made, capacity, per_partition, rounds).drop("draw")


def op6_best_fit_packing(spark, folder):
    """All documents in sequences of 2048 tokens."""
    return pack_documents(common.table(spark, folder, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"))
