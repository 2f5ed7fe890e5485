"""Exact top-k by Hamming distance with incremental multi-index hashing.

A code is cut into segments of 16 bits.  Two codes whose distance is below
m * (r + 1), with m segments, differ by at most r bits in one of them.  So a
task looks up all values at radius r around each segment of a query, verifies
what it finds by full distance and keeps k; the radius grows until the kth
verified distance is below m * (r + 1).

Rows of one code share an index entry with their k smallest ids: no more of
them can be among the k results, however many rows a code has.  Entries are
dealt over parts by a hash of the code, once per search, and a part is a row of
the stored index.  Queries come in blocks of bounded size, which every task has.
A first round with small radii gives an upper bound of each query's kth
distance, so that in the second no part searches farther than the whole needs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm import common

K = 10
PART_CODES = 100_000
QUERY_BLOCK = 200_000
#: Queries that a task looks up at once.
AT_ONCE = 500
#: Largest radius of the first round.
FIRST_RADIUS = 1
_FOUND = "query int, id long, distance int"
_PART = "codes binary, counts array<int>, ids array<long>"


def binary_code(vector, width: int):
    """Signs of ``width`` numbers as hexadecimal bytes, the first in the lowest bit; missing ones are 0."""
    def byte(n: int):
        signs = [F.coalesce(F.try_element_at(vector, F.lit(8 * n + b + 1)) > 0, F.lit(False)) for b in range(8)]
        return F.lpad(F.hex(sum((F.when(s, 1 << b).otherwise(0) for b, s in enumerate(signs)), F.lit(0))), 2, "0")
    return F.concat(*[byte(n) for n in range(width // 8)])


@functools.lru_cache(maxsize=None)
def masks(radius: int) -> np.ndarray:
    """All 16-bit numbers with ``radius`` bits set."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) == radius]


def search(codes: np.ndarray, queries: np.ndarray, radius: int) -> list[np.ndarray]:
    """For each query the numbers of the codes that differ by ``radius`` bits in some segment.

    Codes and queries are rows of 16-bit segments.  The values of a segment are
    sorted; where there are fewer values than numbers to look up, the values are
    compared instead.
    """
    found: list[list[np.ndarray]] = [[] for _ in queries]
    flips = masks(radius)
    for s in range(codes.shape[1]):
        order = np.argsort(codes[:, s], kind="stable")
        values, starts = np.unique(codes[order, s], return_index=True)
        ends = np.append(starts[1:], len(order))
        for q, own in enumerate(queries[:, s]):
            if len(flips) < len(values):
                probes = flips ^ own
                at = np.searchsorted(values, probes)
                at[at == len(values)] = 0
                hits = at[values[at] == probes]
            else:
                hits = np.flatnonzero(np.bitwise_count(values ^ own) == radius)
            sizes = ends[hits] - starts[hits]
            total = np.cumsum(sizes)
            if len(total):
                rows = np.repeat(starts[hits] - (total - sizes), sizes) + np.arange(total[-1])
                found[q].append(order[rows])
    return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in found]


def _segments(codes: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(codes)), np.uint16).reshape(len(codes), -1)


def _pack(table: pa.Table) -> pa.Table:
    """The entries of a part as one row."""
    ids = table["ids"].combine_chunks()
    counts = ids.value_lengths().to_pylist()
    codes = bytes.fromhex("".join(table["code"].to_pylist()))
    return pa.table({"codes": pa.array([codes], pa.binary()), "counts": pa.array([counts], pa.list_(pa.int32())),
                     "ids": pa.array([ids.flatten().to_pylist()], pa.list_(pa.int64()))})


def nearest(codes: np.ndarray, counts: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray,
            most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(entries, distances) per query: at least those of the k nearest rows within its bound, ties included.

    ``counts``: rows of an entry.  The radius grows until the kth distance, or
    the bound, is covered, or ``most`` is reached.
    """
    segments = codes.shape[1]
    needed = min(k, int(counts.sum()))
    open_ = np.arange(len(queries))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in queries]
    for radius in range(most + 1):
        left = []
        for q, new in zip(open_.tolist(), search(codes, queries[open_], radius)):
            new = np.setdiff1d(new, found[q][0])
            distance = np.bitwise_count(codes[new] ^ queries[q]).sum(axis=1, dtype=np.int32)
            rows, distance = np.append(found[q][0], new), np.append(found[q][1], distance)
            order = np.argsort(distance, kind="stable")
            rows, distance = rows[order], distance[order]
            kth = int(np.searchsorted(np.cumsum(counts[rows]), needed))  # the entry with the row that is needed last
            covered = segments * (radius + 1)
            if kth < len(rows):
                keep = distance <= distance[kth]
                rows, distance = rows[keep], distance[keep]
            found[q] = (rows, distance)
            if bounds[q] >= covered and not (kth < len(rows) and distance[kth] < covered):
                left.append(q)
        open_ = np.array(left, np.int64)
        if not len(open_):
            break
    return found


def _look_up(sent, k: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, bounds = sent.value
        for batch in batches:
            for r in range(len(batch)):
                codes = np.frombuffer(batch.column("codes")[r].as_py(), np.uint16).reshape(-1, queries.shape[1])
                counts = batch.column("counts")[r].values.to_numpy(zero_copy_only=False)
                ids = batch.column("ids")[r].values
                missing, numbers = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                begins = np.cumsum(counts) - counts
                for at in range(0, len(queries), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    yield _best_rows(nearest(codes, counts, queries[part], k, bounds[part], most), at, begins, counts,
                                     numbers, missing, k)
    return run


def _best_rows(found, at: int, begins, counts, numbers, missing, k: int) -> pa.RecordBatch:
    """The k rows with the least (distance, id) of every query, null ids first."""
    query, place, distances = [], [], []
    for n, (entries, distance) in enumerate(found):
        own = np.repeat(begins[entries] - (np.cumsum(counts[entries]) - counts[entries]), counts[entries])
        own = own + np.arange(len(own))
        far = np.repeat(distance, counts[entries])
        best = np.lexsort((numbers[own], ~missing[own], far))[:k]
        query.append(np.full(len(best), at + n, np.int32))
        place.append(own[best])
        distances.append(far[best])
    query, place, distances = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (query, place, distances))
    place = place.astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(query.astype(np.int32)), pa.array(numbers[place].astype(np.int64), mask=missing[place]),
         pa.array(distances.astype(np.int32))], names=["query", "id", "distance"])


def top_k(rows: DataFrame, queries: DataFrame, id_name: str, vector: str, k: int = K,
          part_codes: int = PART_CODES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, id, distance: the k rows with the least Hamming distance to each query.

    Codes are the signs of the vectors (1 where above 0).  Ties go to the
    smaller id, a null id first; a row may be a result of itself.  Null numbers count as
    0 and shorter vectors are filled with 0; rows and queries whose vector is
    null are left out.  Repeated rows are results of their own each; queries
    alike in id and code are one.  With fewer rows
    than k all are returned.  Further columns are ignored.
    """
    spark = common.ready(rows.sparkSession)
    rows = common.take(rows, id_name, vector).filter(F.col(f"`{vector}`").isNotNull()).toDF("id", "vector")
    queries = common.take(queries, id_name, vector).filter(F.col(f"`{vector}`").isNotNull()).toDF("id", "vector")
    widest = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, queries.agg(F.max(F.size("vector"))).first()[0] or 0)
    width = max(16, -(-widest // 16) * 16)
    coded = rows.select("id", binary_code(F.col("vector"), width).alias("code"))
    first = Window.partitionBy("code").orderBy("id")
    index = (coded.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k)
             .groupBy("code").agg(F.collect_list(F.struct("id")).alias("ids")))
    index = common.stored(index.select("code", F.col("ids.id").alias("ids")), "codes")
    parts = max(1, -(-index.count() // part_codes))
    dealt = index.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts)))
    packed = common.stored(dealt.groupBy("part").applyInArrow(_pack, _PART), "packed").repartition(parts)
    wanted = common.stored(queries.select("id", binary_code(F.col("vector"), width).alias("code")).distinct(), "queries")
    blocks = max(1, -(-wanted.count() // query_block))
    out = None
    for block in range(blocks):
        own = wanted.filter(F.pmod(F.xxhash64("code", "id"), F.lit(blocks)) == block).toArrow()
        done = _block(spark, packed, own, width // 16, k, parts)
        out = done if out is None else out.unionByName(done)
    return out


def _block(spark, packed: DataFrame, own: pa.Table, segments: int, k: int, parts: int) -> DataFrame:
    """Results of one block of queries."""
    codes = _segments(own["code"].to_pylist()) if len(own) else np.zeros((0, segments), np.uint16)
    order = Window.partitionBy("query").orderBy("distance", F.col("id").asc_nulls_first())
    bounds = np.full(len(codes), np.iinfo(np.int32).max)

    def round_(most: int) -> DataFrame:
        sent = spark.sparkContext.broadcast((codes, bounds))
        found = packed.mapInArrow(_look_up(sent, k, most), _FOUND)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    if parts > 1:
        kth = round_(FIRST_RADIUS).filter(F.col("rank") == k).select("query", "distance").toArrow()
        bounds[kth["query"].to_numpy()] = kth["distance"].to_numpy()
    names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(own), dtype=np.int32)),
                                            "query_id": own["id"].cast(pa.int64())}))
    return round_(16).join(F.broadcast(names), "query").select("query_id", "rank", "id", "distance")


def op2_topk_hamming(spark, folder):
    """The ten nearest codes of every hundredth vector among all vectors."""
    rows = common.table(spark, folder, "embeddings")
    return top_k(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding")


OP2_SQL = f"""
WITH coded AS (
  SELECT vec_id AS id, list_sum([CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END
    FOR i IN range(1, len(embedding) + 1)])::HUGEINT AS code FROM embeddings),
ranked AS (
  SELECT q.id AS query_id, d.id, CAST(bit_count(xor(q.code, d.code)) AS INTEGER) AS distance
  FROM coded q, coded d WHERE q.id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ranked) WHERE rank <= {K}
"""
