"""Exact top-k of a table of questions against a table of vectors.

A question is scored against a whole block of vectors by one matrix product
inside a task, and only the best k per question leave the task.  No pair of
question and vector ever becomes a row.

Three physical forms give the same result:

* questions of a measured, bounded size are sent to every executor and the
  vectors are scored where they are read: no shuffle of the vectors;
* up to eight times as many come in blocks of that size, for each of which the
  vectors are scanned once more;
* otherwise both sides are cut into blocks of bounded size and every block of
  vectors meets every block of questions of its group in a task of its own, so
  a group that holds a large share of all rows spreads over many tasks.

A last window keeps the k best of the per-task candidates.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusflow import constants as K
from corpusflow.session import BROADCAST_BYTES, broadcast_if_small, ship_package, short_rows, table_size, work_path

METRICS = ("cosine", "l2")
# Scores are kept to this many decimals, so that summation order cannot decide
# between equal vectors.
SCORE_DECIMALS = 9
SCORE_CELLS = 4_000_000  # cells of one score matrix inside a task
ASKED_TILE, SCORED_TILE = 512, 1024  # questions and vectors of one approximate product, which a core's cache holds
MANY_QUESTIONS = 10_000  # from so many on, dealing out vectors costs little beside scoring them
BLOCK_VALUES = 4_000_000  # numbers of the vectors of one score matrix
LISTED_SCOPES = 1000  # scopes written out as a filter
SCANS = 8  # most scans of the vectors for blocks of questions
CANDIDATES = 50_000_000  # candidates that the tasks of a scan may give in all
GATHER_BYTES = 16 * 1024 * 1024  # vectors scored together inside a task
TILE_BYTES = 32 * 1024 * 1024  # vectors or questions of one block of the grid


# --- helpers that run inside tasks -------------------------------------------------

def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values, start offsets and widths of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(widths)[:-1])) if len(widths) else widths
    return flat, starts, widths


def _plain(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _by_value(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distinct whole numbers from 0 with the row numbers that hold them."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    borders = np.flatnonzero(np.diff(ordered)) + 1
    for rows in np.split(order, borders):
        if len(rows) and values[rows[0]] >= 0:
            yield int(values[rows[0]]), rows


def _matrix(flat, starts, rows, width) -> np.ndarray:
    at = starts[rows]
    if len(rows) and at[-1] - at[0] == (len(rows) - 1) * width and (np.diff(at) == width).all():
        block = flat[at[0]:at[0] + len(rows) * width].reshape(len(rows), width)
    else:
        block = flat[at[:, None] + np.arange(width)]
    return block.astype(np.float64)


def _unit(block: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", block, block))
    return np.divide(block, norms[:, None], out=np.zeros_like(block), where=norms[:, None] > 0)


class _Buckets:
    """Numbers the group of a row: its scope and, for the approximate form, its bucket.

    A grouping is one array of numbers; the approximate form has one per hash
    table.  Rows of a scope no question has get -1 and are passed over.
    """

    def __init__(self, scope: str | None, planes: np.ndarray | None = None, tables: int = 1):
        self.scope, self.planes, self.tables = scope, planes, tables
        self.known: dict[object, int] = {}

    def learn(self, table: pa.Table) -> None:
        if self.scope:
            self.known = {v: n for n, v in enumerate(table[self.scope].unique().to_pylist()) if v is not None}

    def _scopes(self, batch) -> np.ndarray:
        if not self.scope:
            return np.zeros(batch.num_rows, dtype=np.int64)
        column = batch[self.scope]
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        coded = column.dictionary_encode()
        numbers = np.array([self.known.get(v, -1) for v in coded.dictionary.to_pylist()] + [-1], dtype=np.int64)
        return numbers[coded.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)]

    def groupings(self, batch, flat, starts, widths) -> Iterator[np.ndarray]:
        scopes = self._scopes(batch)
        if self.planes is None:
            yield scopes
            return
        bits = len(self.planes) // self.tables
        codes = _sign_codes(flat, starts, widths, self.planes, self.tables)
        for code in codes.T:
            # One place more than there are signs, for vectors of another width.
            yield np.where(scopes < 0, -1, scopes * ((1 << bits) + 1) + code + 1)


def _sign_codes(flat, starts, widths, planes: np.ndarray, tables: int) -> np.ndarray:
    """Bucket per row and hash table; -1 for vectors of another width than the planes."""
    bits, width = len(planes) // tables, planes.shape[1]
    codes = np.full((len(widths), tables), -1, dtype=np.int64)
    fit = np.flatnonzero(widths == width)
    if len(fit):
        signs = _matrix(flat, starts, fit, width) @ planes.T > 0
        codes[fit] = signs.reshape(len(fit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return codes


class _Prepared:
    """Rows by width, ready for products in single precision; the exact numbers stay as they came.

    For l2 a question has one place more, 1, and a vector half its squared
    length, negative: so the product is half of what the two squared lengths
    have beyond the squared distance.
    """

    def __init__(self, flat, starts, widths, metric: str, asking: bool):
        self.flat, self.starts, self.widths, self.metric = flat, starts, widths, metric
        self.place = np.zeros(len(widths), np.int64)
        # width -> (single precision rows, squared lengths, whether single precision can hold the products)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, bool]] = {}
        for width, rows in _by_value(widths):
            self.place[rows] = np.arange(len(rows))
            fast, norm2 = np.zeros((len(rows), width + 1), np.float32), np.empty(len(rows))
            step = max(1, BLOCK_VALUES // max(1, 4 * width))
            with np.errstate(over="ignore", invalid="ignore"):
                for begin in range(0, len(rows), step):
                    block = self.exact(rows[begin:begin + step], width)
                    own = norm2[begin:begin + step] = np.einsum("ij,ij->i", block, block)
                    fast[begin:begin + step, :-1] = block
                    if metric == "l2":
                        fast[begin:begin + step, -1] = 1 if asking else -own / 2
            self.by_width[width] = fast, norm2, bool((norm2 < 1e30).all())

    def exact(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Rows in double precision, of length 1 for cosine."""
        block = _matrix(self.flat, self.starts, rows, width)
        return _unit(block) if self.metric == "cosine" else block


class _Questions:
    """A block of questions, prepared once, with the rows of each group."""

    def __init__(self, table: pa.Table, buckets: _Buckets, metric: str):
        self.ids, self.buckets, self.metric = _plain(table["query_id"]), buckets, metric
        flat, starts, widths = _vectors(table["embedding"])
        self.rows = _Prepared(flat, starts, widths, metric, True)
        buckets.learn(table)
        # Per grouping: group -> width -> questions
        self.parts: list[dict[int, dict[int, np.ndarray]]] = []
        for groups in buckets.groupings(table, flat, starts, widths):
            self.parts.append({group: {width: rows[at] for width, at in _by_value(widths[rows])}
                               for group, rows in _by_value(groups)})


class _Best:
    """Running k best per question.

    Candidates wait until there are as many as are held already, so merging
    costs little however many small blocks are scored.
    """

    def __init__(self, questions: int, k: int, wait: int = 50_000):
        self.k, self.wait = k, wait
        self.bound = np.full(questions, -np.inf)
        self.held: list[np.ndarray] | None = None
        self.waiting: list[list[np.ndarray]] = []
        self.count = 0

    def add(self, question, document, position, score) -> None:
        self.waiting.append([question, document, position, score])
        self.count += len(question)
        if self.held is None or self.count > max(self.wait, len(self.held[0])):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        parts = self.waiting if self.held is None else [self.held, *self.waiting]
        merged = [np.concatenate(columns) for columns in zip(*parts)]
        question, document, position, score = merged
        self.waiting, self.count = [], 0
        documents = np.unique(document, return_inverse=True)[1] if document.dtype == object else document
        order = np.lexsort((position, documents, -score, question))
        # A pair met in several groupings counts once.
        same = np.ones(len(order), dtype=bool)
        for column in (question, documents, position):
            same[1:] &= column[order[1:]] == column[order[:-1]]
        same[:1] = False
        order = order[~same]
        question = question[order]
        place = np.arange(len(question)) - np.searchsorted(question, question, side="left")
        keep = order[place < self.k]
        full = place == self.k - 1
        self.bound[question[full]] = np.maximum(self.bound[question[full]], score[order[full]])
        self.held = [column[keep] for column in merged]


def _offer(best: _Best, asked: np.ndarray, scores: np.ndarray, document, position) -> None:
    """Pass on the cells that can still be among the k best of their question."""
    # The margin covers the rounding below; ties at the bound are all kept.
    margin = 10.0 ** -SCORE_DECIMALS
    near = (scores >= (best.bound[asked] - margin)[:, None]) & (scores > -np.inf)
    cells = scores.shape[1]
    if cells > best.k and np.count_nonzero(near) > 8 * best.k * len(asked):
        # The block itself gives a better bound: its own k-th best.
        kth = np.partition(scores, cells - best.k, axis=1)[:, cells - best.k]
        near &= scores >= (kth - margin)[:, None]
    rows, columns = np.nonzero(near)
    if len(rows):
        best.add(asked[rows], document[columns], position[columns],
                 np.round(scores[rows, columns], SCORE_DECIMALS))


def _score_exactly(best: _Best, questions: _Questions, asked, asked_width, vectors: _Prepared, rows, width,
                   documents, positions, allowed=None) -> None:
    """All scores in double precision: for numbers beyond single precision, and for vectors of two widths."""
    metric = questions.metric
    for first in range(0, len(asked), ASKED_TILE):
        part = asked[first:first + ASKED_TILE]
        block = questions.rows.exact(part, asked_width)
        norm2 = np.einsum("ij,ij->i", block, block)
        step = max(1, min(SCORE_CELLS // len(part), BLOCK_VALUES // max(1, width)))
        for begin in range(0, len(rows), step):
            held = rows[begin:begin + step]
            if asked_width != width:
                scores = np.zeros((len(part), len(held)))
            elif metric == "cosine":
                scores = block @ vectors.exact(held, width).T
            else:
                there = vectors.exact(held, width)
                own = np.einsum("ij,ij->i", there, there)
                distance = norm2[:, None] + own[None, :] - 2.0 * (block @ there.T)
                scores = 1.0 / (1.0 + np.maximum(distance, 0.0))
            if allowed is not None:
                scores = np.where(allowed[first:first + ASKED_TILE, begin:begin + step], scores, -np.inf)
            _offer(best, part, scores, documents[held], positions[held])


def _least_product(metric: str, score: np.ndarray, norm2: np.ndarray, slip: np.ndarray) -> np.ndarray:
    """The least product in single precision that a pair of at least this score can have."""
    score = score - 10.0 ** -SCORE_DECIMALS
    if metric == "cosine":
        least = score - slip
    else:
        far = np.where(score > 0, 1.0 / np.where(score > 0, score, 1.0) - 1.0, np.inf)
        least = (norm2 - far) / 2 - slip
    return (least - 2.0 ** -22 * np.abs(least)).astype(np.float32)


def _score_block(best: _Best, questions: _Questions, asked, asked_width, vectors: _Prepared, rows, width,
                 documents, positions, allowed=None) -> None:
    """Score rows of one group and width against the questions of that group.

    Products in single precision, which differ from the exact ones by ``slip``
    at most, tell which pairs can be among the k best; only those are scored.
    ``allowed`` leaves out pairs, by place in ``asked`` and ``rows``.
    """
    metric, k = questions.metric, best.k
    if asked_width != width and metric != "cosine":
        return
    ask, ask_norms, small = questions.rows.by_width[asked_width]
    there, norms, short = vectors.by_width[width]
    if asked_width != width or not small or not short:
        _score_exactly(best, questions, asked, asked_width, vectors, rows, width, documents, positions, allowed)
        return
    place = vectors.place[rows]
    there, norms = there[place], norms[place]
    longest = norms.max()
    step = max(1, BLOCK_VALUES // max(1, 8 * width))
    for first in range(0, len(asked), ASKED_TILE):
        part = asked[first:first + ASKED_TILE]
        at = questions.rows.place[part]
        block, norm2 = ask[at], ask_norms[at]
        slip = (width + 8) * 2.0 ** -24 * (np.sqrt(norm2 * longest) + longest / 2) + 1e-30
        found = _Best(len(part), k, 2 * k * len(part))
        found.bound[:] = best.bound[part]
        for begin in range(0, len(rows), SCORED_TILE):
            held = slice(begin, begin + SCORED_TILE)
            products = block @ there[held].T
            cells = products.shape[1]
            near = products >= _least_product(metric, found.bound, norm2, slip)[:, None]
            if allowed is not None:
                near &= allowed[first:first + ASKED_TILE, held]
            count = np.count_nonzero(near)
            if allowed is None and cells > k and count > 8 * k * len(part):
                # The block itself gives a better bound: its own k-th best.
                kth = np.partition(products, cells - k, axis=1)[:, cells - k].astype(np.float64) - slip
                score = kth if metric == "cosine" else 1.0 / (1.0 + np.maximum(norm2 - 2.0 * kth, 0.0))
                near &= products >= _least_product(metric, score, norm2, slip)[:, None]
                count = np.count_nonzero(near)
            if not count:
                continue
            question, column = np.nonzero(near)
            for a in range(0, len(question), step):
                q, c = question[a:a + step], column[a:a + step] + begin
                exact = np.einsum("ij,ij->i", questions.rows.exact(part[q], width), vectors.exact(rows[c], width))
                if metric == "l2":
                    exact = 1.0 / (1.0 + np.maximum(norm2[q] + norms[c] - 2.0 * exact, 0.0))
                found.add(q, documents[rows[c]], positions[rows[c]], np.round(exact, SCORE_DECIMALS))
        found.merge()
        if found.held is not None:
            question, *rest = found.held
            best.add(part[question], *rest)
            best.bound[part] = np.maximum(best.bound[part], found.bound)


def _score_batch(best: _Best, questions: _Questions, batch) -> None:
    documents, positions = _plain(batch["document_id"]), _plain(batch["chunk_index"])
    flat, starts, widths = _vectors(batch["embedding"])
    vectors = _Prepared(flat, starts, widths, questions.metric, False)
    groupings = questions.buckets.groupings(batch, flat, starts, widths)
    for parts, groups in zip(questions.parts, groupings):
        for group, members in _by_value(groups):
            wanted = parts.get(group)
            if wanted:
                for width, at in _by_value(widths[members]):
                    for asked_width, asked in wanted.items():
                        _score_block(best, questions, asked, asked_width, vectors, members[at], width,
                                     documents, positions)


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to larger ones, so that small groups are scored less often."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= GATHER_BYTES:
            yield waiting[0] if len(waiting) == 1 else pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def _top_of(questions: _Questions, batches: Iterable, k: int, schema: pa.Schema) -> pa.Table:
    best = _Best(len(questions.ids), k)
    for batch in _gathered(batches):
        if batch.num_rows:
            _score_batch(best, questions, batch)
    best.merge()
    if best.held is None:
        return schema.empty_table()
    question, document, position, score = best.held
    return pa.table([
        pa.array(questions.ids[question], schema.field(0).type),
        pa.array(document, schema.field(1).type),
        pa.array(position, schema.field(2).type),
        pa.array(score, schema.field(3).type),
    ], schema=schema)


# --- plans ------------------------------------------------------------------------

def _result_schema(vectors: DataFrame, questions: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", questions.schema["query_id"].dataType),
        T.StructField("document_id", vectors.schema["document_id"].dataType),
        T.StructField("chunk_index", vectors.schema["chunk_index"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _in_scopes(vectors: DataFrame, scope: str, listed: Sequence | None, asked: DataFrame) -> DataFrame:
    """Vectors of the scopes asked for, so that other folders of a table kept by scope are not read.

    A short list is a filter.  A longer one, ``asked``, is joined; its filter,
    which nothing fails, is what dynamic partition pruning asks for.
    """
    if listed is not None:
        return vectors.where(F.col(scope).isin(list(listed)))
    asked = asked.select(scope).where(F.col(scope).cast("string") >= "").distinct()
    return vectors.join(F.broadcast(asked) if table_size(asked)[1] <= BROADCAST_BYTES else asked, scope, "left_semi")


def within_scopes(vectors: DataFrame, questions: DataFrame, scope: str) -> DataFrame:
    """Vectors, or chunks, whose ``scope`` some question asks for."""
    found = questions.select(scope).where(F.col(scope).isNotNull()).distinct().limit(LISTED_SCOPES + 1).collect()
    return _in_scopes(vectors, scope, [r[0] for r in found] if len(found) <= LISTED_SCOPES else None, questions)


def _scan_candidates(vectors, asked: pa.Table, k, metric, buckets: _Buckets, schema) -> DataFrame:
    """Questions on every executor, vectors scored in place.

    The scopes that are asked for become a filter of the vectors.  Every task
    gives k candidates per question, so where there would be too many in all,
    fewer tasks read more splits each.
    """
    spark = vectors.sparkSession
    if buckets.scope:
        scopes = [v for v in asked[buckets.scope].unique().to_pylist() if v is not None]
        frame = None
        if len(scopes) > LISTED_SCOPES:
            frame = spark.createDataFrame(pa.table({buckets.scope: asked[buckets.scope].unique()}))
        vectors = _in_scopes(vectors, buckets.scope, scopes if frame is None else None, frame)
    cores = spark.sparkContext.defaultParallelism
    tasks = max(cores, CANDIDATES // max(1, asked.num_rows * k))
    if asked.num_rows >= MANY_QUESTIONS:
        # Files of few row groups would leave cores idle for long.
        vectors = vectors.repartition(cores, "document_id", "chunk_index")
    elif vectors.rdd.getNumPartitions() > tasks:
        vectors = vectors.coalesce(tasks)
    arrow = to_arrow_schema(schema)
    sent = spark.sparkContext.broadcast(asked)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = _Questions(sent.value, buckets, metric)
        yield from _top_of(prepared, batches, k, arrow).to_batches()

    return vectors.mapInArrow(score, schema)


def _scans(vectors, asked: list[pa.Table], k, metric, buckets: _Buckets, schema) -> DataFrame:
    """Candidates for all blocks of questions, the vectors being scanned for each."""
    found = [_scan_candidates(vectors, block, k, metric, buckets, schema) for block in asked]
    return functools.reduce(DataFrame.unionByName, found)


def _pieces(df: DataFrame, keys: Sequence[str], rows: int, out: str) -> DataFrame:
    """Keys with more rows than one block takes, and the number of blocks they need."""
    return (df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > rows)
            .select(*keys, F.ceil(F.col("_rows") / rows).cast("int").alias(out)))


def _grid_candidates(vectors, questions, k, metric, keys, schema, tile_bytes, counted=None) -> DataFrame:
    """Blocks of vectors against blocks of questions, one task per meeting.

    ``counted`` are the vectors' keys where they can be had without reading the
    vectors.  Only keys with more than one block are listed, so that list has
    at most total rows / block rows entries.
    """
    counted = vectors if counted is None else counted
    # Grouped rows meet by the hash of their keys, which differs between 1 as int and as bigint.
    common = vectors.select(*keys).where("false").union(questions.select(*keys).where("false")).dtypes
    vectors, counted, questions = (d.withColumns({c: F.col(c).cast(kind) for c, kind in common if dict(d.dtypes)[c] != kind})
                                   for d in (vectors, counted, questions))
    width = questions.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = max(1, tile_bytes // (8 * width + 32))
    asked = broadcast_if_small(questions.select(*keys).distinct())
    vectors, counted = (d.join(asked, list(keys), "left_semi") for d in (vectors, counted))
    large = broadcast_if_small(_pieces(counted.select(*keys), keys, rows, "_tiles").join(
        _pieces(questions.select(*keys), keys, rows, "_blocks"), list(keys), "full"))
    tiles, blocks = F.coalesce("_tiles", F.lit(1)), F.coalesce("_blocks", F.lit(1))

    def own(count, *columns):
        return F.pmod(F.xxhash64(*columns), count).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), count - 1))

    left = (vectors.join(large, list(keys), "left")
            .withColumn("_tile", own(tiles, "document_id", "chunk_index"))
            .withColumn("_block", every(blocks)).drop("_tiles", "_blocks"))
    right = (questions.join(large, list(keys), "left")
             .withColumn("_block", own(blocks, "query_id"))
             .withColumn("_tile", every(tiles)).drop("_tiles", "_blocks"))
    # Fresh names keep the two sides apart when both come from one table.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    arrow = to_arrow_schema(schema)

    def meet(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not block.num_rows or not asked.num_rows:
            return arrow.empty_table()
        return _top_of(_Questions(asked, _Buckets(None), metric), block.to_batches(), k, arrow)

    by = [*keys, "_tile", "_block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)


def _final(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_index")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _prepared(vectors, questions, k, metric, within):
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    ship_package(vectors.sparkSession)
    if k < 1:
        raise ValueError("k must be at least 1")
    scope = [within] if within else []
    usable = F.size("embedding") > 0
    vectors = vectors.where(usable).select(*scope, "document_id", "chunk_index", "embedding")
    questions = questions.where(usable).select(*scope, "query_id", "embedding")
    return vectors, questions, scope, _result_schema(vectors, questions)


def _asked_once(questions: DataFrame, limit: int) -> tuple[list[pa.Table], DataFrame | None]:
    """The questions as local data in blocks of ``limit`` bytes, SCANS at most, else as a stored table.

    A short list is read at once.  Others are kept while they are measured, so
    an encoder behind them runs once but for the rows of that first look.
    """
    short = short_rows(questions, limit)
    if short is not None:
        return [short], None
    kept = questions.persist(StorageLevel.DISK_ONLY)
    try:
        size = table_size(kept)[1]
        if size <= limit:
            return [kept.toArrow()], None
        if size <= SCANS * limit:
            n = -(-size // limit)
            block = F.pmod(F.xxhash64("query_id"), F.lit(n))
            return [kept.where(block == i).toArrow() for i in range(n)], None
        path = work_path(questions.sparkSession, "questions")
        kept.write.parquet(path)
        return [], questions.sparkSession.read.schema(questions.schema).parquet(path)
    finally:
        kept.unpersist()


def top_k(vectors: DataFrame, questions: DataFrame, k: int = K.TOP_K, metric: str = "cosine",
          within: str | None = None, question_bytes: int = BROADCAST_BYTES,
          tile_bytes: int = TILE_BYTES) -> DataFrame:
    """The k best vectors per question: query_id, document_id, chunk_index, score, rank.

    ``vectors`` has document_id, chunk_index, embedding; ``questions`` has
    query_id, embedding.  With ``within`` a question only sees vectors that
    share its value of that column.  Equal scores are ordered by document and
    position.  Vectors of size 0 take no part; a question without vector gets
    no rows.
    """
    stored = vectors
    vectors, questions, scope, schema = _prepared(vectors, questions, k, metric, within)
    asked, questions = _asked_once(questions, question_bytes)
    if asked:
        return _final(_scans(vectors, asked, k, metric, _Buckets(within), schema), k)
    if not scope:
        stored, vectors, questions = (d.withColumn("_all", F.lit(0)) for d in (stored, vectors, questions))
    keys = scope or ["_all"]
    return _final(_grid_candidates(vectors, questions, k, metric, keys, schema, tile_bytes,
                                   stored.select(*keys)), k)


# --- approximate form -------------------------------------------------------------

def hyperplanes(width: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, width))


def _with_buckets(df: DataFrame, planes: np.ndarray, tables: int) -> DataFrame:
    """Rows once per hash table, with ``_table`` and the bucket of signs ``_bucket``.

    Vectors of another width get bucket -1, where only each other is met.
    """
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            codes = _sign_codes(*_vectors(column), planes, tables)
            offsets = np.arange(0, codes.size + 1, tables, dtype=np.int32)
            yield pa.ListArray.from_arrays(offsets, codes.ravel())

    hashed = F.arrow_udf(sign, T.ArrayType(T.LongType())).asNondeterministic()
    return (df.withColumn("_codes", hashed("embedding"))
            .select(*df.columns, F.posexplode("_codes").alias("_table", "_bucket")))


def top_k_lsh(vectors: DataFrame, questions: DataFrame, width: int, k: int = K.TOP_K,
              metric: str = "cosine", within: str | None = None, tables: int = 12, bits: int = 4,
              seed: int = 7, question_bytes: int = BROADCAST_BYTES,
              tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Approximate :func:`top_k`: only vectors sharing a bucket are scored.

    Scores of the hits are exact; a neighbour that shares no bucket is missed.
    More tables raise recall, more bits make buckets smaller.  The physical
    forms are those of the exact search: few questions are sent to the vectors,
    which are then hashed and scored where they are read; otherwise a bucket of
    any size is cut into blocks, so hot buckets spread.
    """
    vectors, questions, scope, schema = _prepared(vectors, questions, k, metric, within)
    planes = hyperplanes(width, tables, bits, seed)
    asked, questions = _asked_once(questions, question_bytes)
    if asked:
        buckets = _Buckets(within, planes, tables)
        return _final(_scans(vectors, asked, k, metric, buckets, schema), k)
    left, right = (_with_buckets(d, planes, tables) for d in (vectors, questions))
    keys = [*scope, "_table", "_bucket"]
    found = _grid_candidates(left, right, k, metric, keys, schema, tile_bytes)
    # One shuffle by question serves both the removal of repeats and the window.
    once = found.repartition("query_id").dropDuplicates(["query_id", "document_id", "chunk_index"])
    return _final(once, k)


# --- approximate form over a stored table -----------------------------------------

def add_bucket(df: DataFrame, width: int, bits: int, seed: int = 7) -> DataFrame:
    """Add ``bucket``, the signs of ``bits`` random projections, to partition a stored table by."""
    planes = hyperplanes(width, 1, bits, seed)

    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(_sign_codes(*_vectors(column), planes, 1)[:, 0])

    return df.withColumn("bucket", F.arrow_udf(sign, T.LongType()).asNondeterministic()("embedding"))


def add_probes(questions: DataFrame, width: int, bits: int, probes: int, seed: int = 7) -> DataFrame:
    """Questions once per bucket worth visiting, the nearest ``probes`` of them.

    A bucket is as far away as the projections that would have to change sign
    are large.
    """
    planes = hyperplanes(width, 1, bits, seed)
    probes = min(probes, 1 << bits)
    signs = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1 > 0

    def visit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            flat, starts, widths = _vectors(column)
            buckets = np.full((len(widths), probes), -1, dtype=np.int64)
            fit = np.flatnonzero(widths == width)
            if len(fit):
                margin = _matrix(flat, starts, fit, width) @ planes.T
                side = margin > 0
                # Cost of a bucket: the margins on the sides it does not share.
                cost = np.abs(margin * ~side) @ signs.T + np.abs(margin * side) @ ~signs.T
                buckets[fit] = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            offsets = np.arange(0, buckets.size + 1, probes, dtype=np.int32)
            yield pa.ListArray.from_arrays(offsets, buckets.ravel())

    visited = F.array_distinct(F.arrow_udf(visit, T.ArrayType(T.LongType())).asNondeterministic()("embedding"))
    return questions.withColumn("bucket", F.explode(visited))


def top_k_probed(bucketed: DataFrame, questions: DataFrame, width: int, bits: int, probes: int,
                 k: int = K.TOP_K, metric: str = "cosine", seed: int = 7, **limits) -> DataFrame:
    """Approximate :func:`top_k` over a table kept by :func:`add_bucket`.

    Only the folders of the visited buckets are read.  A vector is in one
    bucket, so nothing is found twice; visiting all buckets is the exact search.
    """
    asked = add_probes(questions.where(F.size("embedding") > 0), width, bits, probes, seed)
    return top_k(bucketed, asked, k, metric, within="bucket", **limits)
