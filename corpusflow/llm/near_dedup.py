"""Near-duplicate documents by MinHash.

1. Each document's set of word shingles gives a fingerprint and minima under
   many universal hash functions.  Documents of one fingerprint are one class,
   and only classes go on, so exact copies cost nothing from here.
2. Bands of minima are bucket keys.  Every class of a bucket is compared with
   the first one of the bucket, by signature, then on the full sets.  The links
   give components by alternating large-star and small-star.
3. What may still be missing are links between classes of one bucket that are in
   different components.  Buckets with more than one component are cut into
   blocks, and each class outside a bucket's largest component meets all the
   others, by signature within a task.  Classes live in homes of bounded size; a
   class asks for each home of which some signature agrees, and is compared
   there in full.  Classes of one component are not compared again, and pairs
   never become rows, only links do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.llm.components import components

PERCENT = 80
BANDS, ROWS = 42, 6
#: Signatures that agree less, in standard deviations below the threshold, are not compared in full.
DEVIATIONS = 5
BLOCK = 512
#: Classes of a component in open buckets, below which it has no homes of its own.
SMALL = 16
#: Classes that one copy of a home answers.
ASKING = 4096

_SIGNED = "doc_id long, t long, n_shingles long, class_id long, check long, signature binary, bands array<long>"
#: Nodes of classes that no doc_id names begin here.
NAMELESS = 1 << 62
_SETS = "node long, wanted long, class_id long, check long, shingles binary"


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the universal hash functions x -> a x + b modulo 2**32."""
    drawn = common.mixed(np.arange(1, 2 * count + 1, dtype=np.uint64)) >> np.uint64(32)
    return drawn[:count].astype(np.uint32) | np.uint32(1), drawn[count:].astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted per text; offsets of the texts in them)."""
    hashes, begin = common.word_hashes(data, offsets)
    first = np.searchsorted(begin, offsets)
    words = np.diff(first)
    long = words >= width
    count = np.where(long, words - width + 1, np.minimum(words, 1))
    starts = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        windows = max(len(hashes) - width + 1, 0)
        rolled = np.zeros(windows, np.uint64)
        for k in range(width):
            rolled = common.mixed(rolled * np.uint64(31) + hashes[k:k + windows])
        short = np.flatnonzero((words > 0) & ~long)
        single = np.array([_sequence_hash(hashes[first[r]:first[r + 1]]) for r in short], np.uint64)
    values = np.empty(starts[-1], np.uint64)
    of_short = np.zeros(len(values), bool)
    of_short[starts[short]] = True
    values[of_short] = single
    owner = np.repeat(np.arange(len(words)), words)[:windows]
    values[~of_short] = rolled[np.arange(windows) + width <= first[owner + 1]]
    for a, b in zip(starts, starts[1:]):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[starts[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return values[new], kept[starts]


def _sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of words, its length included."""
    out = common.mixed(np.array([len(hashes)], np.uint64))
    for h in hashes:
        out = common.mixed(out * np.uint64(33) + h)
    return out[0]


def signatures(values: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """Minima of each set under ``count`` functions; sets must not be empty."""
    a, b = _functions(count)
    top = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, count), np.uint32)
    row = 0
    while row < len(out):  # so many rows that their numbers stay in the processor's cache
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (1 << 15), side="right")) - 1)
        part, starts = top[offsets[row]:offsets[stop]], offsets[row:stop] - offsets[row]
        turned = np.empty_like(part)
        for k in range(count):
            np.multiply(part, a[k], out=turned)
            np.add(turned, b[k], out=turned)
            out[row:stop, k] = np.minimum.reduceat(turned, starts)
        row = stop
    return out


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data, offsets in common.text_buffers(batch.column("text")):
                values, bounds = shingle_sets(data, offsets, width)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                prints = fingerprints(values, bounds)
                keys = np.zeros((len(some), bands), np.uint64)
                marks = np.zeros((len(some), 0), np.uint8)
                if len(some):
                    with np.errstate(over="ignore"):
                        minima = signatures(values, np.append(bounds[some], len(values)), bands * rows)
                        for k in range(bands * rows):
                            keys[:, k // rows] = common.mixed(keys[:, k // rows] * np.uint64(31) + minima[:, k])
                    marks = minima.astype(np.uint8)
                signs = [None] * len(size)
                for i, row in enumerate(some):
                    signs[row] = marks[i].tobytes()
                lists = np.zeros(len(size) + 1, np.int32)
                lists[1:] = np.cumsum(np.where(size > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(size)), batch.column("t").slice(first, len(size)), pa.array(size.astype(np.int64)),
                     pa.array(prints[0].view(np.int64), mask=size == 0), pa.array(prints[1].view(np.int64)),
                     pa.array(signs, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(keys.ravel().view(np.int64)))],
                    names=["doc_id", "t", "n_shingles", "class_id", "check", "signature", "bands"])
    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in common.text_buffers(batch.column("text")):
                values, bounds = shingle_sets(data, offsets, width)
                prints = fingerprints(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, len(bounds) - 1) for c in ("node", "wanted")),
                     *map(pa.array, prints.view(np.int64)),
                     pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
                    names=["node", "wanted", "class_id", "check", "shingles"])
    return run


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers per set, from sums over its hashes and its size."""
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    out = np.zeros((2, len(size)), np.uint64)
    with np.errstate(over="ignore"):
        if len(some):
            out[0, some] = np.add.reduceat(values, bounds[some])
            out[1, some] = np.add.reduceat(common.mixed(values), bounds[some])
        return common.mixed(out * np.uint64(31) + size.astype(np.uint64))


def least_agreement(percent: int, count: int) -> int:
    """Equal minima that two signatures need to be compared in full."""
    p = percent / 100
    return max(1, int(np.floor(count * p - DEVIATIONS * np.sqrt(count * p * (1 - p)))))


def _agree(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1)
                           for c in ("su", "sv"))
            near = (left == right).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in "uv"], names=["u", "v"])
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for left, right in zip(batch.column("su"), batch.column("sv")):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                near.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in "uv"], names=["u", "v"])
    return run


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the runs of rows that agree in all columns."""
    keys = np.stack(columns)
    edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
    return zip(np.append(0, edges).tolist(), np.append(edges, keys.shape[1]).tolist())


def _meet(least: int):
    """Which classes have to be compared in full with which home blocks.

    Rows come sorted by block of a bucket; one that continues in the next batch
    is carried over.  A class outside the bucket's largest component asks for
    the home of every class of another component whose signature agrees.
    """

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        marks = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(len(rows), -1)
        ids, parts, home, own = (rows.column(c).to_numpy() for c in ("node", "component", "home", "own"))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in _runs(*(rows.column(c).to_numpy() for c in ("bucket", "in_all", "in_own"))):
            for i in a + np.flatnonzero(own[a:b]):
                near = (parts[a:b] != parts[i]) & ((marks[a:b] == marks[i]).sum(axis=1) >= least)
                homes = np.unique(home[a:b][near])
                found.append(np.stack([np.full(len(homes), ids[i]), homes], axis=1))
        found = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["node", "home"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([carried, rows]).combine_chunks() if carried is not None else rows
            if not len(rows):
                continue
            *_, (open_at, _) = _runs(*(rows.column(c).to_numpy() for c in ("bucket", "in_all", "in_own")))
            carried = rows.slice(open_at)
            if open_at:
                yield pairs(rows.slice(0, open_at))
        if carried is not None and len(carried):
            yield pairs(carried)
    return run


def _compare(percent: int):
    """Links between classes that ask and the classes of a home block, on full sets.

    Rows come sorted by home and part: the classes at home first, which are kept
    until the next home begins, then those that ask, one after the other.
    """

    def links(node, component, asked, home) -> list[tuple[int, int]]:
        nodes, parts, values, starts, sizes = home
        at = np.searchsorted(asked, values)
        at[at == len(asked)] = 0
        both = np.add.reduceat(asked[at] == values, starts, dtype=np.int64)
        near = (parts != component) & (100 * both >= percent * (sizes + len(asked) - both))
        return [(min(node, v), max(node, v)) for v in nodes[near].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, home = None, [], None
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("home", "part", "own", "node", "component")]
            for *now, own, node, component, shingles in zip(*columns, batch.column("shingles")):
                values = np.frombuffer(shingles.as_buffer(), np.uint64)
                if now != key:
                    key, members, home = now, [], None
                if not own:
                    members.append((node, component, values.copy()))
                elif members:
                    if home is None:
                        sizes = np.array([len(v) for *_, v in members])
                        home = (np.array([n for n, *_ in members]), np.array([c for _, c, _ in members]),
                                np.concatenate([v for *_, v in members]), np.cumsum(sizes) - sizes, sizes)
                    found += links(node, component, values, home)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)],
                                             names=["u", "v"])
    return run


def _with(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``pairs`` (u, v) with the column of both ends as su and sv."""
    u = values.select(F.col("node").alias("u"), F.col(column).alias("su"))
    v = values.select(F.col("node").alias("v"), F.col(column).alias("sv"))
    return pairs.join(u, "u").join(v, "v").select("u", "v", "su", "sv")


def _classes(signed: DataFrame) -> DataFrame:
    """class_id, check, node, least, signature, bands: a row per distinct set, stored.

    least is the smallest doc_id of the class, null if it has none.  It is the
    node too, so that buckets are compared with their earliest class; of several
    classes of one least doc_id, that is several texts of it, one has it as node
    and the others, as those without doc_id, a number of their own above all doc_ids.
    """
    named = signed.filter("class_id is not null and doc_id is not null").groupBy("class_id", "check").agg(
        F.min("doc_id").alias("least"))
    shared = common.stored(named.groupBy("least").agg(F.count("*").alias("n"), F.min("class_id").alias("owner")).filter(
        "n > 1").drop("n"), "shared_ids")
    rows = signed.filter("class_id is not null").groupBy("class_id", "check").agg(
        F.min("doc_id").alias("least"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    rows = common.join_small(rows, shared, "least", "left")
    own = F.col("least").isNotNull() & (F.col("owner").isNull() | (F.col("owner") == F.col("class_id")))
    node = F.when(own, F.col("least")).otherwise(F.monotonically_increasing_id() + F.lit(NAMELESS))
    return common.stored(rows.select("class_id", "check", node.alias("node"), "least", "signature", "bands"), "classes")


def _links(classes: DataFrame, sets_of, least: int, percent: int) -> DataFrame:
    """Links (u, v) that join the nodes of every component; ``sets_of``: nodes -> node, shingles."""
    keys = (classes.select("node", F.posexplode("bands").alias("band", "value"))
            .select("node", F.xxhash64("band", "value").alias("bucket")))
    buckets = keys.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    # Stored, so that a large bucket's side of the join is a plain shuffle, which adaptive execution can split.
    buckets = common.stored(buckets.filter("n > 1").drop("n"), "shared_buckets")
    members = common.stored(keys.join(buckets, "bucket").select("bucket", "node", "first"), "buckets")
    marks = common.stored(classes.select("node", "signature").join(members.select("node").distinct(), "node"), "marks")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = common.stored(pairs, "pairs")
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        sets = sets_of(common.stored(ends, "ends"))
        return common.stored(_with(pairs, sets, "shingles").mapInArrow(_confirm(percent), "u long, v long"), "links")

    stars = members.filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    first = confirmed(_with(stars, marks, "signature").mapInArrow(_agree(least), "u long, v long"))
    parts = common.stored(components(first), "parts")

    # What is left: buckets whose classes are not all in one component.
    placed = members.select("bucket", "node").join(parts, "node", "left")
    placed = common.stored(placed.select("bucket", "node", F.coalesce("component", "node").alias("component")), "placed")
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = (sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all"))
             .filter(F.col("m.n") < F.col("all"))
             .select("bucket", F.col("m.component").alias("largest"), F.ceil(F.col("all") / BLOCK).alias("n_all"),
                     F.ceil((F.col("all") - F.col("m.n")) / BLOCK).alias("n_own")))
    open_ = common.stored(placed.join(common.stored(mixed, "mixed"), "bucket"), "open")
    homes = common.stored(_homes(open_), "homes")

    # Blocks of the classes outside the largest component meet blocks of all classes of the bucket.
    drawn = F.xxhash64("node", F.lit(7))
    rows = open_.join(homes.drop("component"), "node").join(marks, "node").select(
        "bucket", "node", "component", "signature", "home", (F.col("component") != F.col("largest")).alias("other"),
        "n_all", "n_own", F.pmod(drawn, "n_all").alias("in_all"), F.pmod(drawn, "n_own").alias("in_own"))
    rows = common.stored(rows, "meeting")
    every = rows.withColumn("in_own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_own") - 1))).withColumn(
        "own", F.lit(False))
    other = rows.filter("other").withColumn(
        "in_all", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_all") - 1))).withColumn("own", F.lit(True))
    block = ["bucket", "in_all", "in_own"]
    asks = (every.unionByName(other).select(*block, "node", "component", "signature", "home", "own")
            .repartition(*block).sortWithinPartitions(*block).mapInArrow(_meet(least), "node long, home long"))
    asks = common.stored(asks.distinct(), "asks")
    return parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(
        _answers(asks, homes, sets_of, percent))


def _homes(open_: DataFrame) -> DataFrame:
    """node, component, home of the classes in open buckets: about BLOCK classes to a home.

    Classes of a component live together, those of very small ones with others
    of a bucket they share, so a class asks for few homes.
    """
    nodes = open_.groupBy("node", "component").agg(F.min("bucket").alias("bucket"))
    count = nodes.groupBy("component").agg(F.count("*").alias("n"))
    placed = nodes.join(count, "component").select("node", "component", F.when(
        F.col("n") >= SMALL, F.xxhash64(F.lit(1), "component")).otherwise(F.xxhash64(F.lit(2), "bucket")).alias("at"))
    placed = common.stored(placed, "living")
    blocks = placed.groupBy("at").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    return placed.join(blocks, "at").select(
        "node", "component", F.xxhash64("at", F.pmod(F.xxhash64("node", F.lit(3)), "n")).alias("home"))


def _answers(asks: DataFrame, homes: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links (u, v) of the classes that ask, with the homes they ask for.

    A home that very many ask for is copied for every ASKING of them.
    """
    parts = common.stored(asks.groupBy("home").agg(F.ceil(F.count("*") / ASKING).alias("n")), "asked_homes")
    members = homes.join(parts, "home").select(
        "home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part"), "node", "component",
        F.lit(False).alias("own"))
    asking = asks.join(parts, "home").join(homes.select("node", "component"), "node").select(
        "home", F.pmod(F.xxhash64("node", F.lit(5)), "n").alias("part"), "node", "component", F.lit(True).alias("own"))
    rows = common.stored(members.unionByName(asking), "meetings")
    sets = sets_of(common.stored(rows.select("node").distinct(), "ends"))
    return common.stored(rows.join(sets, "node").select("home", "part", "own", "node", "component", "shingles")
                         .repartition("home", "part").sortWithinPartitions("home", "part", "own")
                         .mapInArrow(_compare(percent), "u long, v long"), "links")


def _grouped(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component (a node), component_id: a row per row of ``docs``.

    component is null for a text without shingles; component_id is the smallest doc_id of the component, or null.
    """
    common.ready(docs.sparkSession)
    docs = common.take(docs, "doc_id", "text").withColumn("t", F.xxhash64("text"))
    signed = common.stored(docs.mapInArrow(_sign(width, bands, rows), _SIGNED), "minhash")
    classes = _classes(signed)
    mark = F.xxhash64("class_id", "check")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Full sets of the wanted nodes, from the texts of their smallest doc_ids that have the class."""
        own = common.stored(wanted.join(classes.select("node", "class_id", "check", "least"), "node"), "wanted")
        named = own.filter("least is not null").select(F.col("least").alias("_least"), "node", mark.alias("wanted"))
        texts = common.join_small(docs.filter("doc_id is not null"), named, F.col("doc_id") == F.col("_least"))
        sets = texts.select("node", "wanted", "text").mapInArrow(_full_sets(width), _SETS).filter(mark == F.col("wanted"))
        none = F.lit(None).cast("long")
        nameless = docs.filter("doc_id is null").select(none.alias("node"), none.alias("wanted"), "text").mapInArrow(
            _full_sets(width), _SETS).select("class_id", "check", "shingles")
        nameless = nameless.join(own.filter("least is null").select("class_id", "check", "node"), ["class_id", "check"])
        return common.stored(sets.select("node", "shingles").unionByName(nameless.select("node", "shingles"))
                             .dropDuplicates(["node"]), "sets")

    found = _links(classes, sets_of, least_agreement(percent, bands * rows), percent)
    parts = common.stored(components(found), "components")
    placed = classes.select("class_id", "check", "node", "least").join(parts, "node", "left")
    placed = common.stored(placed.select("class_id", "check", F.coalesce("component", "node").alias("component"), "least"), "placed")
    labels = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    names = common.join_small(placed.drop("least"), common.stored(labels, "labels"), "component")
    return common.join_small(signed.select("doc_id", "t", "n_shingles", "class_id", "check"), common.stored(names, "names"),
                             ["class_id", "check"], "left").drop("class_id", "check")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of ``docs``.

    Two documents are linked if their sets of ``width``-word shingles (words
    split at ASCII white space, A-Z in lower case) have a Jaccard similarity of
    ``percent`` or more; a text of fewer words is one shingle.  component_id is
    the smallest doc_id within reach, kept says that it is the document itself.

    Uses doc_id and text; further columns are ignored.  A null or blank text has
    no shingles and is linked with nothing.  Rows that share a doc_id each
    belong to the component of their own text.  A null doc_id never names a
    component: such a row is kept only if its component has no doc_id at all,
    and then component_id is null.  An empty table gives an empty one.

    A link at the threshold itself is missed with a probability of
    (1 - 0.8**6)**42, that is 3 in a million, and less above it.
    """
    out = _grouped(docs, width, percent, bands, rows)
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of each group, in the columns doc_id, text, lang, source, n_chars.

    The row with the smallest doc_id, null last, then with the smallest hash of
    the text; of rows alike in both any one.  Every row without words is a group
    of its own.
    """
    rows = common.take(docs, "doc_id", "text", "lang", "source", "n_chars").withColumn("_hash", F.xxhash64("text"))
    grouped = _grouped(docs, width, PERCENT, BANDS, ROWS).filter("component is not null")
    alike = grouped.groupBy("component", "doc_id", "t").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "n")
    kept = common.stored(alike.groupBy("component").agg(F.min(first).alias("m")).select(
        F.col("m.doc_id").alias("_id"), F.col("m.t").alias("_t"), F.col("m.n").alias("_n")), "kept")
    worded = F.coalesce(F.col("text").rlike(common.WORD), F.lit(False))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_t"))
    out = common.join_small(rows.filter(worded), kept.filter("_n = 1"), same, "left_semi")
    if kept.filter("_n > 1").limit(1).count():
        out = out.unionByName(common.join_small(rows.filter(worded), kept.filter("_n > 1"), same, "left_semi")
                              .dropDuplicates(["doc_id", "_hash"]))
    return out.unionByName(rows.filter(~worded)).drop("_hash")


def op1_near_dedup(spark, folder):
    """Near-duplicate groups of all documents by 2-word shingles."""
    return near_duplicates(common.table(spark, folder, "documents"), width=2)
