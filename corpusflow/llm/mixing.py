"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

The documents of a source are shuffled by a hash and queue up, if need be
several times over.  The virtual finish time of a document is the number of
words its source has queued up to its end, divided by the source's target.  All
sources are served in the order of finish times until the budget, the number
of words of all documents, is used up.

Running sums are taken in steps, over ranges of buckets, over buckets and within
them, so no task sees a whole source.  The time at which the budget runs out is
found by counting the words of slots of time, again and again within the slot
in which it does, until few documents are left.  Rows alike in doc_id, source
and size queue in blocks, so a row that is repeated very often is never in one
task either, but each of them is served for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm import common

#: Most times that a document is taken.
REPEATS = 3
BUCKET_ROWS = 2_000
#: Equal rows that queue as one block, and buckets whose sums are added up in one task.
BLOCK_ROWS = 1_000
BUCKETS = 1_024
#: Slots of time counted at once, and documents among which the last one is looked for.
SLOTS = 1_024
LAST_ROWS = 2_000
_BITS = 28


def sized(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, size (words), block, rows, a row per block of rows alike in the first three, with the shuffle key."""
    rows = common.take(docs, "doc_id", "source", "text").select(
        "doc_id", "source", common.count_words(F.col("text")).alias("size"))
    blocks = (rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_rows)))))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                    F.when(F.col("block") > 0, F.concat(F.lit("#"), F.col("block").cast("string"))).otherwise(""))
    return blocks.select("doc_id", "source", "size", "block", F.md5(name.cast("binary")).alias("key"), F.least(
        F.col("n") - F.col("block") * block_rows, F.lit(block_rows).cast("long")).alias("rows"))


def running(rows: DataFrame, group: str, value: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` of the earlier rows of a group, as ``before``, stored.

    Rows are ordered by ``bucket``, then by ``order``.  Ranges of buckets, the
    buckets of a range and the rows of a bucket are added up each for themselves.
    """
    sums = common.stored(rows.groupBy(group, "bucket").agg(F.sum(value).alias("sum")), f"{name}_buckets")
    sums = sums.withColumn("range", F.floor(F.col("bucket") / BUCKETS))
    ranges = sums.groupBy(group, "range").agg(F.sum("sum").alias("all"))
    ranges = ranges.select(group, "range", (F.sum("all").over(
        Window.partitionBy(group).orderBy("range")) - F.col("all")).alias("earlier"))
    inside = F.sum("sum").over(Window.partitionBy(group, "range").orderBy("bucket")) - F.col("sum")
    sums = sums.withColumn("inside", inside).join(ranges, [group, "range"]).select(
        group, "bucket", (F.col("inside") + F.col("earlier")).alias("until_bucket"))
    within = Window.partitionBy(group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = common.join_small(rows, common.stored(sums, f"{name}_sums"), [group, "bucket"]).withColumn(
        "before", F.col("until_bucket") + F.sum(value).over(within) - F.col(value))
    return common.stored(out.drop("until_bucket"), name)


def targets(sizes: DataFrame) -> DataFrame:
    """source, rank, source_size, target: a row per source.

    Ordered by source_size / weight, the sources that reach their limit come
    first, so the level at which the others are filled follows from running sums.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("ratio", "rank")
    below = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = (sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
            .withColumn("rank", F.row_number().over(rank))
            .withColumn("weight", (F.col("rank") - 1) % 3 + 1)
            .withColumn("cap", F.col("source_size") * REPEATS)
            .withColumn("ratio", F.col("cap") / F.col("weight")))
    rows = rows.withColumn("level", (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0))).cast("double")
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0)))))
    # The first source, in this order, whose limit is not below the level ends the row of limited ones.
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)
    return rows.withColumn("at", level["level"]).select(
        "source", "rank", "source_size",
        F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight")).alias("target"))


def _finish(turn: Column, number: Column) -> Column:
    """Virtual finish time of the row with this number in its block, in a turn; null for a source without words."""
    words = turn * F.col("source_size") + F.col("before") + number * F.col("size")
    return words.cast("double") / F.nullif(F.col("target"), F.lit(0.0))


def _items(queue: DataFrame, first: float, last: float) -> DataFrame:
    """The rows with words that finish from ``first`` to ``last``, in all turns; blocks outside are not opened."""
    turn, number = F.col("turn"), F.col("number")
    items = queue.filter("size > 0 and target > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    items = items.filter((_finish(turn, F.col("rows")) >= first) & (_finish(turn, F.lit(1)) <= last))
    items = items.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return items.withColumn("finish", _finish(turn, number)).filter((F.col("finish") >= first) & (F.col("finish") <= last))


#: Order in which documents are served.
_ORDER = ["finish", "rank", "turn", "key", "size", "block", "number"]


def _end(queue: DataFrame, budget: int):
    """The first document that the budget doesn't cover, by its place in the order; None if it covers all."""
    first, last, served, left = 0.0, float("inf"), 0, None
    while True:
        items = _items(queue, first, last)
        if left is None:
            left, words, last = items.agg(F.count("*"), F.sum("size"), F.max("finish")).first()
            if not left or words <= budget:
                return None
            continue
        if left <= LAST_ROWS or first == last:
            break
        slot = F.least(F.floor((F.col("finish") - first) / F.lit((last - first) / SLOTS)), F.lit(SLOTS - 1))
        slots = sorted(items.groupBy(slot.alias("slot")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"), F.min("finish").alias("first"),
            F.max("finish").alias("last")).collect(), key=lambda r: r["slot"])
        for r in slots:
            if served + r["words"] > budget:
                break
            served += r["words"]
        stuck = (r["first"], r["last"]) == (first, last)
        first, last, left = r["first"], r["last"], r["n"]
        if stuck:
            break
    until = F.sum("size").over(Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(served)
    return items_until(_items(queue, first, last), until, budget)


def items_until(items: DataFrame, until: Column, budget: int):
    """The first of few items at which the budget is exceeded."""
    return items.withColumn("until", until).filter(F.col("until") > budget).agg(
        F.min(F.struct(*_ORDER)).alias("m")).first()["m"]


def mix(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: a row per row of ``docs``.

    copies: how often the mix takes the document, 0 to 3.  Uses doc_id, source
    and text.  A null text has size 0; a null source is a source of its own, the
    last.  Rows alike in doc_id, source and size follow one another in the queue
    and may differ by one copy.  An empty table gives an empty one.
    """
    sizes = common.stored(sized(docs, block_rows), "mix_sizes")
    parts = max(1, min(1 << _BITS, -(-sizes.count() // bucket_rows)))
    sources = common.stored(targets(sizes), "mix_sources")
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    number = F.conv(F.substring("key", 1, _BITS // 4), 16, 10).cast("long")
    named = sources.withColumnRenamed("source", "_source")
    keyed = common.join_small(sizes, named, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "block", "rows", "key", "rank", "source_size", "target",
        F.shiftright(number * parts, _BITS).alias("bucket"), (F.col("size") * F.col("rows")).alias("words"))
    queue = running(common.stored(keyed, "mix_keyed"), "rank", "words", ["key", "doc_id", "size", "block"], "mix_queue")
    end = _end(queue, budget)
    copies = sum((F.when(_before(end, turn), 1).otherwise(0) for turn in range(REPEATS)), F.lit(0))
    rows = queue.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def _before(end, turn: int) -> Column:
    """Whether a document is served in a turn before the first one that the budget doesn't cover."""
    finish = _finish(F.lit(turn), F.col("number"))
    if end is None:
        return finish.isNotNull()
    now = {"finish": finish, "turn": F.lit(turn)}
    out = F.lit(False)
    for name in reversed(_ORDER):
        value = now.get(name, F.col(name))
        out = (value < end[name]) | ((value == end[name]) & out)
    return finish.isNotNull() & out


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words): a row per row of ``docs``."""
    return mix(docs).select("doc_id", "size", "source_size", "target",
                            (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix in the columns doc_id, text, lang, source, n_chars, each as often as it is taken.

    Of rows alike in doc_id, source and size that differ by one copy, those with
    the smaller hashes of their columns are taken once more.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    chosen = mix(docs).groupBy("doc_id", "source", "size").agg(
        F.min("copies").alias("least"), F.max("copies").alias("most"), F.sum("copies").cast("long").alias("sum"),
        F.count("*").alias("n"))
    chosen = common.stored(chosen.filter("most > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "least", "most",
        (F.col("sum") - F.col("n") * F.col("least")).alias("more")), "mixed")
    rows = common.take(docs, *names).withColumn("_words", common.count_words(F.col("text")))
    same = (F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
            & (F.col("_words") == F.col("_size")))
    alike = common.join_small(rows, chosen.filter("least = most"), same)
    out = alike.select(*names, F.col("most").cast("long").alias("_copies"))
    split = chosen.filter("least < most")
    if split.limit(1).count():
        out = out.unionByName(_shared_out(common.join_small(rows, split, same), names))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*names)


def _shared_out(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of groups of which ``more`` rows get one copy more than ``least``: each distinct row with the copies of all like it."""
    group = F.xxhash64("_id", "_source", "_size")
    own = rows.groupBy(*names, "_size", "least", "more", group.alias("group")).agg(F.count("*").alias("n"))
    own = common.stored(own.withColumn("key", F.xxhash64(*names)).withColumn(
        "bucket", F.shiftrightunsigned("key", 44)), "mix_shared")
    place = running(own.select("group", "bucket", "key", "n"), "group", "n", ["key"], "mix_places")
    place = place.select(F.col("group").alias("_group"), F.col("key").alias("_key"), "before").distinct()
    copies = F.col("n") * F.col("least") + F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.col("before")))
    found = own.join(place, (F.col("group") == F.col("_group")) & (F.col("key") == F.col("_key")))
    return found.select(*names, copies.cast("long").alias("_copies")).filter("_copies > 0")


def op10_mixing(spark, folder):
    """All documents mixed to weights 1, 2, 3 by source."""
    return taken(common.table(spark, folder, "documents"))


OP10_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS number,
    (row_number() OVER (PARTITION BY doc_id, source, size) - 1) // {BLOCK_ROWS} AS block FROM sized),
keyed AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN block > 0 THEN '#' || block ELSE '' END) AS key FROM numbered),
sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
    CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM sources),
ordered AS (
  SELECT *, source_size * {REPEATS} / weight AS ratio,
    CAST(sum(source_size) OVER () - coalesce(sum(source_size * {REPEATS}) OVER f, 0) AS DOUBLE)
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS DOUBLE) AS level
  FROM weighed WINDOW f AS (ORDER BY source_size * {REPEATS} / weight, rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT level FROM ordered WHERE ratio >= level ORDER BY ratio, rank LIMIT 1),
targets AS (
  SELECT source, rank, source_size, least(CAST(source_size * {REPEATS} AS DOUBLE), weight * level.level) AS target
  FROM weighed, level),
queue AS (
  SELECT k.*, rank, source_size, target,
    CAST(sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id, size, number
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS queued
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT *, CAST(turn * source_size + queued AS DOUBLE) / target AS finish
  FROM queue, (SELECT unnest(range({REPEATS})) AS turn) WHERE target > 0),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, turn, key, size, number
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM items),
copies AS (
  SELECT doc_id, source, size, number, count(*) AS copies FROM served
  WHERE until <= (SELECT sum(source_size) FROM sources) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(c.copies, 0) AS BIGINT) AS taken
FROM queue q LEFT JOIN copies c ON q.doc_id IS NOT DISTINCT FROM c.doc_id
  AND q.source IS NOT DISTINCT FROM c.source AND q.size = c.size AND q.number = c.number
"""
