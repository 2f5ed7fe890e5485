"""Line dedup by pairwise alignment of documents that share rare lines.

A run of lines is what documents are found by: the shortest runs of following
lines that have the words of a block, a single line if it has them itself.  Of
such a run only the first document that holds it counts, so each later holder
has one partner per run, however frequent it is; rare and frequent runs are
treated alike and none is left out.  A pair of documents is aligned by patience
diff over the runs they share: those that either has once and that stand in the
same order, then what has moved or is repeated.  Aligned runs that follow one
another in both are a block, and blocks go from the later document.

Every line of a common block lies in a shortest run of the block, and the first
holder of that run comes no later than any other document with the block: so
all common blocks go, and nothing outside of them.  A later document receives a
row per run it shares, with the places on both sides, and never the lines of its
partners, so the work is linear in shared lines.  The first holder of a run
never loses it.
"""

from __future__ import annotations

import bisect
import itertools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common

#: Words that a common block needs to be deleted: shorter lines coincide by chance.
BLOCK_WORDS = 8


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, ascending by the first number, in which the second ascends too."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect.bisect_left(tails, j)
        back[k] = at[n - 1] if n else -1
        tails[n:n + 1] = [j]
        at[n:n + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def anchors(first: list[int], later: list[int]) -> list[tuple[int, int]]:
    """Places of lines that occur once in either document, in an order both have."""
    once, too = Counter(first), Counter(later)
    where = {h: i for i, h in enumerate(first) if once[h] == 1}
    pairs = sorted((where[h], j) for j, h in enumerate(later) if too[h] == 1 and h in where)
    return _increasing(pairs)


def chains(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Numbers of the pairs, which ascend by the first number, dealt to as few sequences as ascend by the second too."""
    tails: list[int] = []
    found: list[list[int]] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect.bisect_left(tails, j) - 1
        if n < 0:
            tails.insert(0, j)
            found.insert(0, [k])
        else:
            tails[n] = j
            found[n].append(k)
    return found


def blocks(shared: list[tuple[int, int, bool]]) -> list[list[int]]:
    """Numbers of the shared runs of two documents, by common block.

    A run is (place in the later document, place in the first one, whether it
    stands once in both), in the order of the former.  Patience diff aligns the
    runs that stand once; the others, moved or repeated, are aligned in
    sequences of their own.  Runs at the same distance that follow one another
    are one block.
    """
    once = [k for k, (_, _, alone) in enumerate(shared) if alone]
    kept = _increasing([(shared[k][0], shared[k][1]) for k in once])
    main = set(kept)
    aligned = [[k for k in once if (shared[k][0], shared[k][1]) in main]]
    rest = [k for k in range(len(shared)) if not (shared[k][2] and (shared[k][0], shared[k][1]) in main)]
    aligned += [[rest[n] for n in chain] for chain in chains([(shared[k][0], shared[k][1]) for k in rest])]
    out: list[list[int]] = []
    for chain in aligned:
        for n, k in enumerate(chain):
            here, there, _ = shared[k]
            last = shared[chain[n - 1]] if n else None
            if last and here - last[0] <= 1 and there - last[1] == here - last[0]:
                out[-1].append(k)
            else:
                out.append([k])
    return out


def held_runs(lines: list[tuple[int, int, int]], least: int) -> list[tuple[tuple[int, ...], int, int]]:
    """(hashes, begin, end) of the runs of a document."""
    return [(tuple(h for _, h, _ in lines[i:j]), i, j) for i, j in runs(lines, least)]


def deleted(first: list[tuple[int, int, int]], later: list[tuple[int, int, int]], least: int) -> list[int]:
    """Line numbers of the common blocks of ``least`` words or more in the later of two documents.

    Both are lists of (line number, hash, words), in which lines that follow one
    another have numbers that do.
    """
    there = held_runs(first, least)
    here = held_runs(later, least)
    times, own = Counter(r for r, _, _ in there), Counter(r for r, _, _ in here)
    place = {r: first[i][0] for r, i, _ in reversed(there)}
    shared = [(r, i, j) for r, i, j in here if r in place]
    found = blocks([(later[i][0], place[r], times[r] == own[r] == 1) for r, i, _ in shared])
    return sorted({n for block in found for k in block for n, _, _ in later[shared[k][1]:shared[k][2]]})


def runs(lines: list[tuple[int, int, int]], least: int) -> list[tuple[int, int]]:
    """Begin and end of the runs of following lines with ``least`` words or more that lose them without their last line,
    or without their first.

    Which runs these are depends on their own lines only, so documents with a
    block in common have its runs in common, and these cover the block.
    """
    out: set[tuple[int, int]] = set()
    begin = 0
    for stop in range(1, len(lines) + 1):
        if stop < len(lines) and lines[stop][0] == lines[stop - 1][0] + 1:
            continue
        sums = [0, *itertools.accumulate(w for _, _, w in lines[begin:stop])]
        for k in range(len(sums) - 1):
            end = bisect.bisect_left(sums, sums[k] + least, k + 1)
            if end < len(sums):
                out.add((begin + k, begin + end))
            start = bisect.bisect_right(sums, sums[k + 1] - least, 0, k + 1) - 1
            if start >= 0:
                out.add((begin + start, begin + k + 1))
        begin = stop
    return sorted(out)


def _listed(batch: pa.RecordBatch, name: str) -> Iterator[list[tuple[int, int, int]]]:
    """Number among the lines with words, hash and words of the lines of each row."""
    lists = batch.column(name)
    parts = [lists.values.field(c).to_numpy().tolist() for c in ("n", "h", "words")]
    at = lists.offsets.to_numpy()
    for r in range(len(batch)):
        yield [*zip(*(p[at[r]:at[r + 1]] for p in parts))]


def _runs(least: int):
    """The runs of the lines of each row: where they begin, how often the document has them, the lines to delete, the hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, times, lines_of, hashes = [], [], [], [], []
            at = batch.column("lines").offsets.to_numpy()
            pos = batch.column("lines").values.field("pos").to_numpy()
            for r, lines in enumerate(_listed(batch, "lines")):
                found = held_runs(lines, least)
                often = Counter(h for h, _, _ in found)
                rows += [r] * len(found)
                places += [lines[i][0] for _, i, _ in found]
                times += [often[h] for h, _, _ in found]
                lines_of += [pos[at[r] + i:at[r] + j] for _, i, j in found]
                hashes += [h for h, _, _ in found]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("t").take(take), pa.array(places, pa.int32()),
                 pa.array(times, pa.int32()), pa.array(lines_of, pa.list_(pa.int32())),
                 pa.array(hashes, pa.list_(pa.int64()))],
                names=["id", "t", "n", "times", "pos", "run"])
    return run


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to delete of each later document, from the runs it shares with each of its partners."""
    for batch in batches:
        out = []
        for row in batch.column("shared"):
            partners: dict[tuple[int, int], list[dict]] = {}
            for run in sorted(row.as_py(), key=lambda x: (x["n"], x["there"])):
                partners.setdefault((run["first_id"], run["first_t"]), []).append(run)
            gone: set[int] = set()
            for own in partners.values():
                for block in blocks([(x["n"], x["there"], x["once"]) for x in own]):
                    for k in block:
                        gone.update(own[k]["pos"])
            out.append(sorted(gone))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(out, pa.list_(pa.int32()))],
                                         names=["id", "t", "lines"])


#: Documents without doc_id come after all others.
_LAST = (1 << 63) - 1


def _named(docs: DataFrame, *more: str) -> DataFrame:
    """Documents with their place in the order: doc_id (null last), then hash of the text."""
    return (common.take(docs, "doc_id", "text", *more)
            .withColumn("id", F.coalesce("doc_id", F.lit(_LAST))).withColumn("t", F.xxhash64("text")))


def removals(docs: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """id, t, lines (ascending line numbers to delete), a row per document that loses any."""
    line = F.col("line")
    # Numbered once lines without a word are gone, as they don't part a block; pos tells what to delete.
    worded = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))),
                      lambda x: x["line"].rlike(common.WORD))
    lines = (_named(docs).select("id", "t", F.posexplode(worded).alias("n", "at"))
             .select("id", "t", "n", "at.pos", "at.line")
             .select("id", "t", "n", "pos", F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"),
                     common.count_words(line).alias("words")))
    lines = common.stored(lines.dropDuplicates(["id", "t", "pos"]), "lines")
    doc = F.struct("id", "t")

    def shared_by(found: DataFrame, name: str, first) -> DataFrame:
        shared = found.groupBy("h", "g").agg(F.min(first).alias("first"), F.max(doc).alias("last")).filter(
            "first.id <> last.id or first.t <> last.t")
        # Stored, so that a frequent line's side of the join is a plain shuffle, which adaptive execution can split.
        return common.stored(shared.select("h", "g", "first"), name)

    held = lines.join(shared_by(lines, "shared_lines", doc).drop("first"), ["h", "g"]).select(
        "id", "t", "n", "pos", "h", "words")
    lists = held.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("n", "h", "words", "pos"))).alias("lines"))
    run = common.stored(
        lists.mapInArrow(_runs(least), "id long, t long, n int, times int, pos array<int>, run array<long>")
        .select("id", "t", "n", "times", "pos", F.xxhash64("run").alias("h"), F.xxhash64(F.lit(1), "run").alias("g")), "runs")
    once = F.struct("id", "t", "n", "times")
    pairs = run.join(shared_by(run, "shared_runs", once), ["h", "g"]).filter("id <> first.id or t <> first.t")
    shared = F.struct(F.col("first.id").alias("first_id"), F.col("first.t").alias("first_t"), "n",
                      F.col("first.n").alias("there"), ((F.col("times") == 1) & (F.col("first.times") == 1)).alias("once"),
                      "pos")
    return (pairs.groupBy("id", "t").agg(F.collect_list(shared).alias("shared"))
            .mapInArrow(_align, "id long, t long, lines array<int>"))


def _without(text, lines):
    """The text without the numbered lines."""
    split = F.split(text, "\n")
    return F.transform(F.array(split), lambda s: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(s) - 1), lines), lambda i: s[i]), "\n"))[0]


def dedup_lines(docs: DataFrame, least: int = BLOCK_WORDS, *more: str) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_words, text: a row per row of ``docs``.

    ``least``: words that a block needs.  ``more``: further columns to keep.
    Uses doc_id and text.  Lines are what line feeds separate; lines without a
    word are never deleted for themselves and never part a block.  A null text has no lines and stays
    null.  Documents are ordered by doc_id, null last, then by the hash of the
    text; rows alike in both are one document and share its fate.
    """
    common.ready(docs.sparkSession)
    gone = common.stored(removals(docs, least), "removals")
    gone = gone.select(F.col("id").alias("_id"), F.col("t").alias("_t"), F.col("lines").alias("_lines"))
    rows = common.join_small(_named(docs, *more), gone, (F.col("id") == F.col("_id")) & (F.col("t") == F.col("_t")),
                             "left")
    lost = F.col("_lines").isNotNull()
    text = F.when(lost, _without(F.col("text"), F.col("_lines"))).otherwise(F.col("text"))
    n_lines = F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")) + 1, F.lit(0))
    words = F.when(lost, common.count_words(F.col("text")) - common.count_words(text)).otherwise(0)
    return rows.select("doc_id", n_lines.cast("long").alias("n_lines"),
                       F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_removed_lines"),
                       words.cast("long").alias("n_removed_words"), text.alias("text"), *more)


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents without their repeated blocks, in the columns doc_id, text, lang, source, n_chars.

    A document of which nothing is left goes.
    """
    rows = dedup_lines(docs, BLOCK_WORDS, "lang", "source")
    return (rows.filter((F.col("n_removed_lines") == 0) | F.col("text").rlike(common.WORD))
            .select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")))


def op9_line_dedup(spark, folder):
    """All documents without blocks that an earlier document has."""
    return dedup_lines(common.table(spark, folder, "documents"))
