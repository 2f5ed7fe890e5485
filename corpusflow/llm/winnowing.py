"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of K code points is hashed, and of every window of W such hashes in a
row the smallest is chosen, the rightmost of equal ones.  Chosen hashes are
kept with their positions.  Whatever two texts have in common over
``W + K - 1`` code points or more gives both a window with the same hashes and
so at least one hash in common, at positions that lie equally far from the
beginning of the common run; nothing shorter than K is ever matched.

A text is cut into chunks that overlap by what a window needs, so the arrays of
a moment are bounded by a chunk, whatever the length of the text.  Within a
chunk the code points lie in 4 bytes each, where a gram is found without
counting characters.  A hash and its place counted down are one number, so the
smallest number is the rightmost smallest hash; minima of windows of 2, 4, 8 ...
hashes follow from each other, each by one pass.

Whether a hash is chosen depends on the windows around it only, so of a text of
which a part was replaced only the windows that touch it are looked at again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.llm.common import let

#: Code points of a gram, and grams of a window.
K, W = 12, 16
#: Code points of a chunk, without what it has from the next one.
CHUNK = 4096
# Low bits of a number within a chunk, which hold the place in bytes.
_PLACE = (1 << 15) - 1
_POSITIONS = (1 << 31) - 1
#: Text or rows of one block of neighbours, and most blocks.
BLOCK_BYTES = 16 * 1024 * 1024
BLOCK_ROWS = 1000
MAX_BLOCKS = 1 << 14
#: Rows whose order keys choose the borders of blocks; they decide nothing else.
SAMPLED_PER_BLOCK = 32


def _minima(grams: Column, width: int) -> Column:
    """Minimum of the window that ends at each gram; windows are cut off at both ends."""
    def further(by: int) -> Callable[[Column], Column]:
        none = F.array_repeat(F.lit(None).cast("bigint"), by)
        return lambda v: F.zip_with(v, F.concat(none, v), lambda a, b: F.least(a, b))

    reach = 1
    while reach < width:
        by = min(reach, width - reach)
        grams = let(grams, further(by))
        reach += by
    return grams


def _of_chunk(points: Column, number: Column, k: int, width: int, chunk: int) -> Column:
    """Chosen hashes of the windows that begin in a chunk; ``points``: 4 bytes a code point."""
    first = number == 0

    def chosen(count: Column) -> Column:
        places = F.sequence(F.lit(1), count * 4 - 3, F.lit(4))
        grams = F.transform(places, lambda i: F.xxhash64(F.substring(points, i, F.lit(4 * k))).bitwiseOR(
            F.lit(_PLACE).cast("bigint")) - i)
        full = F.slice(_minima(grams, width), F.least(count, F.lit(width)), F.greatest(count - (width - 1), F.lit(1)))
        return F.when(count >= F.when(first, 1).otherwise(width), F.transform(F.array_distinct(full), placed)).otherwise(
            F.array().cast("array<bigint>"))

    def placed(x: Column) -> Column:
        inside = F.shiftright(F.lit(_PLACE - 1) - x.bitwiseAND(F.lit(_PLACE).cast("bigint")), 2)
        return F.shiftleft(F.shiftrightunsigned(x, 32), 31) + (F.lit(_POSITIONS) - inside - number * chunk)

    n = F.shiftright(F.octet_length(points), 2)
    return let(F.when(first & (n > 0), F.greatest(n - (k - 1), F.lit(1))).otherwise(n - (k - 1)), chosen)


def winnowed(text: Column, k: int = K, width: int = W, chunk: int = CHUNK) -> Column:
    """Chosen hashes of a text by position, each as one number; none for an empty or null text.

    A text shorter than ``k`` is one gram, one with fewer than ``width`` grams one window.
    """
    if 4 * (chunk + k + width) > _PLACE:
        raise ValueError("chunk, k and width are too large")
    chunks = F.regexp_extract_all(F.coalesce(text, F.lit("")),
                                  F.lit(rf"(?s)(?=(.{{1,{chunk + k + width - 2}}})).{{1,{chunk}}}"), F.lit(1))
    found = F.transform(chunks, lambda c, j: let(
        F.encode(c, "UTF-32"), lambda points: _of_chunk(points, j.cast("bigint"), k, width, chunk)))
    return F.array_distinct(F.flatten(found))


def hash_of(chosen: Column) -> Column:
    """The hash of a chosen number."""
    return F.shiftright(chosen, 31)


def position_of(chosen: Column) -> Column:
    """The position, in code points from 0, of a chosen number."""
    return (F.lit(_POSITIONS) - chosen.bitwiseAND(F.lit(_POSITIONS))).cast("int")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints; of two empty ones 1."""
    def of(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))

    def hashes(x: Column) -> Column:
        return F.array_distinct(F.transform(x, hash_of))

    return let(F.struct(hashes(left).alias("a"), hashes(right).alias("b")), lambda s: of(s["a"], s["b"]))


def written(chosen: Column) -> Column:
    """A fingerprint as text: hash in hexadecimal digits, a colon and the position, parted by blanks."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(
        F.lower(F.hex(hash_of(x))), F.lit(":"), position_of(x).cast("string"))), " ")


def fingerprints(docs: DataFrame, k: int = K, width: int = W) -> DataFrame:
    """doc_id, n_chars, fingerprint (array of hash long and position int): a row per row of ``docs``.

    Uses doc_id and text; further columns are ignored.  A null text is empty and
    has no hashes; null and repeated doc_ids are kept as they are; equal texts
    have equal fingerprints.  A narrow transformation: nothing is shuffled.
    """
    rows = common.take(docs, "doc_id", "text").withColumn("_w", winnowed(F.col("text"), k, width))
    return rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.transform(
        "_w", lambda x: F.struct(hash_of(x).alias("hash"), position_of(x).alias("position"))).alias("fingerprint"))


def _order_key(doc_id: Column, text: Column) -> Column:
    """Text that sorts as doc_id does, null last, then by a hash of the text."""
    def digits(x: Column) -> Column:
        return F.lpad(F.hex(x), 16, "0")

    number = doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.coalesce(F.concat(F.lit("0"), digits(number)), F.lit("1")), digits(F.xxhash64(text)))


def _block(key: Column, borders: list[str]) -> Column:
    """Number of the last border that isn't above the key, by bisection; the first border is the least key."""
    table = F.array(*[F.lit(b) for b in borders])
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(max(1, len(borders).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s) <= key, at + s).otherwise(at))


def with_next(docs: DataFrame, derived: dict[str, Column], block_bytes: int = BLOCK_BYTES,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text and the derived columns, with next_text and next_... of the following document; the last is followed by the first.

    ``derived``: columns computed from doc_id and text.  Order: doc_id, null
    last, then a hash of the text; rows alike in both follow each other.

    Rows are dealt to blocks between borders that are keys of sampled rows, and
    a border's row is also sent to the block before, as the neighbour of its
    last row.  So the texts move once, and a block is one sorted group of
    bounded size, not the whole table.  A row that is repeated so often that it
    would fill blocks of its own is counted instead, before the shuffle.
    """
    rows = common.take(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("_key", _order_key(F.col("doc_id"), F.col("text")))
    n, size, least = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min("_key")).first()
    blocks = max(1, min(MAX_BLOCKS, max(size // block_bytes, n // block_rows)))
    most = SAMPLED_PER_BLOCK * blocks
    sample = rows.select("_key").sample(min(1.0, most / max(n, 1)), seed=11).limit(2 * most).toArrow()["_key"].to_pylist()
    sample.sort()
    borders = sorted({least or ""} | {sample[i * len(sample) // blocks] for i in range(1, blocks) if sample})
    often = sorted({a for a, b in zip(sample, sample[max(1, 2 * len(sample) // blocks):]) if a == b}) if n > block_rows else []
    one = rows.withColumn("_copies", F.lit(1).cast("long"))
    if often:
        counted = rows.filter(F.col("_key").isin(often)).groupBy("_key").agg(
            F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("_copies"))
        one = one.filter(~F.col("_key").isin(often)).unionByName(counted)
    dealt = one.withColumn("_at", _block(F.col("_key"), borders))
    place = F.struct(F.col("_at").alias("block"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("_at") - 1, F.lit(len(borders))).alias("block"), F.lit(True).alias("guest"))
    border = F.get(F.array(*[F.lit(b) for b in borders]), F.col("_at"))
    dealt = dealt.withColumn("_in", F.explode(
        F.when(F.col("_key") == border, F.array(place, before)).otherwise(F.array(place))))
    dealt = dealt.select("doc_id", "text", "_key", "_copies", F.col("_in.block").alias("_block"),
                         F.col("_in.guest").alias("_guest")).repartition(len(borders), "_block")
    order = Window.partitionBy("_block").orderBy("_guest", "_key", "text")
    names = ["text", *derived]
    out = dealt.withColumns(derived)
    out = out.withColumns({f"next_{c}": F.lead(c).over(order) for c in names}).filter("not _guest")
    if often:  # all copies but the last are followed by a copy
        out = out.withColumn("_own", F.explode(F.when(F.col("_copies") > 1, F.array(F.lit(True), F.lit(False))).otherwise(
            F.array(F.lit(False)))))
        out = out.withColumns({f"next_{c}": F.when(F.col("_own"), F.col(c)).otherwise(F.col(f"next_{c}")) for c in names})
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.when(
            F.col("_own"), F.col("_copies") - 1).otherwise(1))))
    return out.select("doc_id", *names, *[f"next_{c}" for c in names])


def rewinnowed(chosen: Column, text: Column, same: Column, k: int = K, width: int = W) -> Column:
    """:func:`winnowed` of a text, given what another text that agrees with it in the first ``same`` code points has.

    Windows that lie within these code points choose alike.  Only the last of
    them and all later windows are looked at.
    """
    last = same - (k + width - 1)
    begin = F.greatest(last - (width - 2), F.lit(0))
    kept = F.when(last >= 0, F.filter(chosen, lambda x: position_of(x) <= last)).otherwise(F.array().cast("array<bigint>"))
    tail = winnowed(F.substring(text, begin + 1, F.length(text)), k, width)
    return F.array_distinct(F.concat(kept, F.transform(tail, lambda x: x - begin)))


def edited(docs: DataFrame, k: int = K, width: int = W, **sizes) -> DataFrame:
    """doc_id, text, edited_text, chosen, edited_chosen, next_chosen: every text and its edited form with their fingerprints.

    Edited: the last quarter of the code points, rounded down, replaced by as
    many of the next document's first ones, or all it has.
    """
    rows = with_next(docs, {"chosen": winnowed(F.col("text"), k, width)}, **sizes)
    rows = rows.withColumn("_cut", F.shiftright(F.length("text"), 2)).withColumn("_same", F.length("text") - F.col("_cut"))
    rows = rows.withColumn("edited_text", F.concat(
        F.substring("text", F.lit(1), F.col("_same")), F.substring("next_text", F.lit(1), F.col("_cut"))))
    rows = rows.withColumn("edited_chosen", rewinnowed(F.col("chosen"), F.col("edited_text"), F.col("_same"), k, width))
    return rows.select("doc_id", "text", "edited_text", "chosen", "edited_chosen", "next_chosen")


def compared(docs: DataFrame, k: int = K, width: int = W, **sizes) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per row of ``docs``.

    Uses doc_id and text; further columns are ignored.  A null text is empty; an
    empty text has an empty fingerprint, and two empty ones have likeness 1.  A
    table of one row is followed by itself; an empty table gives an empty one.
    """
    rows = edited(docs, k, width, **sizes)
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        written(F.col("chosen")).alias("fingerprint"), written(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"),
        likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"))


def op11_winnowing(spark, folder):
    """Fingerprints of all documents and of their edited texts."""
    return compared(common.table(spark, folder, "documents"))
