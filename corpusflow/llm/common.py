"""What the operators share: input columns, written tables, words and row hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import broadcast_or_none, ship_package, work_path

# ASCII white space; everything else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def take(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with ours."""
    return df.select(*[F.col(f"`{name}`") for name in names])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again.

    Cuts the lineage: what follows reads files that survive lost executors and
    doesn't compute ``df`` a second time.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join that moves ``big`` only if ``small``, measured first, is too large to broadcast.

    ``small`` should be a stored table, as measuring reads it.
    """
    sent = broadcast_or_none(small)
    return big.join(small if sent is None else sent, on, how)


def count_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def ready(spark: SparkSession) -> SparkSession:
    """The session, with this package known to the Python workers."""
    ship_package(spark)
    return spark


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixing of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BLOCK = 1 << 16


def _powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count - 1) modulo 2**64."""
    out = np.full(count, np.uint64(base), dtype=np.uint64)
    if count:
        out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


_UP = _powers(_MULTIPLIER, _BLOCK)
_DOWN = _powers(pow(_MULTIPLIER, -1, 1 << 64), _BLOCK)
_STEP = np.uint64(pow(_MULTIPLIER, _BLOCK, 1 << 64))
_BACK = np.uint64(pow(pow(_MULTIPLIER, -1, 1 << 64), _BLOCK, 1 << 64))
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[ord(c) for c in BLANKS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word in texts that lie one after the other in a buffer of UTF-8 bytes.

    The hash of a word is a polynomial in its bytes modulo 2**64, each byte
    replaced by a random number, then mixed.  It is taken from running sums over
    the buffer, so no word becomes a Python object.
    """
    word = ~_IS_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[0] = cut[-1] = True
    begin, end = cut.copy(), cut.copy()
    begin[1:-1] |= ~word[:-1]
    end[1:-1] |= ~word[1:]
    begin, end = np.flatnonzero(begin[:-1] & word), np.flatnonzero(end[1:] & word) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    scale = np.uint64(1)
    last = np.uint64(0)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), _BLOCK):
            part = data[at:at + _BLOCK]
            terms = _BYTES[_LOWER[part] if lower else part] * _UP[:len(part)]
            terms *= scale
            np.cumsum(terms, out=sums[at + 1:at + 1 + len(part)])
            sums[at + 1:at + 1 + len(part)] += last
            last = sums[at + len(part)]
            scale = scale * _STEP
        words = sums[end] - sums[begin]
        backs = _powers(int(_BACK), len(data) // _BLOCK + 1)
        words *= _DOWN[begin % _BLOCK]
        words *= backs[begin // _BLOCK]
        words ^= (end - begin).astype(np.uint64)
        return mixed(words), begin


def text_buffers(column: pa.Array, limit: int = 1 << 22) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop
