"""Fill-in-the-middle: texts cut at unit borders into prefix, middle and suffix, found by a wavelet matrix over character classes.

Every byte of a block of texts belongs to one of eight classes.  A wavelet
matrix of the classes answers rank queries, how many bytes of a class lie
before a place, in three steps.  A kind of unit is a set of classes whose bytes
end one; ranks of these classes add up to boundary counts, differences of such
counts at the ends of a text give its units, and bisection on the ranks finds
the place after so many units.  Both cuts of all texts of a block are located at
once.  Continuation bytes are a class too, so ranks also turn places into
numbers of code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common

LINE_FEED, BLANK, STOP, CONTINUATION, MARK, DIGIT, LETTER, LEAD = range(8)
LEVELS = 3
#: Classes whose bytes end a unit, by kind of unit.
UNITS = {"line": (LINE_FEED,), "sentence": (LINE_FEED, STOP), "word": (LINE_FEED, BLANK)}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PERCENT, SPM_PERCENT = 7, 100, 50

_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _classes() -> np.ndarray:
    """Class of each byte."""
    out = np.full(256, MARK, np.uint8)
    out[0x80:0xC0] = CONTINUATION
    out[0xC0:] = LEAD
    for letters in (range(65, 91), range(97, 123)):
        out[list(letters)] = LETTER
    out[48:58] = DIGIT
    out[[ord(c) for c in common.BLANKS]] = BLANK
    out[[ord(c) for c in ".!?"]] = STOP
    out[ord("\n")] = LINE_FEED
    return out


CLASS_OF = _classes()


class Bits:
    """Bits with the number of ones before every word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.before = np.cumsum(ones, dtype=np.int64) - ones

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones among the first ``place`` bits."""
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Rank and select over numbers below 8."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.levels: list[tuple[int, Bits, int]] = []
        for level in reversed(range(LEVELS)):
            ones = (values >> level) & 1 == 1
            self.levels.append((level, Bits(ones), self.size - int(np.count_nonzero(ones))))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value: int, place: np.ndarray) -> np.ndarray:
        """How often ``value`` occurs before each place."""
        begin, end = np.zeros(1, np.int64), np.asarray(place, np.int64)
        for level, bits, zeros in self.levels:
            if value >> level & 1:
                begin, end = zeros + bits.rank(begin), zeros + bits.rank(end)
            else:
                begin, end = begin - bits.rank(begin), end - bits.rank(end)
        return end - begin

    def count(self, values: tuple[int, ...], place: np.ndarray) -> np.ndarray:
        """How often any of ``values`` occurs before each place."""
        return sum(self.rank(v, place) for v in values)

    def select(self, values: tuple[int, ...], number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least place between ``low`` and ``high`` before which ``number`` of ``values`` occur, by bisection on ranks."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.count(values, middle) >= number
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 from the seed and the doc_id; a null doc_id is the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in range(0, 16, 4)]


def _cut(data: np.ndarray, offsets: np.ndarray, ends: tuple[int, ...], drawn: np.ndarray) -> tuple[np.ndarray, ...]:
    """(units, places of both cuts, code points before the first and between the cuts) of every text of a block."""
    matrix = WaveletMatrix(CLASS_OF[data])
    first, last = offsets[:-1], offsets[1:]
    before = matrix.count(ends, first)
    closed = matrix.count(ends, last) - before
    # What follows the last end is a unit of its own.
    tail = (last > first) & (matrix.count(ends, np.maximum(last - 1, first)) - before == closed)
    units = closed + tail
    cuts = np.sort(drawn[:, :2] % (units + 1)[:, None], axis=1)
    low, high = (np.where(u >= units, last, matrix.select(ends, before + u, first, last)) for u in cuts.T)
    chars = [b - a - (matrix.rank(CONTINUATION, b) - matrix.rank(CONTINUATION, a)) for a, b in ((first, low), (low, high))]
    return units, low, high, *chars


def _transform(unit: str, seed: int, percent: int, spm_percent: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, data, offsets in common.text_buffers(batch.column("text")):
                own = ids.slice(row, len(offsets) - 1)
                drawn = np.array([draws(seed, i) for i in own.to_pylist()], np.int64)
                units, low, high, before, between = _cut(data, offsets, UNITS[unit], drawn)
                whole, forms, out = data.tobytes(), [], []
                for a, m, n, b, (_, _, h, g) in zip(offsets.tolist(), low.tolist(), high.tolist(), offsets[1:].tolist(),
                                                    drawn.tolist()):
                    text = whole[a:b]
                    if not text or h % 100 >= percent or any(mark in text for mark in marks):
                        forms.append("plain")
                        out.append(text)
                        continue
                    parts = whole[a:m], whole[n:b], whole[m:n]
                    forms.append("spm" if g % 100 < spm_percent else "psm")
                    order = (0, 1, 2) if forms[-1] == "psm" else (1, 0, 2)
                    out.append(b"".join(marks[k] + parts[k] for k in order))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(units), pa.array(forms), pa.array(before, mask=plain), pa.array(between, mask=plain),
                     pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def infilled(docs: DataFrame, unit: str = "line", seed: int = SEED, percent: int = PERCENT,
             spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output: a row per row of ``docs``.

    ``percent`` of the texts are turned, ``spm_percent`` of these with the
    suffix first (spm), the others with the prefix first (psm).  Form is plain,
    the output the text itself and the numbers of code points null where a text
    is empty, isn't drawn or contains a marker.  All draws depend on seed and
    doc_id only, so reruns and repeated rows agree.

    Uses doc_id and text; further columns are ignored.  A null text is empty; a
    null doc_id draws as an empty one.  A narrow transformation: blocks of about
    4 MB of texts, or one longer text, are turned at a time.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    common.ready(docs.sparkSession)
    return common.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _transform(unit, seed, percent, spm_percent), _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")

    def joined(*order: int) -> Column:
        return F.concat(*[parts[k] for k in order])

    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)


def op12_infill(spark, folder):
    """All documents with a middle to fill in, and what they are rebuilt to."""
    rows = infilled(common.table(spark, folder, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\\x0A]*\\x0A|[^\\x0A]+') AS u FROM documents),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
      OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= {PERCENT} THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM docs),
cut AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
    array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
    ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM cut
"""
