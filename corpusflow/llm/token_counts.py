"""Token counts of whole texts; huge texts are encoded in overlapping chunks.

A text of more than ``step`` characters is cut into chunks that overlap by
``overlap`` characters.  Every chunk is encoded on its own, in any task, and
keeps the offsets of the tokens within its overlaps.  Two neighbours are spliced
at a position where both have a token boundary next to white space and give the
same tokens around it.  Where they have none, the document is cut again with an
overlap four times as wide, at last into one chunk.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common, tokens

STEP = 1 << 15
OVERLAP = 256
# Tokens before and after a splice that both chunks must give alike.
AGREEING = 4
_JOIN_CHARS = 1 << 16
_REMEMBERED = 400_000

_CUT = "doc_id long, text_id long, n_bytes long, n_tokens long, chunk int, begin long, last boolean, part string"
_SIDE = "array<struct<at:long,id:int,blank:boolean>>"
_CHUNK = f"text_id long, chunk int, n_tokens long, head {_SIDE}, tail {_SIDE}"


class WordCounter:
    """Tokens per word, for tokenizers that drop white space."""

    def __init__(self, path: str):
        self.tokenizer = tokens.load(path)
        self.seen: dict[str, int] = {}

    def whole(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def _fresh(self, words: list[str]) -> np.ndarray:
        """Token count of each word: words are joined by line feeds and told apart by offsets."""
        out = np.zeros(len(words), dtype=np.int64)
        ends = np.cumsum([len(w) + 1 for w in words])
        first = 0
        while first < len(words):
            base = ends[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(ends, base + _JOIN_CHARS, side="right")))
            begins = [a for a, _ in self.whole("\n".join(words[first:stop])).offsets]
            word = np.searchsorted(ends[first:stop] - base, np.array(begins, dtype=np.int64), side="right")
            out[first:stop] = np.bincount(word, minlength=stop - first)
            first = stop
        return out

    def counts(self, column: pa.Array) -> np.ndarray:
        """Token count of every text."""
        found = [np.zeros(0, np.int64)]
        for _, part in tokens.slices(column):
            words = pc.ascii_split_whitespace(part)
            offsets = words.offsets.to_numpy()
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            known = np.fromiter((self.seen.get(w, -1) for w in distinct), np.int64, len(distinct))
            new = np.flatnonzero(known < 0)
            if len(new):
                fresh = [distinct[i] for i in new]
                known[new] = self._fresh(fresh)
                if len(self.seen) + len(new) <= _REMEMBERED:
                    self.seen.update(zip(fresh, known[new].tolist()))
            sums = np.concatenate([[0], np.cumsum(known[coded.indices.to_numpy()])])
            offsets = offsets - offsets[0]
            found.append(sums[offsets[1:]] - sums[offsets[:-1]])
        return np.concatenate(found)


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> WordCounter:
    return WordCounter(path)


def chunks_of(text: str, step: int, overlap: int) -> list[tuple[int, str]]:
    """(begin, characters) of overlapping chunks; the last one ends with the text."""
    if len(text) <= step + overlap:
        return [(0, text)]
    begins = range(0, len(text) - overlap, step)
    return [(b, text[b:b + step + overlap]) for b in begins]


def side(encoded, text: str, begin: int, low: int, high: int) -> list[dict]:
    """Tokens that start within [low, high) of the whole text; blank: white space stands before."""
    out = []
    for id_, (a, _) in zip(encoded.ids, encoded.offsets):
        if low <= begin + a < high:
            out.append({"at": begin + a, "id": id_, "blank": a > 0 and text[a - 1] in common.BLANKS})
    return out


def splice(tail: list[dict], head: list[dict]) -> tuple[int, int] | None:
    """(tokens of the left chunk from the cut on, tokens of the right one before it), or None.

    ``tail`` and ``head`` are the tokens of both chunks in their common
    characters.  A cut stands before a token that follows white space in both,
    with AGREEING equal tokens on either side: further left the right chunk
    may begin, further right the left chunk may end within a word.
    """
    left = {t["at"]: i for i, t in enumerate(tail)}
    for j in range(AGREEING, len(head) - AGREEING):
        i = left.get(head[j]["at"])
        if i is None or i < AGREEING or not (head[j]["blank"] and tail[i]["blank"]):
            continue
        around = range(-AGREEING, AGREEING)
        if all(i + k < len(tail) and tail[i + k]["at"] == head[j + k]["at"]
               and tail[i + k]["id"] == head[j + k]["id"] for k in around):
            return len(tail) - i, j
    return None


def _cutter(path: str, step: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            ids, uid, text = batch.column("doc_id"), batch.column("text_id"), batch.column("text").fill_null("")
            size = pc.binary_length(text)
            n_chars = pc.utf8_length(text)
            long = pc.greater(n_chars, step + overlap)
            short = pc.invert(long)
            n = int(pc.sum(short).as_py() or 0)
            none = pa.nulls(n)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [ids.filter(short), uid.filter(short), pc.cast(size.filter(short), pa.int64()),
                     pa.array(counter.counts(text.filter(short))), none.cast(pa.int32()), none.cast(pa.int64()),
                     none.cast(pa.bool_()), none.cast(pa.string())],
                    names=["doc_id", "text_id", "n_bytes", "n_tokens", "chunk", "begin", "last", "part"])
            for row in np.flatnonzero(long.to_numpy(zero_copy_only=False)):
                row = int(row)
                cut = chunks_of(text[row].as_py(), step, overlap)
                yield _chunk_rows(ids[row].as_py(), uid[row].as_py(), size[row].as_py(), cut)
    return run


def _chunk_rows(doc_id, text_id, n_bytes, cut) -> pa.RecordBatch:
    n = len(cut)
    return pa.RecordBatch.from_arrays(
        [pa.array([doc_id] * n, pa.int64()), pa.array([text_id] * n, pa.int64()),
         pa.array([n_bytes] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int32()),
         pa.array([b for b, _ in cut], pa.int64()), pa.array([i == n - 1 for i in range(n)]),
         pa.array([t for _, t in cut], pa.string())],
        names=["doc_id", "text_id", "n_bytes", "n_tokens", "chunk", "begin", "last", "part"])


def _encoder(path: str, step: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path)
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                got = counter.whole(r.part)
                end = r.begin + len(r.part)
                rows.append((r.text_id, r.chunk, len(got.ids),
                             side(got, r.part, r.begin, r.begin, r.begin + overlap) if r.chunk else [],
                             [] if r.last else side(got, r.part, r.begin, r.begin + step, end)))
            yield pd.DataFrame(rows, columns=["text_id", "chunk", "n_tokens", "head", "tail"])
    return run


def _splicer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        cuts = [splice(list(t), list(h)) for t, h in zip(frame["tail"], frame["head"])]
        yield pd.DataFrame({"text_id": frame["text_id"], "twice": [sum(c) if c else 0 for c in cuts],
                            "failed": [c is None for c in cuts]})


def _recutter(step: int, overlap: int, wider: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        text = "".join(p if last else p[:step] for p, last in zip(frame["part"], frame["last"]))
        first = frame.iloc[0]
        return _chunk_rows(*(None if pd.isna(v) else int(v) for v in first[["doc_id", "text_id", "n_bytes"]]),
                           chunks_of(text, max(step, wider), wider)).to_pandas()
    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, step: int = STEP,
                 overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row per row of ``docs``.

    ``path``: file of a tokenizer that drops white space and never joins
    characters across it.  Uses doc_id and text; further columns are ignored.
    A null text counts as empty (0 tokens); a null or repeated doc_id is kept as
    it is, each row counts for itself.  An empty table gives an empty one.
    """
    common.ready(docs.sparkSession)
    rows = common.take(docs, "doc_id", "text").withColumn("text_id", F.monotonically_increasing_id())
    cut = common.stored(rows.mapInArrow(_cutter(path, step, overlap), _CUT), "token_counts")
    done = cut.filter("chunk is null").select("doc_id", "n_bytes", "n_tokens")
    pending = cut.filter("chunk is not null")
    while pending.limit(1).count():
        whole = pending.filter("chunk = 0").select("text_id", "doc_id", "n_bytes")
        coded = common.stored(
            pending.select("text_id", "chunk", "begin", "last", "part").repartition("text_id", "chunk")
            .mapInPandas(_encoder(path, step, overlap), _CHUNK), "token_chunks")
        left = coded.select("text_id", (F.col("chunk") + 1).alias("chunk"), "tail")
        pairs = coded.filter("chunk > 0").select("text_id", "chunk", "head").join(left, ["text_id", "chunk"])
        cuts = pairs.select("text_id", "tail", "head").mapInPandas(
            _splicer, "text_id long, twice long, failed boolean")
        sums = (coded.select("text_id", "n_tokens", F.lit(False).alias("failed"))
                .unionByName(cuts.select("text_id", (-F.col("twice")).alias("n_tokens"), "failed"))
                .groupBy("text_id").agg(F.sum("n_tokens").alias("n_tokens"), F.max("failed").alias("failed")))
        sums = common.stored(sums, "token_sums")
        good = whole.join(sums.filter("not failed"), "text_id")
        done = done.unionByName(good.select("doc_id", "n_bytes", "n_tokens"))
        wider = overlap * 4
        again = pending.join(sums.filter("failed").select("text_id"), "text_id")
        pending = common.stored(again.groupBy("text_id").applyInPandas(_recutter(step, overlap, wider), _CUT),
                                "token_recut")
        step, overlap = max(step, wider), wider
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, folder):
    """Token counts of all documents with the word-level vocabulary."""
    return count_tokens(common.table(spark, folder, "documents"), tokens.tokenizer_path("word_bpe_49k.json"))
