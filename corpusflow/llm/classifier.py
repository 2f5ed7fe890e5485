"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL-proximal.

A text is the counts of its hashed n-grams, divided by the square root of their
number: words and pairs of words, and the same of word shapes, in which letters
are told apart by case only.  Training rows are dealt over shards; each shard runs
follow-the-regularised-leader updates over its documents, and the weights of
the shards are averaged.  Scoring is a sparse dot product per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common

BITS = 20
#: Most labelled documents that a model is fitted on, those with the smallest hash of doc_id.
TRAINING_ROWS = 16_000
#: Training rows per shard.
SHARD_ROWS = 2_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.01
THRESHOLD = 0.3
FOLDS = 5


def _letters() -> np.ndarray:
    """Byte classes for shapes: a for small and other letters, A for capitals, 0 for digits, else the byte."""
    out = np.arange(256, dtype=np.uint8)
    out[97:123] = out[128:] = ord("a")
    out[65:91] = ord("A")
    out[48:58] = ord("0")
    return out


_SHAPE = _letters()


def shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with every run of bytes of one class written once, such as ``Aa a, a***``."""
    classes = _SHAPE[data]
    kept = np.ones(len(data), bool)
    kept[1:] = classes[1:] != classes[:-1]
    inner = offsets[offsets < len(data)]
    kept[inner] = True
    return classes[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def _n_grams(data: np.ndarray, offsets: np.ndarray, shift: np.uint64, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of words and pairs of neighbours, number of the text of each).

    Pairs of equal words have one number in common, whatever the word.
    """
    hashes, begin = common.word_hashes(data, offsets, lower=False)
    owner = np.searchsorted(offsets, begin, side="right") - 1
    with np.errstate(over="ignore"):
        hashes = hashes + np.uint64(salt)
        left, right = hashes[:-1], hashes[1:]
        pairs = common.mixed(np.where(left == right, np.uint64(salt), left * np.uint64(31) + right))
        same = owner[:-1] == owner[1:]
        return (np.concatenate([common.mixed(hashes), pairs[same]]) >> shift).astype(np.int64), np.concatenate(
            [owner, owner[1:][same]])


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, offsets of the texts in them): n-grams of the words and of their shapes."""
    shift = np.uint64(64 - bits)
    plain, shaped = _n_grams(data, offsets, shift, 1), _n_grams(*shapes(data, offsets), shift, 2)
    numbers, owner = (np.concatenate(pair) for pair in zip(plain, shaped))
    order = np.argsort(owner, kind="stable")
    return numbers[order], np.searchsorted(owner[order], np.arange(len(offsets)))


class Ftrl:
    """FTRL-proximal logistic regression over hashed features; the last weight is the bias."""

    def __init__(self, size: int):
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        squares = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(squares) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = squares


def _train(bits: int, epochs: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("draw")
        model = Ftrl(1 << bits)
        examples = []
        row = 0
        labels = frame["label"].to_numpy()
        for _, data, offsets in common.text_buffers(pa.array(frame["text"], pa.string())):
            found, bounds = features(data, offsets, bits)
            for a, b in zip(bounds, bounds[1:]):
                at, count = np.unique(found[a:b], return_counts=True)
                x = np.append(count / np.sqrt(max(b - a, 1)), 1.0)
                examples.append((np.append(at, 1 << bits), x, labels[row]))
                row += 1
        for _ in range(epochs):
            for example in examples:
                model.learn(*example)
        weights = model.weights(np.arange(len(model.z)))
        used = np.flatnonzero(weights)
        return pd.DataFrame({"feature": used, "weight": weights[used]})
    return run


def _score(weights: np.ndarray, bits: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in common.text_buffers(batch.column("text")):
                found, bounds = features(data, offsets, bits)
                sums = np.concatenate([[0.0], np.cumsum(weights[found], dtype=np.float64)])
                total = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(np.diff(bounds), 1))
                score = 1 / (1 + np.exp(-np.clip(total + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(first, len(score)) for c in ("doc_id", "held_out")], pa.array(score),
                     pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])
    return run


def held_out(doc_id) -> F.Column:
    """Whether a document belongs to the fold that is never learnt from; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS,
        training_rows: int = TRAINING_ROWS, shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights per feature, the bias last.

    Fitted on at most ``training_rows`` labelled documents outside the held-out
    fold.  A document with several labels has the smallest one; null labels,
    null doc_ids and labels without a document don't count.  Without any
    training row all weights are 0, so every score is 0.5.
    """
    common.ready(docs.sparkSession)
    known = (common.take(labels, "doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
             .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("label"))
             .join(common.take(docs, "doc_id"), "doc_id", "left_semi"))
    draw = F.xxhash64("doc_id", F.lit(11))
    chosen = known.withColumn("draw", draw).orderBy("draw", "doc_id").limit(training_rows)
    chosen = common.stored(chosen, "training_labels")
    shards = max(1, -(-chosen.count() // shard_rows))
    rows = common.join_small(common.take(docs, "doc_id", "text"), chosen, "doc_id").select(
        F.pmod(F.shiftright("draw", 8), F.lit(shards)).alias("shard"), "draw", "label",
        F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.groupBy("shard").applyInPandas(_train(bits, epochs), "feature long, weight double")
    # A feature that a shard has not seen has the weight 0 there.
    model = parts.groupBy("feature").agg(F.sum("weight").alias("weight")).toPandas()
    weights = np.zeros((1 << bits) + 1)
    weights[model["feature"]] = model["weight"] / shards
    return weights.astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of ``docs``.

    Uses doc_id and text; the score comes from the text alone.  A null text
    counts as empty and has the score of the bias.
    """
    bits = int(np.log2(len(weights) - 1))
    rows = common.take(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(_score(weights, bits, threshold),
                           "doc_id long, held_out boolean, score double, predicted int")


def op8_quality_classifier(spark, folder):
    """Quality scores of all documents."""
    docs = common.table(spark, folder, "documents")
    return score(docs, fit(docs, common.table(spark, folder, "labels")))
