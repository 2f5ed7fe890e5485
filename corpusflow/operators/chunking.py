"""Splitting texts into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.text import trim_control


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")


def fixed_chunks(text: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Array of chunks of ``size`` characters starting every ``size - overlap``.

    The text is cut once into steps; a chunk is its own step plus the start of
    the following ones.  Work is linear in the length of the text, where taking
    a substring at every offset would walk the text from its start each time.
    """
    _check(size, overlap)
    step = size - overlap
    steps = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))
    if overlap:
        following = -(-overlap // step)

        def widen_all(pieces: Column) -> Column:
            def widen(piece: Column, i: Column) -> Column:
                tail = [F.coalesce(F.get(pieces, i + n), F.lit("")) for n in range(1, following + 1)]
                return F.substring(F.concat(piece, *tail), 1, size)

            return F.transform(pieces, widen)

        # One-element wrapping binds the steps, so the text is cut only once.
        chunks = F.get(F.transform(F.array(steps), widen_all), 0)
    else:
        chunks = steps
    return F.when(F.length(text) > 0, chunks).otherwise(F.array().cast("array<string>"))


def paragraph_chunks(text: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Array of paragraphs; one longer than ``size`` is split by fixed size."""
    _check(size, overlap)
    paragraphs = F.transform(F.split(text, "\\n\\n+"), trim_control)
    kept = F.filter(paragraphs, lambda p: p != "")
    parts = F.transform(
        kept,
        lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(fixed_chunks(p, size, overlap)),
    )
    return F.when(F.length(text) > 0, F.flatten(parts)).otherwise(F.array().cast("array<string>"))


def chunk_expression(strategy: str, text: Column, size: int = K.CHUNK_SIZE,
                     overlap: int = K.CHUNK_OVERLAP) -> Column:
    """``paragraph`` in any case chooses paragraphs, anything else fixed size."""
    if strategy.lower() == "paragraph":
        return paragraph_chunks(text, size, overlap)
    return fixed_chunks(text, size, overlap)


def chunk_documents(documents: DataFrame, strategy: str = "fixed", size: int = K.CHUNK_SIZE,
                    overlap: int = K.CHUNK_OVERLAP, text: str = "text") -> DataFrame:
    """One row per chunk: the other columns, ``chunk_index`` from 0, ``content``.

    A narrow transformation: no shuffle, and the scan splits long texts by
    bytes already.
    """
    others = [F.col(f"`{c}`") for c in documents.columns if c != text]
    chunks = chunk_expression(strategy, F.col(text), size, overlap)
    return documents.select(*others, F.posexplode(chunks).alias("chunk_index", "content"))
