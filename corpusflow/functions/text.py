"""Text expressions.  All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import constants as K


def trim_control(text: Column) -> Column:
    """Strip every leading and trailing character up to U+0020."""
    return F.btrim(text, F.lit(K.TRIM_CHARS))


def _other_than(chars: str) -> str:
    """Pattern of one character that is none of ``chars``; it is found at once in ordinary text."""
    return "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def has_text(text: Column) -> Column:
    """True if something is left after trimming; false for null."""
    return F.coalesce(text.rlike(_other_than(K.TRIM_CHARS)), F.lit(False))


def is_blank(text: Column) -> Column:
    """True for null, empty and all-white-space text (Unicode white space)."""
    return ~F.coalesce(text.rlike(_other_than(K.BLANK_CHARS)), F.lit(False))


def clean_for_embedding(text: Column) -> Column:
    """Drop form feeds, fold white-space runs to one blank, trim.

    Blank text is passed through as it is.
    """
    folded = F.regexp_replace(F.replace(text, F.lit("\f"), F.lit("")), "[ \\t\\n\\x0B\\r]+", " ")
    return F.when(is_blank(text), text).otherwise(trim_control(folded))


def file_type(name: Column) -> Column:
    """Supported type named by the suffix, in any case; otherwise ''."""
    lower = F.lower(name)
    suffix = F.substring_index(lower, ".", -1)
    known = lower.contains(".") & suffix.isin(*K.SUPPORTED_TYPES)
    return F.when(known, suffix).otherwise(F.lit(""))


def is_supported_type(kind: Column) -> Column:
    return F.coalesce(kind.isin(*K.SUPPORTED_TYPES), F.lit(False))


def session_title(content: Column) -> Column:
    """First 20 characters, with dots if there are more."""
    more = F.when(F.length(content) > K.TITLE_LENGTH, K.TITLE_MORE).otherwise("")
    return F.concat(F.substring(content, 1, K.TITLE_LENGTH), more)


def display_date(moment: Column) -> Column:
    """Date part without leading zeros; '' for null."""
    return F.coalesce(F.date_format(moment, "yyyy/M/d"), F.lit(""))


def chunk_key(document_id: Column, chunk_index: Column) -> Column:
    """Identifier of a chunk: ``<document>_<position>``."""
    return F.concat_ws("_", document_id.cast("string"), chunk_index.cast("string"))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(K.UUID_PATTERN), F.lit(False))


def stable_id(*parts: Column) -> Column:
    """Id derived from a natural key, equal on every run of a task."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)
