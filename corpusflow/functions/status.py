"""Status expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import constants as K


def _lookup(values: dict, key: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])
    return F.try_element_at(table, key)


def is_processing(status: Column) -> Column:
    return F.coalesce(status.isin(*K.IN_PROGRESS_STATUSES), F.lit(False))


def is_failed(status: Column) -> Column:
    return F.coalesce(status.contains("FAILED"), F.lit(False))


def label(status: Column) -> Column:
    """Label shown for a status; an unknown status is shown as it is."""
    return F.coalesce(_lookup(K.STATUS_LABELS, status), status)


def stage_progress(status: Column) -> Column:
    """Progress reached on entering a stage; null for failures."""
    return _lookup(K.STAGE_PROGRESS, status)


def embedding_progress(chunk_index: Column, chunk_count: Column) -> Column:
    """Progress after the chunk at ``chunk_index`` (from 0) of ``chunk_count``."""
    done = (chunk_index.cast("long") + 1) * 30
    share = F.floor(done / F.when(chunk_count > 0, chunk_count)).cast("int")
    return F.when(chunk_count == 0, F.lit(100)).otherwise(F.lit(70) + share)
