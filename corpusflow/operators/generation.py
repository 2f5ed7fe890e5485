"""Prompts to answers with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K

# A model maps one prompt to an answer and may raise.  The factory is called
# once per task.
Model = Callable[[str], str | None]
ModelFactory = Callable[[], Model]


def first_chunk_model() -> Model:
    """Deterministic stand-in for a language model: repeats the best chunk."""
    opening = K.CONTEXT_ITEM_OPEN + "1" + K.CONTEXT_ITEM_CLOSE
    following = K.CONTEXT_ITEM_END + K.CONTEXT_ITEM_OPEN
    end = K.CONTEXT_ITEM_END + K.PROMPT_QUESTION

    def answer(prompt: str) -> str:
        _, _, rest = prompt.partition(opening)
        return rest.partition(end)[0].partition(following)[0]

    return answer


def generate(df: DataFrame, model: ModelFactory, prompt: str = "prompt") -> DataFrame:
    """Add ``answer`` and ``error``; a failing call is a row value, not a failed task.

    Only the prompt column travels to Python.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = model()
        for prompts in batches:
            rows = []
            for one in prompts:
                if one is None:
                    rows.append((None, None))
                    continue
                try:
                    rows.append((call(one), None))
                except Exception as failure:
                    rows.append((None, str(failure)))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    # The annotations choose the iterator form of the function.
    reply = F.pandas_udf(run, "answer string, error string").asNondeterministic()
    return (df.withColumn("_reply", reply(prompt))
            .withColumns({"answer": F.col("_reply.answer"), "error": F.col("_reply.error")})
            .drop("_reply"))
