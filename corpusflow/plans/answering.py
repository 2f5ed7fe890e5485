"""Questions to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.operators import prompting, retrieval
from corpusflow.operators.generation import ModelFactory, first_chunk_model, generate
from corpusflow.session import local_if_short


def hits_with_content(documents: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = K.TOP_K,
                      metric: str = "cosine", scope: str = "kb", chosen: bool = False) -> DataFrame:
    hits = retrieval.retrieve(documents, chunks, questions, k, metric, scope, chosen)
    return retrieval.with_content(hits, chunks, questions, scope, chosen)


def answer_questions(documents: DataFrame, chunks: DataFrame, questions: DataFrame,
                     model: ModelFactory = first_chunk_model, k: int = K.TOP_K,
                     metric: str = "cosine", scope: str = "kb", chosen: bool = False) -> DataFrame:
    """Answer questions (query_id, knowledge_base_id, message, embedding).

    Gives query_id, message, answer, sources.  A question whose knowledge base
    has no completed document, or that finds nothing, gets the fixed answer; it
    is not given to the model.  ``chosen``: the chunks are those that
    ``retrieval.asked_chunks`` gives for these questions, so they are not chosen again.
    A short list of questions is computed once.
    """
    questions = local_if_short(questions)
    hits = hits_with_content(documents, chunks, questions, k, metric, scope, chosen)
    per_question = prompting.context_and_sources(hits)
    guarded = prompting.guard_answers(questions.drop("embedding"), documents)
    asked = guarded.join(per_question, "query_id", "left")
    ready = F.col("ready") & F.col("context").isNotNull()
    prompt = F.when(ready, prompting.prompt_text(F.col("context"), F.col("message")))
    replied = generate(asked.drop("answer").withColumn("prompt", prompt), model)
    answer = (F.when(F.col("prompt").isNull(), F.lit(K.ANSWER_NO_DOCUMENTS))
              .otherwise(prompting.classify_answer(F.col("answer"), F.col("error"))))
    return replied.select("query_id", "message", answer.alias("answer"), "sources")
