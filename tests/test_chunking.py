import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from corpusflow.operators.chunking import chunk_documents, fixed_chunks, paragraph_chunks


def windows(text, size, overlap):
    return [text[start:start + size] for start in range(0, len(text), size - overlap)]


def split(spark, texts, *expressions):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *expressions).orderBy("i").collect()]


def test_lengths_around_the_borders(spark):
    texts = [None, "", " "] + ["ab\n中é"[n % 5] * n for n in (1, 449, 450, 451, 499, 500, 501, 949, 950, 951)]
    got = split(spark, texts, fixed_chunks(F.col("t")))
    assert [list(g[0]) for g in got] == [windows(t or "", 500, 50) for t in texts]


def test_letters(spark):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    got = split(spark, [letters], fixed_chunks(F.col("t"), 10, 3))
    assert list(got[0][0]) == ["ABCDEFGHIJ", "HIJKLMNOPQ", "OPQRSTUVWX", "VWXYZ"]


@pytest.mark.parametrize("size,overlap", [(0, 0), (10, 10), (10, 11), (5, -1)])
def test_endless_settings_are_refused(size, overlap):
    with pytest.raises(ValueError):
        fixed_chunks(F.lit("x"), size, overlap)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=hs.lists(hs.text(alphabet="ab \n\r\t中é😀", max_size=60), min_size=1, max_size=20),
       size=hs.integers(1, 12), share=hs.floats(0, 0.99))
def test_fixed_chunks_cover_the_text(spark, texts, size, share):
    overlap = int(size * share)
    step = size - overlap
    for text, (chunks,) in zip(texts, split(spark, texts, fixed_chunks(F.col("t"), size, overlap))):
        assert list(chunks) == windows(text, size, overlap)
        assert len(chunks) == math.ceil(len(text) / step)
        assert "".join(c[:step] for c in chunks) == text


def test_paragraphs(spark):
    text = "\n\n first \n\n\n\nsecond\nline\n\n \t \n\n" + "x" * 25 + "\n\nlast"
    got = split(spark, [text, "", None, "\n\n"], paragraph_chunks(F.col("t"), 20, 5))
    expected = ["first", "second\nline", *windows("x" * 25, 20, 5), "last"]
    assert [list(g[0]) for g in got] == [expected, [], [], []]


def test_strategy_names(spark):
    df = spark.createDataFrame([(1, "a\n\nb")], "document_id int, text string")
    content = lambda strategy: [r["content"] for r in chunk_documents(df, strategy).orderBy("chunk_index").collect()]
    assert content("PARAGRAPH") == ["a", "b"]
    assert content("fixed") == content("anything") == ["a\n\nb"]


def test_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "document_id int, text string")
    assert "Exchange" not in chunk_documents(df)._jdf.queryExecution().toString()
