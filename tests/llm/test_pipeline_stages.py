"""The pipeline of the corpus: what each stage does to planted documents."""

import corpus_pipeline
import pytest

from corpusflow.llm import packing
from corpusflow.session import work_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "A passage of more than eight words that stands in two of the documents here."


def prose(n):
    return "\n".join(f"Document {n} says in sentence {i} that number {n * 31 + i * 17} follows {i * n + 5}." for i in range(9))


@pytest.fixture(scope="module")
def steps(spark):
    rows = [(1, prose(1), "en", "a", 1), (2, prose(2) + "\n" + PASSAGE, "en", "a", 1), (3, prose(3) + "\n" + PASSAGE, "en", "b", 1),
            (4, prose(1), "en", "b", 1), (5, "Home | News | Sport | More\n" * 20, "en", "b", 1), (6, None, None, None, None),
            (7, prose(7), "de", None, 1)]
    docs, out = spark.createDataFrame(rows, SCHEMA), []
    for _, stage in corpus_pipeline.STAGES:
        path = work_path(spark, "stage")
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(steps):
    cleaned, lines, near, mixed, packed = steps
    assert all(d.columns == [c.split()[0] for c in SCHEMA.split(", ")] for d in steps[:-1])
    assert sorted(r.doc_id for r in cleaned.collect()) == [1, 2, 3, 4, 7]
    after = {r.doc_id: r.text for r in lines.collect()}
    assert after == {1: prose(1), 2: prose(2) + "\n" + PASSAGE, 3: prose(3), 7: prose(7)}
    assert sorted(r.doc_id for r in near.collect()) == [1, 2, 3, 7]
    assert {r.doc_id for r in mixed.collect()} <= {1, 2, 3, 7}
    assert packed.count() >= mixed.count() and packed.filter(f"length > {packing.CAPACITY}").count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "sequence_id" in got.columns


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
