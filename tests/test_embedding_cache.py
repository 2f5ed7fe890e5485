"""One encoder call per distinct content over all runs; failures are tried again and count for themselves."""

import pytest

from corpusflow.operators.embedding import embed, embed_cached
from corpusflow.session import work_path


def counting(path, broken=()):
    """An encoder that writes down each text it is given; [] for broken ones."""
    def factory():
        def encode(texts):
            with open(path, "a") as out:
                out.writelines(f"{t}\n" for t in texts.to_pylist())
            return [[] if t in broken else [float(len(t)), 1.0] for t in texts.to_pylist()]
        return encode
    return factory


def test_a_content_is_encoded_once(spark, tmp_path):
    store, log = work_path(spark, "vectors"), tmp_path / "log"
    rows = [(n, ["one", " one\n", "two words", None, "", "three"][n % 6]) for n in range(60)]
    df = spark.createDataFrame(rows, "n long, content string").repartition(5)
    first = {r.n: r.embedding for r in embed_cached(df, counting(log, {"three"}), store).collect()}
    assert first[0] == first[1] == [3.0, 1.0] and first[2] == [9.0, 1.0] and first[3] == [] and first[5] == []
    seen = sorted(log.read_text().split("\n"))
    assert seen.count("one") == 1 and seen.count("two words") == 1
    again = {r.n: r.embedding for r in embed_cached(df.withColumnRenamed("n", "n"), counting(log), store).collect()}
    assert again[5] == [5.0, 1.0] and {n: v for n, v in again.items() if n % 6 != 5} == {n: v for n, v in first.items() if n % 6 != 5}
    seen = sorted(log.read_text().split("\n"))
    assert seen.count("one") == 1 and seen.count("two words") == 1 and seen.count("three") == 2


def failing():
    def factory():
        def encode(texts):
            if any(t.startswith("bad") for t in texts.to_pylist()):
                raise ValueError("no")
            return [[1.0]] * len(texts)
        return encode
    return factory


@pytest.mark.parametrize("most, ends", [(3, True), (None, False)])
def test_an_outage_ends_the_job_only_if_asked_for(spark, most, ends):
    df = spark.createDataFrame([(n, f"bad {n}" if n else "good") for n in range(30)], "n long, content string").coalesce(1)
    out = embed(df, failing(), failures_in_a_row=most)
    if ends:
        with pytest.raises(Exception, match="failed on"):
            out.collect()
    else:
        assert {r.n: r.embedding for r in out.collect()} == {n: [] if n else [1.0] for n in range(30)}
