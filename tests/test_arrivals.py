"""Files taken in as a stream: listed by tasks, noted in a table, each once."""

import os
import time

import pyarrow as pa
import pytest

from corpusflow.operators.embedding import hashing_encoder
from corpusflow.sources import files
from corpusflow.streaming import jobs


def _put(folder, name, text="some words", age=0):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (1_700_000_000 - age,) * 2)


@pytest.fixture
def up(tmp_path):
    folder = tmp_path / "up loads"
    for name in ("top.txt", "k1/a b.txt", "k1/c%20d+e.txt", "k1/文.TXT", "k1/deep/er/f.txt", "k2/g.pdf", "k2/h.doc", "k2/_i.txt",
                 "k2/.j.txt", "k2/l.txt._COPYING_", "_k3/m.txt", "_k=3/n.txt", "k4/_metadata.txt",
                 "_metadata4/o.txt"):
        _put(folder, name, name * 3)
    _put(folder, "k4/empty.txt", "")
    return folder


@pytest.mark.parametrize("pattern", [None, "*.txt", "*.{pdf,doc}", "?.txt", "[a-c]*", "none"])
def test_tasks_list_what_spark_lists(spark, up, pattern):
    assert files.can_list(spark, str(up))
    columns = ["knowledge_base_id", "file_name", "file_path", "modificationTime", "length", "content"]
    got = files.with_content(files.list_files(spark, str(up), pattern)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, files.read_files(spark, str(up), pattern).select(columns).collect()))
    assert bool(got) == (pattern != "none")


def test_what_cannot_be_listed_is_left_to_spark(spark, up):
    assert not any(files.can_list(spark, f) for f in (f"{up}/k*", f"{up}/missing", f"{up}/top.txt"))
    with pytest.raises((pa.ArrowException, OSError)):
        files._store("viewfs://store/up")


def test_names_of_files_are_not_held_by_the_source(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), tmp_path / "checkpoint"
    for n in range(60):
        _put(tmp_path / "up", f"k{n % 3}/{n}.txt")
    query = jobs.ingest(spark, str(tmp_path / "up"), out, str(checkpoint), hashing_encoder(16))
    query.awaitTermination()
    assert jobs.ingested_documents(spark, out).count() == 60 == sum(p["numInputRows"] for p in query.recentProgress)
    logged = [line for f in (checkpoint / "sources" / "0").iterdir() if f.name.isdigit() for line in f.read_text().splitlines()[1:]]
    assert 0 < len(logged) < 20 and not any("/up/" in line for line in logged)


def test_files_per_trigger_oldest_first(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for n in range(7):
        _put(tmp_path / "up", f"k{n % 2}/{n}.txt", age=n * 10)

    def batches():
        jobs.ingest(spark, str(tmp_path / "up"), out, checkpoint, hashing_encoder(16), files_per_trigger=3).awaitTermination()
        found = spark.read.parquet(f"{out}/documents").select("batch", "file_name").collect()
        return [sorted(r.file_name[0] for r in found if r.batch == b) for b in sorted({r.batch for r in found})]

    assert batches() == [["4", "5", "6"], ["1", "2", "3"], ["0"]]
    assert len(batches()) == 3
    # An old file that comes late is new all the same.
    _put(tmp_path / "up", "k0/9.txt", age=90 * 86400)
    assert batches()[3:] == [["9"]]


def test_files_are_looked_for_while_the_stream_runs(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    _put(tmp_path / "up", "k1/first.txt")
    query = jobs.ingest(spark, str(tmp_path / "up"), out, checkpoint, hashing_encoder(16), every="1 second")
    try:
        def names(count):
            for _ in range(120):
                time.sleep(0.5)
                if (tmp_path / "out" / "documents").exists():
                    found = sorted(r.file_name for r in jobs.ingested_documents(spark, out).collect())
                    if len(found) >= count:
                        return found
        assert names(1) == ["first.txt"]
        _put(tmp_path / "up", "k2/second.txt")
        assert names(2) == ["first.txt", "second.txt"]
    finally:
        query.stop()


def test_a_checkpoint_of_sparks_source_goes_on_with_it(spark, tmp_path, monkeypatch):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    _put(tmp_path / "up", "k1/first.txt")

    def run():
        query = jobs.ingest(spark, str(tmp_path / "up"), out, checkpoint, hashing_encoder(16))
        query.awaitTermination()
        return sorted(r.file_name for r in jobs.ingested_documents(spark, out).collect())

    with monkeypatch.context() as patched:
        patched.setattr(jobs, "can_list", lambda *_: False)
        assert run() == ["first.txt"]
    _put(tmp_path / "up", "k1/second.txt")
    assert run() == ["first.txt", "second.txt"]
