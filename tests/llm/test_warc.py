"""WARC archives: round trip, revisits, ranges."""

import hashlib

from corpusflow.llm import warc
from corpusflow.session import work_path

ROWS = [(1, "http://a/é x", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "same"), (9, "v", "same"), (7, "w", "same"),
        (None, "n", "same"), (None, None, "none has an id"), (None, "m", "none has an id"), (11, "r\r\nn", "a\r\n\r\nb"),
        (12, "t", "twice"), (12, "t", "twice"), (13, "long", "x" * 3_000_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows],
                                 "page_id long, url string, html string, file string, offset long, sha long")


def test_round_trip(spark):
    index = warc.write_archives(frame(spark, ROWS), work_path(spark, "warc"))
    got = warc.read_records(index, payloads=True).collect()
    key = lambda x: repr(x[:2])
    seen = sorted([(r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in got], key=key)
    kind = {2: ("revisit", 3), 4: ("revisit", 9), 7: ("revisit", 9)}
    expected = []
    for page, url, html in ROWS:
        how = ("revisit", 9) if page is None and html == "same" else kind.get(page, ("response", None))
        expected.append((page, url, len((html or "").encode()), *how))
    assert seen == sorted(expected, key=key)
    bodies = {r.payload_digest: r.payload for r in got if r.record_type == "response"}
    for r in got:
        assert r.payload_digest == warc.digest_of(bodies[r.payload_digest])
        assert r.record_type == "response" or r.payload == b""
    assert {warc.digest_of((h or "").encode()) for _, _, h in ROWS} == set(bodies)


def test_selected_records_and_bounds(spark):
    index = warc.write_archives(frame(spark, ROWS), work_path(spark, "warc"), least=5)
    assert {r.record_type for r in index.filter("page_id in (4, 7, 2)").collect()} == {"response"}
    got = warc.read_records(index.filter("page_id in (1, 11)"), payloads=True).collect()
    assert {r.page_id: r.payload.decode() for r in got} == {1: "<p>é</p>", 11: "a\r\n\r\nb"}


def test_ranges():
    assert warc.ranges([(0, 10), (10, 5), (20, 5), (1000, 5)], gap=10, span=100) == [(0, 25, [0, 1, 2]), (1000, 5, [3])]
    assert warc.ranges([(0, 60), (60, 60)], gap=10, span=100) == [(0, 60, [0]), (60, 60, [1])]
    assert warc.ranges([]) == []


def test_digest_is_base32_sha1():
    assert warc.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert len(hashlib.sha1(b"").digest()) == 20


def test_empty_table(spark):
    assert warc.read_records(warc.write_archives(frame(spark, []), work_path(spark, "warc"))).count() == 0
