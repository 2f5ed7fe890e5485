"""Keyed streaming jobs: order of late events, refused moves, stuck stages, restarts, retractions."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusflow.streaming import stateful

START = dt.datetime(2024, 1, 1)
EVENT = "document_id long, event_id long, ts timestamp, status string"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def feed(spark, folder, batches, schema):
    """One run of a job per batch of rows, all over the same source and checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        yield spark.readStream.schema(schema).parquet(folder)


def machine(spark, tmp, batches, **options):
    for stream in feed(spark, f"{tmp}/in", batches, EVENT):
        stateful.follow_machine(stream, f"{tmp}/out", f"{tmp}/checkpoint", **options).awaitTermination()
    return {r.document_id: r for r in stateful.machine_status(spark, f"{tmp}/out").collect()}


def walked(events, until, limit):
    """The machine by a loop."""
    status, since, accepted, refused, stages, stuck = None, None, 0, 0, 0, False

    def check(now):
        nonlocal stages, stuck
        if status not in (None, "FAILED", "COMPLETED") and not stuck and (now - since).total_seconds() > limit:
            stages, stuck = stages + 1, True
    for ts, _, after in sorted(events):
        if ts >= until:
            continue
        check(ts)
        if stateful.allowed(status, after):
            status, since, accepted, stuck = after, ts, accepted + 1, False
        else:
            refused += 1
    check(until)
    return status, accepted, refused, stages, stuck


def test_moves():
    assert stateful.allowed(None, "UPLOADING") and not stateful.allowed(None, "PARSING")
    assert stateful.allowed("UPLOADING", "CHUNKING") and not stateful.allowed("CHUNKING", "PARSING")
    assert stateful.allowed("PARSING", "FAILED") and not stateful.allowed("COMPLETED", "FAILED")
    assert stateful.allowed("FAILED", "UPLOADING") and not stateful.allowed("PARSING", "UPLOADING")
    assert not stateful.allowed("PARSING", "unknown")


@pytest.mark.parametrize("compact", [100, 2])
def test_machine_over_restarts_equals_a_loop(spark, tmp_path, compact):
    rng = random.Random(compact)
    kinds = [*stateful.STAGES, "FAILED"]
    events = [(rng.randrange(6), n, at(n * 3), rng.choice(kinds)) for n in range(200)]
    # Within a batch any order; over batches up to an hour late.
    batches = [events[k * 50:(k + 1) * 50] for k in range(4)]
    batches[0], batches[1] = batches[0][:-3], batches[1] + batches[0][-3:]
    for batch in batches:
        rng.shuffle(batch)
    batches.append([(99, 999, at(5000), "UPLOADING"), (None, 1000, at(1), "UPLOADING"), (5, 1001, None, "PARSING")])
    got = machine(spark, tmp_path, batches, delay="4 hours", stuck_after=1800, compact=compact)
    until = at(5000 - 240)
    assert set(got) == {d for d, *_ in events}
    for document, r in got.items():
        expected = walked([(ts, n, s) for d, n, ts, s in events if d == document], until, 1800)
        assert (r.status, r.accepted, r.refused, r.stuck_stages, r.stuck) == expected


def test_a_stuck_document_is_marked_without_new_events(spark, tmp_path):
    got = machine(spark, tmp_path, [[(1, 1, at(0), "UPLOADING"), (1, 2, at(1), "PARSING")], [(2, 3, at(300), "UPLOADING")]],
                  delay="1 minute", stuck_after=3600)
    assert got[1].stuck and got[1].stuck_stages == 1 and got[1].status == "PARSING"


def test_nothing_before_the_first_batch(spark, tmp_path):
    assert stateful.machine_status(spark, f"{tmp_path}/none").count() == 0
    assert stateful.closed_sessions(spark, f"{tmp_path}/none").count() == 0
    assert stateful.followed_counts(spark, f"{tmp_path}/none").count() == 0


def test_sessions_over_restarts(spark, tmp_path):
    schema = "id string, session_id string, created_at timestamp"
    first = [("a", "s", at(0)), ("b", "s", at(20)), ("c", "t", at(5)), (None, "s", at(21)), ("x", None, at(3))]
    second = [("b", "s", at(20)), ("d", "s", at(45)), ("e", "s", at(100))]
    third = [("f", "u", at(1000))]
    for stream in feed(spark, f"{tmp_path}/in", [first, second, third], schema):
        stateful.follow_sessions(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "30 minutes", "60 minutes").awaitTermination()
    got = {(r.session_id, r.first_at, r.last_at, r.messages) for r in stateful.closed_sessions(spark, f"{tmp_path}/out").collect()}
    assert got == {("s", at(0), at(45), 3), ("t", at(5), at(5), 1), ("s", at(100), at(100), 1)}


@pytest.mark.parametrize("compact", [100, 2])
def test_counts_by_increments(spark, tmp_path, compact):
    schema = "document_id long, seq long, knowledge_base_id string, status string, deleted boolean"
    rng = random.Random(compact)
    changes = [(rng.randrange(20), seq, rng.choice("ab"), rng.choice([*stateful.STAGES, "UPLOAD_FAILED", "FAILED", None]),
                rng.random() < .2) for seq in range(150)]
    shuffled = changes + changes[40:60]
    rng.shuffle(shuffled)
    batches = [shuffled[k::4] for k in range(4)]
    for stream in feed(spark, f"{tmp_path}/in", batches, schema):
        stateful.follow_counts(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", compact=compact).awaitTermination()
    last = {d: row for d, *row in sorted(changes, key=lambda c: c[1])}
    expected = Counter()
    for _, kb, status, deleted in last.values():
        if not deleted:
            expected[kb, "document_count"] += 1
            expected[kb, "completed"] += status == "COMPLETED"
            expected[kb, "processing"] += status in stateful.STAGES[:-1]
            expected[kb, "failed"] += "FAILED" in (status or "")
    rows = stateful.followed_counts(spark, f"{tmp_path}/out").collect()
    assert {(r.knowledge_base_id, c): r[c] for r in rows for c in r.asDict() if c != "knowledge_base_id" and r[c]} == +expected


def test_a_later_batch_costs_no_more_input(spark, tmp_path):
    """The job reads what is new, not what it has written before."""
    schema = "document_id long, seq long, knowledge_base_id string, status string, deleted boolean"
    read = []
    for stream in feed(spark, f"{tmp_path}/in", [[(n, k, "a", "PARSING", False) for n in range(30)] for k in range(4)], schema):
        query = stateful.follow_counts(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert len(set(read)) == 1
    assert stateful.followed_counts(spark, f"{tmp_path}/out").select(F.sum("processing")).first()[0] == 30


def test_answers_are_given_once_and_know_what_is_stored(spark, tmp_path):
    from corpusflow.operators.embedding import embed, hashing_encoder
    from corpusflow.streaming import jobs

    schema = "query_id long, knowledge_base_id string, message string"
    documents = spark.createDataFrame([(1, "a", "COMPLETED")], "document_id long, knowledge_base_id string, status string")
    texts = {"now": [(1, "a", 0, "blue sky")]}

    def snapshot(asked):
        rows = spark.createDataFrame(texts["now"], "document_id long, knowledge_base_id string, chunk_index int, content string")
        return documents, embed(rows, hashing_encoder())

    for n, stream in enumerate(feed(spark, f"{tmp_path}/in", [[(1, "a", "sky"), (1, "a", "sky"), (None, "a", "sky")],
                                                               [(1, "a", "sky"), (2, "a", "sky"), (3, "b", "sky")]], schema)):
        texts["now"] = [(1, "a", 0, f"sky of day {n}")]
        jobs.answer_stream(stream, snapshot, hashing_encoder(), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = {r.query_id: r.answer for r in jobs.stream_answered(spark, f"{tmp_path}/out").collect()}
    assert got[1] == "sky of day 0" and got[2] == "sky of day 1" and set(got) == {1, 2, 3}


def test_documents_of_a_page_cost_one_state(spark, tmp_path):
    schema = "document_id long, seq long, knowledge_base_id string, status string, deleted boolean"
    updated = []
    for stream in feed(spark, f"{tmp_path}/in", [[(n, k, "ab"[k], "PARSING", n == 5 * k) for n in range(30)] for k in range(2)], schema):
        query = stateful.follow_counts(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", pages=2)
        query.awaitTermination()
        updated += [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert updated == [2, 2]
    rows = {r.knowledge_base_id: r.document_count for r in stateful.followed_counts(spark, f"{tmp_path}/out").collect()}
    assert rows == {"a": 0, "b": 29}


def test_a_table_of_several_files_is_a_stream(spark, tmp_path):
    """Also below a folder whose name looks like a pattern."""
    from corpusflow.plans import queries
    from corpusflow.sources import views

    folder = f"{tmp_path}/sf[1]"
    for name in (f"{folder}/conversations.parquet", f"{folder}/conversations.parquet.old"):
        spark.createDataFrame([(n, 0, "user", f"text {n}") for n in range(40)], views.SCHEMAS["conversations"]).repartition(4).write.parquet(name)
    assert sorted(r["id"] for r in queries.QUERIES["stream_history"](spark, folder).collect()) == sorted(f"{n}_0" for n in range(40))
