"""Streaming jobs that keep their state by key: status machine, sessions, counts of documents.

State lies in the state store and grows with the number of keys that are open,
not with the number of events; a micro-batch costs what it brings.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusflow.functions import status as st
from corpusflow.session import ship_package
from corpusflow.sources.tables import drop_folders, exists
from corpusflow.streaming.jobs import _batches, _newest, _start

#: Stages in the order a document passes them; FAILED may follow each but the last.
STAGES = ("UPLOADING", "PARSING", "CHUNKING", "EMBEDDING", "COMPLETED")
FAILED = "FAILED"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

MACHINE = ("document_id {key}, status string, since timestamp, accepted long, refused long, stuck_stages long, stuck boolean")


def _keyed_state(spark: SparkSession) -> None:
    """Settings that keyed state needs: a store that keeps several kinds of state, the package in the workers."""
    spark.conf.set(_STORE, _ROCKS)
    ship_package(spark)


def allowed(before: str | None, after: str) -> bool:
    """Whether a document may go from one status to another.

    Forward from stage to stage, leaving out some if need be; to FAILED from any
    stage that isn't the last; to UPLOADING at first and again once it has ended.
    """
    ended = before is None or before in (FAILED, STAGES[-1])
    if after == STAGES[0]:
        return ended
    if ended or (after != FAILED and after not in STAGES):
        return False
    return after == FAILED or STAGES.index(after) > STAGES.index(before)


class Machine(StatefulProcessor):
    """Moves of one document in the order of event time.

    Events wait until the watermark has passed them, so late ones are put in
    order; then each is taken or refused.  A timer for the earliest waiting
    event, or for the time at which the present stage has lasted too long, wakes
    the document up without new events.
    """

    def __init__(self, stuck_after: int):
        self.limit = stuck_after * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "status string, since long, accepted long, refused long, stuck_stages long, stuck boolean")
        self.waiting = handle.getListState("waiting", "ts long, event_id long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived = [(r["_us"], r["event_id"], r["status"]) for r in rows]
        if arrived:
            self.waiting.appendList(arrived)
            self._wake(min(ts for ts, *_ in arrived) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(self.waiting.get(), key=lambda e: (e[0], e[1]))
        due = [e for e in events if e[0] < now]
        status, since, accepted, refused, stages, stuck = self.current.get() if self.current.exists() else (None, 0, 0, 0, 0, False)

        def check(until: int) -> None:
            nonlocal stages, stuck
            if not stuck and status not in (None, FAILED, STAGES[-1]) and until - since > self.limit:
                stages, stuck = stages + 1, True

        for ts, _, after in due:
            check(ts)
            if allowed(status, after):
                status, since, accepted, stuck = after, ts, accepted + 1, False
            else:
                refused += 1
        check(now)
        self.current.update((status, since, accepted, refused, stages, stuck))
        later = events[len(due):]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self._wake(later[0][0] // 1000 + 1)
        if not stuck and status not in (None, FAILED, STAGES[-1]):
            self._wake((since + self.limit) // 1000 + 1)
        yield Row(document_id=key[0], status=status, since=since if status else None, accepted=accepted, refused=refused,
                  stuck_stages=stages, stuck=stuck)

    def _wake(self, at: int) -> None:
        """A timer; one for the same document at the same time is one."""
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def follow_machine(events: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", stuck_after: int = 1440 * 60,
                   every: str | None = None, compact: int = 100) -> StreamingQuery:
    """Status per document from a stream of document_id, event_id, ts, status, kept by a state machine.

    Illegal moves are refused and counted.  Events up to ``delay`` late are put
    in order, later ones are dropped.  A document that stays in a stage for more
    than ``stuck_after`` seconds of event time is marked, when the watermark
    says so.  Each micro-batch writes the documents that changed; read them with
    :func:`machine_status`.  Events without document_id or ts are left out.
    """
    _keyed_state(events.sparkSession)
    kind = dict(events.dtypes)["document_id"]
    timed = (events.where("document_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
             .withColumn("_us", F.unix_micros("ts")).withWatermark("ts", delay))
    moved = timed.groupBy("document_id").transformWithState(
        Machine(stuck_after), MACHINE.format(key=kind).replace("since timestamp", "since long"), "Update", "EventTime")
    moved = moved.withColumn("since", F.timestamp_micros("since"))

    def each(changed: DataFrame, batch: int) -> None:
        # A document is woken up by several timers of a batch; the last row says all.
        last = changed.groupBy("document_id").agg(F.max_by(F.struct(*changed.columns), F.struct(
            F.col("accepted") + F.col("refused"), "stuck_stages")).alias("r")).select("r.*")
        _write_last(last, out, batch, compact)

    return _start(moved, each, checkpoint, "update", every)


def _write_last(changed: DataFrame, out: str, batch: int, compact: int) -> None:
    """Write the changed rows of a micro-batch; every ``compact``-th one holds all documents and lets earlier ones go."""
    spark = changed.sparkSession
    full = batch - batch % compact
    if batch > full > 0:
        drop_folders(spark, out, "batch", lambda name: int(name) < full)
    elif batch == full > 0 and exists(spark, out):
        before = _batches(spark, out, changed.schema).where(F.col("batch") < batch)
        changed = _newest(before.unionByName(changed.withColumn("batch", F.lit(batch).cast("long"))), changed.columns)
    changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def machine_status(spark: SparkSession, out: str, key: str = "bigint") -> DataFrame:
    """document_id, status, since, accepted, refused, stuck_stages, stuck; no rows before the first micro-batch."""
    schema = spark.createDataFrame([], MACHINE.format(key=key)).schema
    if not exists(spark, out):
        return spark.createDataFrame([], schema)
    return _newest(_batches(spark, out, schema), schema.names)


def follow_sessions(messages: DataFrame, out: str, checkpoint: str, gap: str = "30 minutes", delay: str = "10 minutes",
                    every: str | None = None) -> StreamingQuery:
    """Sessions of a message stream: session_id, first_at, last_at, messages, once no message can join them any more.

    A message whose id was seen within ``delay`` is left out, so the ids that
    are remembered are bounded by it.  A pause longer than ``gap`` begins another
    session of the same session_id.  Messages that come later than ``delay`` are
    dropped; those without id, session or time too.
    """
    timed = (messages.where("id IS NOT NULL AND session_id IS NOT NULL AND created_at IS NOT NULL")
             .withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
             .select("id", "session_id", "created_at").dropDuplicatesWithinWatermark(["id"]))
    sessions = (timed.groupBy("session_id", F.session_window("created_at", gap))
                .agg(F.count("*").alias("messages"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
                .select("session_id", "first_at", "last_at", "messages"))

    def each(closed: DataFrame, batch: int) -> None:
        closed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return _start(sessions, each, checkpoint, every=every)


SESSION = "session_id string, first_at timestamp, last_at timestamp, messages long"


def closed_sessions(spark: SparkSession, out: str) -> DataFrame:
    """What :func:`follow_sessions` wrote; no rows before the first micro-batch."""
    schema = spark.createDataFrame([], SESSION).schema
    return _batches(spark, out, schema).drop("batch") if exists(spark, out) else spark.createDataFrame([], schema)


COUNT = "knowledge_base_id string, document_count long, completed long, processing long, failed long"
_COUNTED = ("document_count", "completed", "processing", "failed")


#: Pages the documents of the counts are kept in, by hash: a page is one value of the state store.
PAGES = 4096


class Counted(StatefulProcessor):
    """What the last changes of the documents of a page take from the counts and add to them.

    A call of the state store costs about a millisecond, whatever it carries, so
    documents share one: a page is read and written once per micro-batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "documents string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # document_id as text -> seq, knowledge_base_id, status, deleted
        known = json.loads(self.page.get()[0]) if self.page.exists() else {}
        before: dict[str, list | None] = {}
        for r in rows:
            name, seq = str(r["document_id"]), r["seq"]
            held = known.get(name)
            if held is None or seq > held[0]:
                before.setdefault(name, held)
                known[name] = [seq, r["knowledge_base_id"], r["status"], bool(r["deleted"])]
        if not before:
            return
        self.page.update((json.dumps(known, ensure_ascii=False, separators=(",", ":")),))
        sums: Counter = Counter()
        for name, held in before.items():
            for state, n in ((held, -1), (known[name], 1)):
                if state is not None and not state[3]:
                    sums[state[1], state[2]] += n
        for (base, status), n in sums.items():
            yield Row(knowledge_base_id=base, status=status, n=n)

    def close(self) -> None:
        pass


def follow_counts(changes: DataFrame, out: str, checkpoint: str, every: str | None = None, compact: int = 100,
                  pages: int = PAGES) -> StreamingQuery:
    """Documents per knowledge base, in all and by state, kept up by change rows.

    ``changes``: document_id, seq, knowledge_base_id, status, deleted, in any
    order; the row with the highest seq holds, and one that comes after a higher
    one or a second time changes nothing.  The state of a document takes back
    what it added before, so a micro-batch costs the pages that it changes: with
    very many documents ``pages`` may be raised, for a new checkpoint.  Read with
    :func:`followed_counts`.
    """
    _keyed_state(changes.sparkSession)
    page = F.pmod(F.xxhash64("document_id"), F.lit(pages)).alias("page")
    rows = changes.where("document_id IS NOT NULL").select("document_id", F.col("seq").cast("long").alias("seq"),
                                                           "knowledge_base_id", "status", "deleted", page)
    deltas = rows.groupBy("page").transformWithState(
        Counted(), "knowledge_base_id string, status string, n long", "Update", "None")

    def each(found: DataFrame, batch: int) -> None:
        spark = found.sparkSession
        own = found.groupBy("knowledge_base_id").agg(*_sums(F.col("status")))
        full = batch - batch % compact
        if batch > full > 0:
            drop_folders(spark, out, "batch", lambda name: int(name) < full)
        elif batch == full > 0 and exists(spark, out):
            earlier = _batches(spark, out, own.schema).where(F.col("batch") < batch).drop("batch")
            own = _added_up(earlier.unionByName(own))
        own.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return _start(deltas, each, checkpoint, "update", every)


def _sums(status) -> list:
    conditions = (F.lit(True), status == STAGES[-1], st.is_processing(status), st.is_failed(status))
    return [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long").alias(name) for c, name in zip(conditions, _COUNTED)]


def _added_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy("knowledge_base_id").agg(*[F.sum(c).cast("long").alias(c) for c in _COUNTED])


def followed_counts(spark: SparkSession, out: str) -> DataFrame:
    """knowledge_base_id, document_count, completed, processing, failed; knowledge bases that have held a document."""
    schema = spark.createDataFrame([], COUNT).schema
    if not exists(spark, out):
        return spark.createDataFrame([], schema)
    return _added_up(_batches(spark, out, schema).drop("batch"))
