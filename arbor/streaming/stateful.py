"""Keyed state machines over streams: session registry, journal folds, change suppression.

Each takes a stream and gives a stream of changes; `run_changes` writes what each batch emits to a folder of its own, so a batch that comes again
after a failure writes the same. The state of a key is a few values (or n ids), kept by Spark's state store in the checkpoint.
What is emitted in all does not depend on how the input is cut into batches; rows of one key in one batch are put in order first.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that arbitrary state needs, for streams that start here; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_changes(changes: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Takes all that is available now and returns all changes emitted so far, with the batch of each."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    spark, schema = changes.sparkSession, changes.schema
    with _state_store(spark):
        q = changes.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{fields}, batch long").parquet(f"{path}/changes")


def latest(changes: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The last change of every key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return changes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "version", "batch")


_Answer = Row("session_id", "seq", "kind", "at_us", "found", "document_id", "turn")


class _Sessions(StatefulProcessor):
    """create, get and update of a session that ends `ttl` microseconds after its last access."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "document_id long, turn long, last long")

    def _expired(self, key, last: int) -> Row:
        return _Answer(key[0], None, "expired", last + self.ttl, True, None, None)

    def _timer(self, last: int) -> int:
        return (last + self.ttl) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """A key's timer is set once a batch, for its last access: state and timers are asked for over a socket, so not for each row."""
        have = self.state.get()  # None if there is none
        timed = self._timer(have[2]) if have else None
        for r in sorted(rows, key=lambda r: (r.at_us, r.seq)):
            at = r.at_us
            if have and at - have[2] > self.ttl:
                yield self._expired(key, have[2])
                have = None
            if r.kind == "create":
                have = (r.document_id, 1, at)
            elif have:
                have = (have[0], have[1] + (r.kind == "update"), at)
            yield _Answer(key[0], r.seq, r.kind, at, have is not None, have[0] if have else None, have[1] if have else None)
        now = self._timer(have[2]) if have else None
        if timed != now:
            if timed is not None:
                self.handle.deleteTimer(timed)
            if now is not None:
                self.handle.registerTimer(now)
        if have:
            self.state.update(have)
        elif timed is not None:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            last = self.state.get()[2]
            if self._timer(last) <= expiredTimerInfo.getExpiryTimeInMs():
                self.handle.deleteTimer(self._timer(last))
                self.state.clear()
                yield self._expired(key, last)

    def close(self) -> None:
        pass


def session_registry(requests: DataFrame, ttl: str = "30 minutes", late: str = "1 minute") -> DataFrame:
    """Answers of a session registry: session_id, seq, kind, at_us, found, document_id, turn, and one row of kind `expired` for each session that ends.

    requests: session_id, seq, kind (create, get, update), at, document_id. A create starts a session anew with turn 1; get and update find it and
    refresh its time, update counts a turn; on a session that is not there they find nothing. A session ends when more than `ttl` have passed since its last access: a
    later request tells, or a timer once the watermark (`late` behind the latest request) is past. Requests older than the watermark are dropped.
    """
    n, unit = ttl.split()
    us = int(datetime.timedelta(**{unit: float(n)}).total_seconds() * 1_000_000)
    r = requests.select("session_id", "seq", "kind", F.col("at").cast("timestamp").alias("at"), "document_id").withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    return r.groupBy("session_id").transformWithState(_Sessions(us), "session_id long, seq long, kind string, at_us long, found boolean, document_id long, turn long", "append", "EventTime")


class _Runs(StatefulProcessor):
    """The history of an append: what `append_history` keeps, emitted when it is finished and whenever that changes."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("run", "first_ts long, first_id long, last_ts long, last_id long, last string, started long, ended long, version long, shown boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self.state.get()
        s = list(s) if s else None
        before = self._row(key, s) if s else None
        for r in rows:
            if r.event not in ("append_started", "append_completed", "append_failed"):
                continue
            at = (r.at_us, r.event_id)
            s = s or [*at, *at, r.event, None, None, 0, False]
            if at < (s[0], s[1]):
                s[0], s[1] = at
            if at >= (s[2], s[3]):
                s[2], s[3], s[4] = *at, r.event
            k = 5 if r.event == "append_started" else 6
            s[k] = r.at_us if s[k] is None else max(s[k], r.at_us)
        if s is None:
            return
        now = self._row(key, s)
        if now != before and (now["finished"] or s[8]):
            s[7], s[8] = s[7] + 1, True
            yield Row(**now, version=s[7])
        self.state.update(tuple(s))

    @staticmethod
    def _row(key, s) -> dict:
        status = {"append_completed": "completed", "append_failed": "failed"}.get(s[4])
        return {"append_id": key[0], "first_seen": s[1], "status": status, "started_us": s[5], "ended_us": s[6], "finished": status is not None}

    def close(self) -> None:
        pass


def run_history(journal: DataFrame) -> DataFrame:
    """Changes of the history of appends: append_id, first_seen, status, started_us, ended_us, finished, version.

    journal: append_id, event_id, ts, event. A row comes when a run ends, and again when an earlier or later record changes what was said; `finished` is false
    where a run that had ended starts anew. The last row of each key that is finished is the history.
    """
    j = journal.select("append_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event")
    return j.groupBy("append_id").transformWithState(_Runs(), "append_id long, first_seen long, status string, started_us long, ended_us long, finished boolean, version long", "append", "None")


class _Nodes(StatefulProcessor):
    """A node's first creation and last height and span."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("node", "created long, last_ts long, last_id long, height long, span_start long, span_end long, n long, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self.state.get()
        s = list(s) if s else None
        for r in rows:
            s = s or [r.at_us, r.at_us, r.event_id, r.height, r.span_start, r.span_end, 0, 0]
            s[0], s[6] = min(s[0], r.at_us), s[6] + 1
            if (r.at_us, r.event_id) >= (s[1], s[2]):
                s[1:6] = [r.at_us, r.event_id, r.height, r.span_start, r.span_end]
        s[7] += 1
        self.state.update(tuple(s))
        yield Row(node_id=key[0], created_us=s[0], height=s[3], span_start=s[4], span_end=s[5], n_commits=s[6], version=s[7])

    def close(self) -> None:
        pass


def node_fold(commits: DataFrame) -> DataFrame:
    """Changes of committed nodes, one a batch that touches a node: node_id, created_us, height, span_start, span_end, n_commits, version."""
    c = commits.select("node_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "height", "span_start", "span_end")
    return c.groupBy("node_id").transformWithState(_Nodes(), "node_id long, created_us long, height long, span_start long, span_end long, n_commits long, version long", "append", "None")


class _Totals(StatefulProcessor):
    """Emits a total when it differs from the one before."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("total", "total long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.state.get()
        before = last = before[0] if before else None
        for r in sorted(rows, key=lambda r: r.seq):
            if r.total != last:
                last = r.total
                yield Row(key=key[0], seq=r.seq, total=r.total, complete=r.total == 0)
        if last != before:
            self.state.update((last,))

    def close(self) -> None:
        pass


def progress_changes(polls: DataFrame) -> DataFrame:
    """Polls (key, seq, total) whose total differs from the poll before: key, seq, total, complete (nothing is left). Null totals are left out."""
    return polls.where("total is not null").select("key", "seq", "total").groupBy("key").transformWithState(_Totals(), "key long, seq long, total long, complete boolean", "append", "None")


class _LatestIds(StatefulProcessor):
    """Keeps the n latest ids and emits them when they change."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.state = handle.getListState("latest", "created long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        have = [tuple(x) for x in self.state.get()] if self.state.exists() else []
        for r in sorted(rows, key=lambda r: r.seq):
            new = sorted({*have, (r.created, r.id)}, reverse=True)[: self.n]
            if [x[1] for x in new] != [x[1] for x in have]:
                yield Row(key=key[0], seq=r.seq, ids=[x[1] for x in new])
            have = new
        self.state.put(have)

    def close(self) -> None:
        pass


def latest_changes(records: DataFrame, n: int) -> DataFrame:
    """The list of the n latest ids of each key whenever it changes: key, seq, ids. records: key, seq (order of arrival), created, id."""
    return records.select("key", "seq", "created", "id").groupBy("key").transformWithState(_LatestIds(n), "key long, seq long, ids array<long>", "append", "None")


def run_parts(spark: SparkSession, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """All changes that `make` gives of a stream that gets tables one after another, each as one batch of as many files as its tasks write."""
    for i, p in enumerate(parts):
        p.write.mode("append").parquet(f"{path}/in/part={i:05d}")
        changes = run_changes(make(spark.readStream.schema(p.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")), path)
    return changes


def stream_of(spark: SparkSession, parts: list[DataFrame], folder: str) -> DataFrame:
    """Tables as files of a stream, one a batch, in their order."""
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(f"{folder}/part={i:05d}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
