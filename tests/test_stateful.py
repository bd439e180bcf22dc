"""Streams of keyed state machines: any cut into batches gives the same changes, and a restart changes nothing."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from arbor.streaming import stateful as X

T0 = datetime.datetime(2024, 1, 1)


def _at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def _run(spark, rows, schema, cuts, make, path):
    parts = [spark.createDataFrame(rows[a:b], schema) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    return X.run_changes(make(X.stream_of(spark, parts, f"{path}/in")), path)


def registry(requests, ttl, late):
    """The registry as a plain program; sessions end lazily, or at the end once the watermark is past."""
    have, out = {}, []
    for s, seq, kind, at, doc in requests:
        if s in have and at - have[s][2] > ttl:
            out.append((s, None, "expired", have.pop(s)[2] + ttl, True, None, None))
        if kind == "create":
            have[s] = [doc, 1, at]
        elif s in have:
            have[s][1] += kind == "update"
            have[s][2] = at
        x = have.get(s)
        out.append((s, seq, kind, at, x is not None, x[0] if x else None, x[1] if x else None))
    end = max(r[3] for r in requests) - late
    out += [(s, None, "expired", x[2] + ttl, True, None, None) for s, x in have.items() if x[2] + ttl < end]
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [[], [40, 41, 90], [10, 100, 170]])
def test_session_registry(spark, tmp_path, cuts):
    r, t, rows = random.Random(3), 0, []
    for i in range(200):
        t += r.choice([0, 1, 3, 8])
        rows.append((r.randrange(12), i, r.choice(["create", "get", "update", "update"]), _at(t), r.randrange(50)))
    schema = "session_id long, seq long, kind string, at timestamp_ntz, document_id long"
    got = _run(spark, rows, schema, cuts, lambda s: X.session_registry(s, "60 seconds", "0 seconds" if not cuts else "20 seconds"), str(tmp_path)).drop("batch").collect()
    us = lambda x: int((x - T0).total_seconds() * 1_000_000) + 1_704_067_200_000_000
    want = registry([(s, i, k, us(at), d) for s, i, k, at, d in rows], 60_000_000, 20_000_000 if cuts else 0)
    assert sorted((tuple(x) for x in got), key=str) == want and any(x.kind == "expired" for x in got)


def test_sessions_end_by_timer_without_a_later_request(spark, tmp_path):
    rows = [(1, 0, "create", _at(0), 7), (2, 1, "create", _at(500), 8), (2, 2, "get", _at(1000), None)]
    got = _run(spark, rows, "session_id long, seq long, kind string, at timestamp_ntz, document_id long", [1, 2], lambda s: X.session_registry(s, "60 seconds", "1 seconds"), str(tmp_path)).collect()
    ends = {x.session_id: x.at_us for x in got if x.kind == "expired"}
    assert set(ends) == {1, 2} and [x.found for x in sorted(got, key=lambda x: (x.seq is None, x.seq or 0))][:3] == [True, True, False]


def _journal(seed):
    r = random.Random(seed)
    rows = [(r.randrange(15), i, _at(r.randrange(300)), r.choice(["append_started", "append_completed", "append_failed", "node_committed"])) for i in range(180)]
    return rows, "append_id long, event_id long, ts timestamp_ntz, event string"


@pytest.mark.parametrize("cuts", [[], [1, 60, 150], [90]])
def test_history_of_runs(spark, tmp_path, cuts):
    from arbor.operators.telemetry import append_history

    rows, schema = _journal(4)
    got = X.latest(_run(spark, rows, schema, cuts, X.run_history, str(tmp_path)), "append_id").where("finished")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c.replace("_at", "_us"))
    want = append_history(spark.createDataFrame(rows, schema)).select("append_id", "first_seen", "status", us("started_at"), us("ended_at"))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_run_that_starts_anew_leaves_the_history(spark, tmp_path):
    rows = [(1, 1, _at(0), "append_started"), (1, 2, _at(5), "append_completed"), (1, 3, _at(9), "append_started"), (2, 4, _at(1), "append_started")]
    changes = _run(spark, rows, "append_id long, event_id long, ts timestamp_ntz, event string", [2], X.run_history, str(tmp_path)).orderBy("version").collect()
    assert [(c.append_id, c.status, c.finished, c.version) for c in changes] == [(1, "completed", True, 1), (1, None, False, 2)]


@pytest.mark.parametrize("cuts", [[], [7, 100]])
def test_totals_and_lists_tell_changes_only(spark, tmp_path, cuts):
    r = random.Random(5)
    polls = [(r.randrange(3), i, r.choice([None, 0, 0, 4, 4, 9])) for i in range(150)]
    got = _run(spark, polls, "key long, seq long, total long", cuts, X.progress_changes, str(tmp_path / "a"))
    want, last = [], {}
    for k, i, t in polls:
        if t is not None and last.get(k, -1) != t:
            want.append((k, i, t, t == 0))
            last[k] = t
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(want)
    records = [(r.randrange(3), i, r.randrange(40), i) for i in range(150)]
    got = _run(spark, records, "key long, seq long, created long, id long", cuts, lambda s: X.latest_changes(s, 3), str(tmp_path / "b"))
    want, have = [], {}
    for k, i, c, x in records:
        new = sorted([*have.get(k, []), (c, x)], reverse=True)[:3]
        if new != have.get(k, []):
            want.append((k, i, [y for _, y in new]))
        have[k] = new
    assert sorted((x.key, x.seq, x.ids) for x in got.collect()) == sorted(want)


def test_a_restart_goes_on_from_its_checkpoint(spark, tmp_path):
    rows, schema = _journal(6)
    whole = {tuple(r) for r in X.latest(_run(spark, rows, schema, [60, 120], X.run_history, str(tmp_path / "whole")), "append_id").drop("version").collect()}
    path = str(tmp_path / "restarted")
    first = X.stream_of(spark, [spark.createDataFrame(rows[:60], schema)], f"{path}/in")
    n = X.run_changes(X.run_history(first), path).count()
    again = X.run_changes(X.run_history(first), path)
    assert again.count() == n  # nothing new, nothing told again
    X.stream_of(spark, [spark.createDataFrame(rows[60:120], schema)], f"{path}/in/b")
    more = X.stream_of(spark, [spark.createDataFrame(rows[120:], schema)], f"{path}/in/c").sparkSession.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    got = {tuple(r) for r in X.latest(X.run_changes(X.run_history(more), path), "append_id").drop("version").collect()}
    assert got == whole


def test_the_state_store_setting_comes_back(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    _run(spark, [(1, 1, 5)], "key long, seq long, total long", [], X.progress_changes, str(tmp_path))
    assert spark.conf.get(key, None) == before


def test_fold_in_update_mode_writes_touched_keys_only(spark, tmp_path):
    from arbor.streaming.journal import fold_stream
    from arbor.streaming.stateful import latest, run_changes, stream_of

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id")
    ids = [r.event_id for r in e.select("event_id").collect()]
    cut = ids[len(ids) * 3 // 4]
    parts = [e.where(f"event_id <= {cut}"), e.where(f"event_id > {cut} and user_id % 2 = 0"), e.where(f"event_id > {cut} and user_id % 2 = 1")]
    changes = run_changes(fold_stream(stream_of(spark, parts, str(tmp_path / "in"))), str(tmp_path / "out"), "update")
    got = sorted(tuple(r) for r in latest(changes, "append_id", "n").select("append_id", "n", "commits", "last_event").collect())
    assert got == sorted(tuple(r) for r in fold_stream(e).collect())
    touched = {r.batch: r.n for r in changes.groupBy("batch").count().withColumnRenamed("count", "n").collect()}
    assert len(touched) == 3 and touched[1] == parts[1].select("user_id").distinct().count() and touched[2] == parts[2].select("user_id").distinct().count()


def test_a_batch_sets_one_timer_a_session():
    """Timers and state are asked for once a batch, not once a row; a session that ended and began anew in a batch leaves one timer."""

    class Handle:
        def __init__(self):
            self.calls, self.value = [], None

        def getValueState(self, name, schema):
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.calls.append("update")
            self.value = v

        def clear(self):
            self.value = None

        def registerTimer(self, t):
            self.calls.append(("set", t))

        def deleteTimer(self, t):
            self.calls.append(("drop", t))

    from pyspark.sql import Row

    h, p = Handle(), X._Sessions(60_000_000)
    p.init(h)
    row = lambda seq, kind, s: Row(seq=seq, kind=kind, at_us=s * 1_000_000, document_id=seq)
    out = list(p.handleInputRows((1,), iter([row(i, "create" if i == 0 else "update", i) for i in range(50)]), None))
    assert [r.turn for r in out] == list(range(1, 51)) and h.calls == [("set", 109_001), "update"]
    out = list(p.handleInputRows((1,), iter([row(50, "get", 200), row(51, "create", 201), row(52, "get", 202)]), None))
    assert [(r.kind, r.found) for r in out] == [("expired", True), ("get", False), ("create", True), ("get", True)]
    assert h.calls[2:] == [("drop", 109_001), ("set", 262_001), "update"]
    out = list(p.handleInputRows((1,), iter([row(53, "get", 900)]), None))
    assert [(r.kind, r.found) for r in out] == [("expired", True), ("get", False)] and h.calls[5:] == [("drop", 262_001)] and h.value is None


def test_a_batch_is_written_by_many_tasks(spark, tmp_path):
    """A table of a stream has as many files as its tasks write, and all of them are one batch."""
    import glob

    ensured = spark.createDataFrame([(i % 7, i, i % 3) for i in range(200)], "key long, seq long, total long")
    parts = [ensured.where("seq < 90").repartition(5), ensured.where("seq >= 90").repartition(5)]
    got = X.run_parts(spark, parts, X.progress_changes, str(tmp_path))
    assert len(glob.glob(f"{tmp_path}/in/part=*/*.parquet")) == 10 and sorted(r.batch for r in got.select("batch").distinct().collect()) == [0, 1]
    assert got.count() == 200  # 7 and 3 share no divisor: every poll of a key differs from the one before
