import datetime
import glob
import os
import random

import pytest

from arbor.session import ensure_checkpoint_dir
from arbor.streaming import snapshots as N
from arbor.streaming.stateful import stream_of
from arbor.streaming.sync import RECORDS, sync_by_bucket


def _changes(snapshots):
    out, before = [], {}
    for k, now in enumerate(snapshots):
        out += [(k, i, "inserted", v) for i, v in now.items() if i not in before] + [(k, i, "changed", v) for i, v in now.items() if i in before and before[i] != v]
        out += [(k, i, "removed", None) for i in before if i not in now]
        before = now
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [[], [1], [2, 3, 6]])
def test_applying_all_changes_gives_the_last_snapshot(spark, tmp_path, cuts):
    ensure_checkpoint_dir(spark)
    r = random.Random(1)
    shots = [{i: r.choice(["a", "b", None]) for i in range(12) if r.random() < 0.6} for _ in range(5)] + [{}, {}, {3: "x"}]
    parts = []
    for a, b in zip([0, *cuts], [*cuts, len(shots)]):
        parts.append(spark.createDataFrame([(k, i, v) for k in range(a, b) for i, v in [*shots[k].items(), (None, None)]], N.SNAPSHOT))
    got = N.catalog_changes(stream_of(spark, parts, f"{tmp_path}/in"), str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == _changes(shots)
    last: dict = {}
    for c in sorted(got, key=lambda c: c.snapshot):
        last.pop(c.id, None) if c.kind == "removed" else last.__setitem__(c.id, c.value)
    assert last == shots[-1]


def test_a_batch_writes_the_buckets_of_its_sessions(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    source, path, t = str(tmp_path / "log"), str(tmp_path / "sync"), datetime.datetime(2024, 1, 1)
    rows = lambda ids, removed=False: spark.createDataFrame([(s, u, t + datetime.timedelta(seconds=u), removed) for s, u in ids], RECORDS)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/state/bucket=*/*.parquet")}
    put = lambda df, k: df.coalesce(1).write.mode("append").json(f"{source}/{k}")
    put(rows([(s, u) for s in range(40) for u in (1, 2, 3)]), 0)
    got = sync_by_bucket(spark, f"{source}/*", path, 16)
    assert got.count() == 120
    before = files()
    put(rows([(7, 4), (7, 2)]), 1)
    assert {(r.session, r.uuid) for r in sync_by_bucket(spark, f"{source}/*", path, 16).where("session = 7").collect()} == {(7, u) for u in (1, 2, 3, 4)}
    after = files()
    assert len({os.path.dirname(f) for f in set(before) ^ set(after)}) == 1 and sum(before[f] != after.get(f) for f in before) <= 1
    put(rows([(7, 2)], True), 2)
    assert {r.uuid for r in sync_by_bucket(spark, f"{source}/*", path, 16).where("session = 7").collect()} == {1, 3, 4}
    assert sync_by_bucket(spark, f"{source}/*", path, 16).count() == 120


@pytest.mark.parametrize("name", ["st13_st14_sync_stream", "st13_st14_sync_buckets"])
def test_an_append_of_many_files_is_one_batch(spark, tmp_path, monkeypatch, name):
    """The log and the index are read and written once an append, not once a file."""
    from arbor.plans import paths, registry

    monkeypatch.setattr(paths, "scratch", lambda s, n: str(tmp_path / n))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(key)
    assert len(glob.glob(f"{tmp_path}/log/*/*.json")) > 6 and len(glob.glob(f"{tmp_path}/sync/progress/commits/[0-9]*")) == 3
    assert len(got) == len({r.uuid for r in got}) > 500


def test_both_ways_to_sync_agree(spark, tmp_path):
    """Logs with records sent again, reverts, missing fields and late ones, some files a batch."""
    from arbor.streaming.sync import sync

    ensure_checkpoint_dir(spark)
    r, t = random.Random(8), datetime.datetime(2024, 1, 1)
    row = lambda: (r.choice([*range(6), None]), r.choice([*range(30), None]), r.choice([None] + [t + datetime.timedelta(seconds=r.randrange(40))] * 9), r.choice([None, False, False, True]))
    for k in range(4):
        spark.createDataFrame([row() for _ in range(60)], RECORDS).repartition(3).write.json(f"{tmp_path}/log/{k}")
        a, b = (sorted(map(tuple, f(spark, f"{tmp_path}/log/*", f"{tmp_path}/{f.__name__}", files=None).collect()), key=str) for f in (sync, sync_by_bucket))
        assert a == b and a
