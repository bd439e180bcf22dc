import json
import os
import random

import pytest

from arbor.sources import tail as T
from arbor.streaming.stateful import run_changes


def _line(i, event="a"):
    return json.dumps({"event": event, "i": i, "text": "é" * (i % 5)}, ensure_ascii=False) + "\n"


def _stream(spark, path, **options):
    spark.dataSource.register(T.JournalTail)
    r = spark.readStream.format("journal_tail").option("path", str(path))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def _ids(df):
    return sorted(json.loads(r.line)["i"] for r in df.collect())


def test_a_journal_that_grows_shrinks_and_has_an_unfinished_line(spark, tmp_path):
    log = tmp_path / "log"
    os.makedirs(log)
    stream, out = _stream(spark, log), str(tmp_path / "out")
    (log / "a.jsonl").write_text("".join(_line(i) for i in range(20)) + '{"event": "a", "i": 20')
    (log / "_hidden").write_text(_line(99))
    assert _ids(run_changes(stream, out)) == list(range(20))
    with open(log / "a.jsonl", "a") as f:
        f.write(', "text": ""}\n' + "\n  \nbroken {\n[1]\n" + _line(21))
    (log / "b.jsonl").write_text(_line(30))
    got = run_changes(stream, out)
    assert _ids(got) == [*range(20), 20, 21, 30]
    batches = {r.batch for r in got.collect()}
    run_changes(stream, out)
    assert {r.batch for r in got.collect()} == batches  # nothing new, nothing read
    (log / "a.jsonl").write_text(_line(50))
    assert _ids(run_changes(stream, out)) == [*range(20), 20, 21, 30, 50]


def test_a_batch_reads_what_was_added(tmp_path):
    log = tmp_path / "log"
    os.makedirs(log)
    (log / "a").write_text("".join(_line(i) for i in range(1000)))
    first = T.whole_lines(str(log))
    with open(log / "a", "a") as f:
        f.write(_line(7) + _line(8) + "half a line")
    second = T.whole_lines(str(log))
    new = T.ranges(first, second, 64 << 20)
    assert sum(r.stop - r.start for r in new) == len(_line(7).encode()) + len(_line(8).encode())
    assert T.ranges(second, second) == [] and T.ranges({"a": 10}, {"a": 4})[0].start == 0


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_ranges_of_any_size_give_every_line_once(tmp_path, size):
    r, log = random.Random(size), tmp_path / "log"
    os.makedirs(log)
    text = "".join(_line(i) if r.random() < 0.8 else "\n" for i in range(200))
    (log / "a").write_text(text)
    want = [(k, x) for k, x in _offsets(text.encode()) if x]
    got = []
    for part in T.ranges({}, T.whole_lines(str(log)), size):
        with open(part.file, "rb") as f:
            got += [(k, x) for k, x in T.lines(f, part) if x]
    assert got == want


def _offsets(data):
    at = 0
    for x in data.split(b"\n")[:-1]:
        yield at, x
        at += len(x) + 1


def test_types_offsets_and_small_reads(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    os.makedirs(log)
    text = "".join(_line(i, "ab"[i % 2]) for i in range(50)) + '{"no": "event", "i": 60}\n{"event": 5, "i": 61}\n'
    (log / "a").write_text(text)
    spark.dataSource.register(T.JournalTail)
    read = lambda **o: _ids(spark.read.format("journal_tail").options(path=f"file://{log}", **o).load())
    assert read() == [*range(50), 60, 61] and read(types="b") == list(range(1, 50, 2)) and read(rangeBytes="13") == [*range(50), 60, 61]
    at = [k for k, _ in _offsets(text.encode())]
    assert read(offset=at[20]) == [*range(20, 50), 60, 61] and read(offset=at[20] + 1) == [*range(21, 50), 60, 61] and read(offset=10**9) == []
    monkeypatch.setattr(T, "READ_BYTES", 3)
    assert T.whole_lines(str(log)) == {str(log / "a"): len(text.encode())}


def test_no_folder_yet(spark, tmp_path):
    stream, out = _stream(spark, tmp_path / "log"), str(tmp_path / "out")
    os.makedirs(f"{out}/changes")
    assert run_changes(stream, out).collect() == []
    os.makedirs(tmp_path / "log")
    (tmp_path / "log" / "a").write_text(_line(1))
    assert _ids(run_changes(stream, out)) == [1]
