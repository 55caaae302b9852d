"""Discovery waves, the cache and run logs as streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from citelode import commands
from citelode.operators import dedup
from citelode.sources import run_log
from citelode.streaming import wave
from tests.test_matching import odd_rows
from tests.test_operators import BASE, found


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, wave.ROCKS)
    yield spark
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def put(folder, name, rows):
    """A file of events that appears whole."""
    part = folder / f".{name}"
    part.write_text("".join(json.dumps({**BASE, "title": None, "url": "", **r}) + "\n" for r in rows))
    part.rename(folder / f"{name}.json")


def started(spark, folder, state, name, max_total, limits):
    events = spark.readStream.schema(wave.EVENTS).json(str(folder))
    out = wave.wave_stream(events, max_total, limits)
    return out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(state)).outputMode("append").trigger(processingTime="300 milliseconds").start()


def until(spark, name, condition, seconds=60):
    for _ in range(seconds * 4):
        rows = spark.table(name).collect()
        if condition(rows):
            return rows
        time.sleep(0.25)
    raise AssertionError(spark.table(name).collect())


def arrived(spark, out, n, seconds=60):
    """What a query wrote, once ``n`` discoveries have their outcome."""
    for _ in range(seconds * 2):
        if list(out.glob("_spark_metadata/*")):
            rows = spark.read.schema(wave.OUTCOMES).parquet(str(out)).collect()
            if sum(r.arrival_seq is not None for r in rows) >= n:
                return rows
        time.sleep(0.5)
    raise AssertionError(n)


def test_a_timer_and_a_cancel_end_waves(rocks, tmp_path):
    spark, folder = rocks, tmp_path / "events"
    folder.mkdir()
    put(folder, "a", [{"run_id": r, "event": "start", "arrival_seq": 0} for r in (1, 2)] + [{"run_id": r, "event": "found", "arrival_seq": 1, "title": "t", "url": "u1"} for r in (1, 2)])
    query = started(spark, folder, tmp_path / "state", "timed", 10, (6000, 60000))
    try:
        until(spark, "timed", lambda rows: len(rows) >= 2)
        commands.cancel_run(str(folder), 2)
        rows = until(spark, "timed", lambda rows: {r.outcome for r in rows} >= {"cancelled", "deadline"})
        ends = {r.run_id: (r.outcome, r.total) for r in rows if r.arrival_seq is None}
        assert ends == {1: ("deadline", 1), 2: ("cancelled", 1)}
        # what comes later is late; a second wave goes on with what is known, but not after a cancel
        put(folder, "b", [{"run_id": r, "event": e, "arrival_seq": s, "title": "t", "url": u, "tasks": 1} for r in (1, 2) for s, (e, u) in enumerate([("found", "u2"), ("start", ""), ("found", "u1"), ("found", "u3"), ("done", "")], 10)])
        rows = until(spark, "timed", lambda rows: sum(r.outcome in ("drained", "skipped") for r in rows) >= 2)
        later = {(r.run_id, r.arrival_seq): (r.outcome, r.insert_idx) for r in rows if r.arrival_seq and r.arrival_seq >= 10}
        assert later[1, 10] == ("late", None) and later[1, 12] == ("merged", 0) and later[1, 13] == ("new", 1)
        assert all(later[2, s] == ("late", None) for s in (10, 12, 13))
        assert {(r.run_id, r.wave, r.outcome) for r in rows if r.arrival_seq is None} == {(1, 1, "deadline"), (2, 1, "cancelled"), (1, 2, "drained"), (2, 2, "skipped")}
    finally:
        query.stop()


def test_waves_equal_the_fold_over_restarts(rocks, tmp_path):
    """Three starts on one checkpoint, a batch each: outcomes are those of the fold, full runs end."""
    spark, folder, out = rocks, tmp_path / "events", tmp_path / "out"
    folder.mkdir()
    rows = [r for r in odd_rows(9, 6, 60) if r["run_id"]]
    rows.sort(key=lambda r: r["arrival_seq"])
    third = len(rows) // 3 + 1
    # a run's rows arrive in order, over several batches
    for i in range(3):
        put(folder, f"part{i}", [{"event": "found", **r} for r in rows[i * third : (i + 1) * third]])
        events = spark.readStream.schema(wave.EVENTS).json(str(folder))
        query = wave.wave_stream(events, 9, (600000, 600000)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start(str(out))
        try:
            got = arrived(spark, out, len(rows[: (i + 1) * third]))
        finally:
            query.stop()
    docs = {}
    for r in got:
        if r.outcome in ("new", "merged"):
            docs.setdefault((r.run_id, r.insert_idx), []).append(r.arrival_seq)
    want = {(r.run_id, r.insert_idx): sorted(x.rank for x in r.source_ranks) for r in dedup.resolve(found(spark, *rows), 9).collect()}
    assert {k: sorted(v) for k, v in docs.items()} == want
    full = {run for run, i in want if i == 8}
    assert {r.run_id for r in got if r.outcome == "full"} == full and full
    assert sum(r.outcome == "capped" for r in got) == len(rows) - sum(map(len, want.values()))


def test_deadlines():
    assert [wave.deadlines(n) for n in (0, 75, 500, 1500, 4000, 9000)] == [(15000, 12000), (16000, 13000), (27000, 22000), (52000, 42000), (60000, 45000), (60000, 45000)]


def test_cached_answers_are_forgotten(rocks, tmp_path):
    spark, folder = rocks, tmp_path / "rows"
    folder.mkdir()
    ask = lambda name, rows: ((folder / f".{name}").write_text("".join(json.dumps(dict(zip(("key", "seq", "value"), r, strict=True))) + "\n" for r in rows)), (folder / f".{name}").rename(folder / f"{name}.json"))
    ask("a", [("k", 1, None), ("k", 2, "v"), ("k", 3, None), ("other", 1, None)])
    rows = spark.readStream.schema("key string, seq long, value string").json(str(folder))
    query = wave.cached_stream(rows, 4000).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
    try:
        got = until(spark, "kept", lambda rows: len(rows) == 3)
        assert {(r.key, r.seq): r.value for r in got} == {("k", 1): None, ("k", 3): "v", ("other", 1): None}
        time.sleep(5)
        ask("b", [("k", 4, None)])
        got = until(spark, "kept", lambda rows: len(rows) == 4)
        assert {(r.key, r.seq): r.value for r in got}["k", 4] is None
    finally:
        query.stop()


# run logs


def entry(i):
    return json.dumps({"ts": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "event": {"SourceHit": {"source": "a" * (i % 50), "count": i}}}) + "\n"


def test_log_stream_goes_on_after_restarts_and_within_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run_log, "LOOK", 64)
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()
    a, b = log / "a.jsonl", log / "b.jsonl"

    def run():
        lines = run_log.stream(spark, str(log))
        lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(out)).awaitTermination()
        return sorted(r.event.SourceHit["count"] for r in spark.read.schema(lines.schema).parquet(str(out)).collect())

    a.write_text("".join(entry(i) for i in range(100)) + entry(100)[:30])
    assert run() == list(range(100))
    with a.open("a") as f:
        f.write(entry(100)[30:] + "broken\n" + entry(101))
    b.write_text(entry(102))
    assert run() == list(range(103))
    assert run() == list(range(103))


def test_spans_part_at_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(run_log, "LOOK", 50)
    monkeypatch.setattr(run_log, "SPAN", 300)
    a = tmp_path / "a.jsonl"
    text = "".join(entry(i) for i in range(60)) + "é\n" + "last without newline"
    a.write_text(text)
    reader = run_log.LogReader(str(a), None)
    end = reader.latestOffset()
    assert end == {str(a): len(text.encode()) - len("last without newline")}
    spans = reader.partitions(reader.initialOffset(), end)
    assert len(spans) > 5 and [s.end for s in spans[:-1]] == [s.start for s in spans[1:]]
    rows = [r for s in spans for r in reader.read(s)]
    assert [r[2] for r in rows] == text.split("\n")[:-1]
    assert all(text.encode()[at:].startswith(line.encode()) for _, at, line in rows)
    assert run_log.LogReader(str(tmp_path / "none"), None).latestOffset() == {}
    folder = tmp_path / "parts"
    folder.mkdir()
    for name in ("part-0.json", ".part-1.json", "_part.json", "note.txt", "b.jsonl"):
        (folder / name).write_text("x\n")
    assert sorted(p.rsplit("/", 1)[1] for p in run_log.LogReader(str(folder), None).latestOffset()) == ["b.jsonl", "part-0.json"]


def test_tail_reads_a_bounded_window(spark, tmp_path):
    assert [run_log.tail_bytes(n) for n in (1, 100, 10**6)] == [65536, 204800, 4194304]
    a = tmp_path / "a.jsonl"
    a.write_text("".join(entry(i) for i in range(3000)) + "broken\n")
    assert a.stat().st_size > 3 * 65536
    assert [r.event.SourceHit["count"] for r in run_log.tail(spark, str(a), 3).collect()] == [2997, 2998, 2999]
    reader = run_log.LogReader(str(a), run_log.tail_bytes(3))
    begin = reader.initialOffset()[str(a)]
    assert a.stat().st_size - 65536 <= begin < a.stat().st_size - 65000
    assert run_log.tail(spark, str(tmp_path / "none"), 3).count() == 0
    assert run_log.entries(spark.createDataFrame([("p", 0, "{}")], "path string, at long, line string")).where(F.col("ts").isNull()).count() == 0
