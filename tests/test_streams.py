"""Streams that are stopped and started again between files."""

import datetime as dt
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as ev
from corpusloom.streaming import jobs

LOG = "run_id string, seq long, state string, ts timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def feed(spark, folder, schema, batches, run):
    """What ``run`` gives after each batch of rows has come as a file."""
    out = []
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        df.write.parquet(f"{folder}/in/{k}")
        out.append(run(jobs.folder_stream(spark, df.schema, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint"))
    return out


def moves(df):
    return sorted(((r["run_id"], r["seq"], r["before"], r["state"], r["is_valid"]) for r in df.collect()), key=str)


def transitions(spark, folder, batches, **kw):
    return moves(feed(spark, folder, LOG, batches, lambda s, out, cp: jobs.run_to_table(jobs.stream_transitions(s, **kw), out, cp))[-1])


CLOCK = [("clock", 1, "idle", at(10**6))]


def test_late_rows_meet_their_true_predecessors(spark, tmp_path):
    first = [("r", 1, "starting", at(0)), ("r", 3, "completed", at(20)), ("q", 1, "running", at(5))]
    rows = [*first, ("r", 2, "running", at(10)), ("r", 10, "idle", at(20))]
    got = transitions(spark, tmp_path, [first, rows[3:], CLOCK])
    want = moves(ev.validate_transitions(spark.createDataFrame(rows, LOG)))
    assert got == want and ("r", 3, "running", "completed", True) in got and ("r", 10, "completed", "idle", True) in got


def test_rows_wait_for_the_watermark_and_too_late_ones_are_dropped(spark, tmp_path):
    batches = [[("r", 1, "starting", at(0)), ("r", 2, "running", at(30))], [("q", 1, "starting", at(70))], [("r", 9, "failed", at(5)), ("r", 3, "failed", at(40))], CLOCK]
    steps = feed(spark, tmp_path, LOG, batches, lambda s, out, cp: {r["seq"] for r in jobs.run_to_table(jobs.stream_transitions(s, delay="1 hour"), out, cp).where("run_id = 'r'").collect()})
    assert steps == [set(), {1}, {1}, {1, 2, 3}]


def test_silent_runs_fail_also_between_rows_of_one_file(spark, tmp_path):
    batches = [[("r", 1, "starting", at(0)), ("r", 2, "running", at(30)), ("r", 3, "starting", at(500)), ("s", 1, "starting", at(0))], [("q", 1, "starting", at(2000))], CLOCK]
    got = transitions(spark, tmp_path, batches, timeout="1 hour", delay="1 minute")
    assert [m for m in got if m[0] == "r"] == sorted([("r", 1, "idle", "starting", True), ("r", 2, "starting", "running", True), ("r", None, "running", "failed", True), ("r", 3, "idle", "starting", True), ("r", None, "starting", "failed", True)], key=str)
    assert ("s", None, "starting", "failed", True) in got


def test_a_batch_of_a_run_is_one_entry_of_its_list():
    class Store:
        def __init__(self):
            self.entries, self.value, self.timers, self.calls = [], None, [], 0

        def getListState(self, name, schema):
            return ListState(self)

        def getValueState(self, name, schema):
            return ValueState(self)

        def registerTimer(self, ms):
            self.calls += 1
            self.timers.append(ms)

    class ListState:
        def __init__(self, store):
            self.store = store

        def appendValue(self, value):
            self.store.calls += 1
            self.store.entries.append(value)

        def get(self):
            self.store.calls += 1
            return iter(self.store.entries)

        def put(self, values):
            self.store.calls += 1
            self.store.entries = values

        def clear(self):
            self.put([])

    class ValueState:
        def __init__(self, store):
            self.store = store

        def get(self):
            self.store.calls += 1
            return self.store.value

        def update(self, value):
            self.store.calls += 1
            self.store.value = value

    class Watermark:
        def getCurrentWatermarkInMs(self):
            return 500

    store, row = Store(), Row("us", "seq", "state")
    runs = jobs._Moves({("idle", "a"), ("a", "a")}, "idle", 0)
    runs.init(store)
    for batch in (range(1, 1000, 2), range(0, 1000, 2)):
        assert list(runs.handleInputRows(("r",), iter([row(k * 1000, None if k == 3 else str(k), "a") for k in batch]), None)) == []
    assert len(store.entries) == 2 and store.calls == 4 and store.timers == [1, 0]
    got = list(runs.handleExpiredTimer(("r",), Watermark(), None))
    assert [r.seq for r in got] == [None if k == 3 else str(k) for k in range(501)] and [r.before for r in got[:2]] == ["idle", "a"]
    assert all(r.is_valid and r.run_id == "r" for r in got) and store.value == ("a", 500_000) and store.timers[-1] == 501
    assert len(store.entries) == 1 and store.calls <= 9


def test_known_documents_stay_known_after_a_restart(spark, tmp_path):
    batches = [[("one two",), ("three",)], [("one  two",), ("one two",), ("four",)], [("three",), ("five",)]]
    sizes = feed(spark, tmp_path, "text string", batches, lambda s, out, cp: jobs.run_to_table(jobs.stream_ingest(s), out, cp).count())
    assert sizes == [2, 4, 5]


EVENT = "seq long, id string, deleted boolean"


def test_alias_state_writes_only_what_a_batch_touches(spark, tmp_path):
    first = [(k, f"a{k % 200}", False) for k in range(400)]
    batches = [first, [(1000, "a7", True)], [(5, "a7", False), (1001, "new", False)]]
    got = feed(spark, tmp_path, EVENT, batches, lambda s, out, cp: {r["id"]: (r["seq"], r["deleted"]) for r in jobs.run_alias_state(s, out, cp, parts=16).collect()})
    assert len(got[0]) == 200 and got[1]["a7"] == (1000, True) and got[2]["a7"] == (1000, True) and got[2]["new"] == (1001, False) and len(got[2]) == 201
    written = [len([p for p in os.listdir(tmp_path / "out" / f"v={v}") if p.startswith("part=")]) for v in range(3)]
    assert written[0] == 15 and written[1] == 1 and written[2] <= 2  # one of the 16 is superseded twice and gone


def test_a_repeated_batch_and_a_broken_version_change_nothing(spark, tmp_path):
    run = lambda s, out, cp: {r["id"]: r["n"] for r in jobs.run_keyed(s, out, cp, "id", lambda rows: rows.groupBy("id").agg(F.sum("n").alias("n")), parts=2).collect()}
    got = feed(spark, tmp_path, "id string, n long", [[("a", 1), ("b", 2)], [("a", 10)]], run)
    assert got == [{"a": 1, "b": 2}, {"a": 11, "b": 2}]
    # the last batch was written, but its commit was lost with the driver: it runs again
    os.remove(tmp_path / "checkpoint" / "commits" / "1")
    for name in (".1.crc",):
        if os.path.exists(tmp_path / "checkpoint" / "commits" / name):
            os.remove(tmp_path / "checkpoint" / "commits" / name)
    schema = spark.createDataFrame([], "id string, n long").schema
    assert run(jobs.folder_stream(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint") == {"a": 11, "b": 2}
    # a version without Spark's mark of success is not read
    spark.createDataFrame([("a", 99, 0)], "id string, n long, part int").write.partitionBy("part").parquet(f"{tmp_path}/out/v=7")
    os.remove(tmp_path / "out" / "v=7" / "_SUCCESS")
    assert {r["id"]: r["n"] for r in jobs.keyed_state(spark, f"{tmp_path}/out", schema).collect()} == {"a": 11, "b": 2}


@pytest.mark.parametrize("window", [None, "1 hour"])
def test_result_summary_goes_on_after_a_restart(spark, tmp_path, window):
    schema = "mode string, score int, rt_ms long, recall double, ts timestamp"
    rows = [(m, s, 10 * k, 50.0, at(k * 7)) for k, (m, s) in enumerate([("a", 1), ("b", 0), ("a", -1), ("a", None), ("b", 1)] * 6)]
    batches = [rows[:10], rows[10:20], rows[20:], [("z", 1, 1, 1.0, at(10**6))]]
    run = lambda s, out, cp: jobs.run_to_table(jobs.stream_result_summary(s, window), out, cp) if window else jobs.run_latest(jobs.stream_result_summary(s), out, cp)
    got = feed(spark, tmp_path, schema, batches, run)[-1].where("mode <> 'z'")
    keys = [F.window("ts", window).alias("window"), "mode"] if window else ["mode"]
    want = spark.createDataFrame(rows, schema).where("score is not null").groupBy(*keys).agg(*ev.mode_aggregates())
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    if not window:
        assert len([v for v in os.listdir(tmp_path / "out") if v.startswith("v=")]) <= 2
