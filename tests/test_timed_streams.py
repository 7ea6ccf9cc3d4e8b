"""Timed machines: streams equal replays whatever the triggers, survive restarts, and leave no state of dead keys."""

import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.operators.ordered import Series
from emberframe.operators.silence import silence_reports
from emberframe.streaming import run, timed, watches

BEGIN = datetime(2024, 3, 1, tzinfo=UTC)
SECOND = 1_000_000
SCHEMA = "source string, ts timestamp, n long, kind string, event string, value double, u double, v double"


def sample_rows(seed=1, n=240):
    rng = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        source = rng.choice("abcc")
        at[source] = at.get(source, 0) + rng.choice([1, 2, 3, 5, 9, 30]) * 250
        kind = rng.choice(["start", "frame", "frame", "frame", "error"])
        event = rng.choice(["unlock", "space", "space", "sample", "sample", "sample"])
        rows.append((source, BEGIN + timedelta(milliseconds=at[source]), i, kind, event, rng.choice([0.0, 0.0, 1.0, 9.0]), rng.random(), rng.random()))
    return sorted(rows, key=lambda r: r[1])


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def outcome(df):
    return sorted(map(tuple, df.collect()), key=repr)


MACHINES = {
    "silence": watches.SilenceWatch(limit_us=2 * SECOND),
    "gaps": watches.GapWatch(period_us=SECOND, limit=4),
    "quota": watches.QuotaWatch(groups=3, quota=2, timeout_us=4 * SECOND),
    "attempts": watches.AttemptWatch(0.0, 1.0, SECOND, 5 * SECOND, 2 * SECOND, 4 * SECOND, 50),
}


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_triggers_and_order_do_not_matter(spark, tmp_path, name):
    rows = sample_rows()
    machine, idle = MACHINES[name], 20 * SECOND
    # late by less than the delay: each file is shuffled and neighbours overlap
    rng = random.Random(7)
    cuts = [0, 50, 110, 111, 180, 240]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    for left, right in zip(parts, parts[1:]):
        if left and right:
            left[-1], right[0] = right[0], left[-1]
    for part in parts:
        rng.shuffle(part)
        write(spark, tmp_path / "in", part)
    stream = run.open_table(spark, f"{tmp_path}/in/*.parquet", files_per_trigger=1)
    live = run.run_available(timed.timed_stream(stream, ["source"], "ts", machine, order=("n",), delay="60 seconds", idle_us=idle), spark)
    table = spark.read.parquet(str(tmp_path / "in"))
    until = timed.final_watermark(table, "ts", 60 * SECOND)
    want = outcome(timed.replay_timed(table, ["source"], "ts", machine, until, order=("n",), idle_us=idle))
    assert len(want) > 10 and outcome(live) == want


def test_a_restart_loses_and_repeats_nothing(spark, tmp_path):
    rows = sample_rows(3)
    machine, folder = MACHINES["silence"], str(tmp_path / "run")
    for a, b in ((0, 90), (90, 170), (170, 240)):
        write(spark, tmp_path / "in", rows[a:b])
        stream = run.open_table(spark, f"{tmp_path}/in/*.parquet")
        live = run.run_available(timed.timed_stream(stream, ["source"], "ts", machine, order=("n",)), spark, folder=folder)
    table = spark.read.parquet(str(tmp_path / "in"))
    want = outcome(timed.replay_timed(table, ["source"], "ts", machine, timed.final_watermark(table, "ts"), order=("n",)))
    assert outcome(live) == want and len(want) == len(set(want))


def test_a_quiet_source_is_reported_once_and_its_state_goes(spark, tmp_path):
    at = lambda s: BEGIN + timedelta(seconds=s)
    row = lambda source, s, kind="frame": (source, at(s), int(s), kind, "", 0.0, 0.0, 0.0)
    rows = [row("dead", 0), row("dead", 1), row("mute", 0, "start")] + [row("alive", s) for s in range(0, 60)]
    write(spark, tmp_path / "in", rows)
    stream = run.open_table(spark, f"{tmp_path}/in/*.parquet")
    machine, folder = watches.SilenceWatch(limit_us=3 * SECOND), str(tmp_path / "run")
    live = run.run_available(timed.timed_stream(stream, ["source"], "ts", machine, idle_us=30 * SECOND), spark, folder=folder)
    got = {(r.source, r.generation, r.report, r.at_us) for r in live.collect()}
    us = lambda s: int(at(s).timestamp()) * SECOND
    assert got == {("dead", 2, "thermal_stale", us(4) + 1), ("mute", 0, "thermal_unavailable", us(3) + 1)}
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(f"{folder}/progress")
    assert {r[0].source for r in kept.select("key").collect()} == {"alive"}


def test_the_wall_clock_reports_a_silent_source(spark, tmp_path):
    write(spark, tmp_path / "in", [("s", BEGIN, 1, "frame", "", 0.0, 0.0, 0.0)])
    stream = run.open_table(spark, f"{tmp_path}/in/*.parquet")
    machine = watches.SilenceWatch(limit_us=SECOND)
    reports = timed.live_stream(stream, ["source"], machine, order=("n",), ttl_ms=600_000)
    query = (
        reports.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(processingTime="300 milliseconds").start()
    )
    try:
        rows, deadline = [], time.time() + 60
        while not rows and time.time() < deadline:
            time.sleep(1)
            if (tmp_path / "out" / "_spark_metadata").exists():
                rows = spark.read.schema(reports.schema).parquet(str(tmp_path / "out")).collect()
    finally:
        query.stop()
    assert [(r.source, r.generation, r.report) for r in rows] == [("s", 1, "thermal_stale")]


def walked(machine, rows, until, idle=None):
    walk, out = timed.Walk(machine, idle), []
    for at, row in rows:
        out.extend(walk.take(at * SECOND, row))
    return out + list(walk.until(until * SECOND))


def test_set_based_reports_equal_the_walk(spark):
    df = spark.createDataFrame(sample_rows(5), SCHEMA).withColumn("t_us", F.unix_micros("ts"))
    machine, idle = MACHINES["silence"], 6 * SECOND
    until = timed.final_watermark(df, "ts")
    want = timed.replay_timed(df.drop("t_us"), ["source"], "ts", machine, until, order=("n",), idle_us=idle)
    series = Series(("source",), ("t_us", "n"))
    got = silence_reports(df, series, F.col("kind"), limit_us=2 * SECOND, idle_us=idle, until_us=until)
    assert outcome(got) == outcome(want)


def test_a_stream_is_given_up_once():
    out = walked(watches.GapWatch(SECOND, 3), [(0, {}), (2, {}), (9, {}), (30, {})], 60)
    assert [x[1:] for x in out] == [("stream_gap", 1), ("stream_gap", 1), ("stream_gap", 2), ("stream_gap", 3), ("stream_lost", 3)]


def test_quota_times_out_in_silence_and_blocks():
    rows = [(0, {"event": "unlock"}), (1, {"event": "space"}), (2, {"event": "sample", "u": 0.0, "v": 0.0})]
    out = walked(watches.QuotaWatch(stop_on_timeout=True), rows, 100)
    assert out[-1] == (11 * SECOND, "timeout", "blocked", None, False, 0, None, False) and len(out) == 4
    out = walked(watches.QuotaWatch(groups=1, quota=1), rows, 100)
    assert out[-1][1:3] == ("sample", "prepare_press_hard")
    edge = [*rows, (11, {"event": "sample", "u": 1.0, "v": 1.0})]
    assert [x[1:3] for x in walked(watches.QuotaWatch(), edge, 12)][-2:] == [("timeout", "rest"), ("sample", "rest")]


def test_a_silent_sensor_uses_up_all_attempts():
    machine = watches.AttemptWatch(0.0, 1.0, SECOND, 5 * SECOND, SECOND, 3 * SECOND, 2)
    out = walked(machine, [(0, {"value": 5.0})], 60)
    assert [x[1:] for x in out] == [
        (1, "action_prompt", None), (1, "invalid", "target_not_reached"), (2, "action_prompt", None), (2, "invalid", "target_not_reached"),
    ]
    assert [x[0] for x in out] == [0, 5 * SECOND + 1, 5 * SECOND + 1, 10 * SECOND + 2]
    out = walked(machine, [(0, {"value": 0.0}), (1, {"value": 0.5}), (2, {"value": None}), (3, {"value": 0.0})], 60)
    assert [x[2] for x in out] == ["action_prompt", "gated_hold_start", "step_complete"]


def test_soak_without_a_first_frame_ends_by_itself():
    tick = {"frame_id": None, "observed_us": None, "hand_valid": True, "fist": "open", "status": None, "available": None, "pinch": 0.0}
    out = walked(watches.SoakWatch(2 * SECOND), [(0, tick), (1, tick)], 60)
    assert [x[4] for x in out] == [None, None, "oak_no_first_frame_stall"] and out[-1][0] == 2 * SECOND + 1
    frame = {**tick, "frame_id": 1, "observed_us": SECOND, "status": "baseline", "available": True, "pinch": 0.06}
    out = walked(watches.SoakWatch(2 * SECOND), [(0, tick), (1, frame)], 60)
    assert [x[1] for x in out] == [None, "MOVING", None] and out[-1][4] == "oak_publication_stall"


def test_tracking_as_a_stream_equals_the_walk(spark):
    from emberframe.catalog import QUERIES

    root = "/root/testdata/sf0.001"
    batch, live = outcome(QUERIES["mask_tracking"](spark, root)), outcome(QUERIES["stream_mask_tracking"](spark, root))
    assert batch == live and len({r[4] for r in batch}) > 1


class _Counted:
    """A state handle that keeps one key's state and counts the calls, each a round trip in a real run."""

    def __init__(self):
        self.calls, self.timers, self.rows = 0, [], []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            match name:
                case "appendValue":
                    self.rows.append(args[0])
                case "appendList":
                    self.rows.extend(args[0])
                case "listTimers":
                    return iter(self.timers)
                case "registerTimer":
                    self.timers.append(args[0])

        return call

    def getValueState(self, *args):
        return self

    getListState = getValueState


def test_arrived_rows_cost_one_state_element():
    fields = T.StructType.fromDDL("at_us long, value double")
    machine = watches.SilenceWatch(limit_us=1)
    run = timed._Ordered(machine, T.StructType.fromDDL(f"source long, at_us long, {machine.output}"), ["at_us"], fields, None)
    handle = _Counted()
    run.init(handle)
    row = Row("source", "value", "at_us")
    assert list(run.handleInputRows((1,), iter([row(1, i / 2, 1000 * i + 1) for i in range(200)]), None)) == []
    assert handle.rows == [([(1000 * i + 1, i / 2) for i in range(200)],)]
    assert handle.timers == [1] and handle.calls == 3
