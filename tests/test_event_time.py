"""Windows, latest samples, side tables and judged pairs of streams that come in several triggers, late rows included."""

import random
from collections import defaultdict
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from emberframe.streaming import machines, run, watches, windows

BEGIN = datetime(2024, 3, 1, tzinfo=UTC)
SCHEMA = "source string, ts timestamp, n long, value double"
SECOND = 1_000_000


def at(s):
    return BEGIN + timedelta(seconds=s)


def us(s):
    return int(at(s).timestamp()) * SECOND


def feed(spark, folder, *files, schema=SCHEMA):
    """A stream that takes one of ``files`` a trigger, in order."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return run.open_table(spark, f"{folder}/*.parquet", files_per_trigger=1)


def rows_of(*seconds, source="a"):
    return [(source, at(s), s, float(s)) for s in seconds]


def test_bins_close_once_and_late_rows_are_left_out(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", rows_of(1, 3, 12), rows_of(5, 25), rows_of(29), rows_of(2, 61))
    bins = windows.tumbling(stream, ["source"], "ts", "10 seconds", "10 seconds", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")])
    got = {(r.window.start.second, r.n, r.total) for r in run.run_available(bins, spark).collect()}
    # 5 is 7 s behind 12 and counts; 2 comes when the first bin is closed
    assert got == {(0, 3, 9.0), (10, 1, 12.0), (20, 2, 54.0)}


def test_sessions_grow_over_triggers(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", rows_of(0, 4), rows_of(8, 30), rows_of(33, 90))
    out = run.run_available(windows.sessions(stream, ["source"], "ts", "5 seconds", "0 seconds", [F.count(F.lit(1)).alias("n")]), spark)
    got = sorted((int((r.session_window.start - BEGIN.replace(tzinfo=None)).total_seconds()), r.n) for r in out.collect())
    assert got == [(0, 3), (30, 2)]


def test_latest_is_not_taken_back_by_older_rows(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", rows_of(5), rows_of(3, 9), rows_of(1) + rows_of(2, source="b"))
    got = windows.keep_latest(windows.latest(stream, ["source"], "ts", ["n", "value"]), spark, ["source"], "ts")
    assert {(r.source, r.n) for r in got.collect()} == {("a", 9), ("b", 2)}


def test_progress_counts_up(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", rows_of(1, 2, 12), rows_of(13, 14, 40)).withColumn("status", F.when(F.col("n") % 2 == 0, "even").otherwise("odd"))
    counted = run.run_available(windows.progress(stream, "ts", "0 seconds", "status"), spark)
    got = sorted((r.start.second, r.status, r.ticks, r.status_ticks, r.interval_ticks, r.ticks_so_far) for r in windows.progress_report(counted, "status").collect())
    assert got == [(0, "even", 1, 1, 2, 2), (0, "odd", 1, 1, 2, 2), (10, "even", 2, 3, 3, 5), (10, "odd", 1, 2, 3, 5)]


def test_rows_too_late_go_to_the_side(spark, tmp_path):
    schema = "source string, t_us long, n long"
    first = [("a", us(0), 1), ("a", us(20), 2), ("a", us(20), 3), ("a", us(15), 4)]
    stream = feed(spark, tmp_path / "in", first, [("a", us(5), 5), ("a", us(21), 6), ("b", us(1), 7)], schema=schema)
    main, late = windows.with_side_table(windows.arrivals(stream, ["source"], "t_us", ["n"], 10 * SECOND), spark)
    assert sorted((r.n, r.arrival) for r in main.collect()) == [(1, "fresh"), (2, "fresh"), (3, "pending"), (4, "stale"), (6, "fresh"), (7, "fresh")]
    assert [(r.n, r.arrival) for r in late.collect()] == [(5, "late")]


CAMERA = "source string, ts timestamp, color_frame long, depth_frame long, color_domain string, depth_domain string, now_us long"
THERMAL = (
    "source string, thermal_ts timestamp, frame_counter long, packet_ms long, ffc_desired boolean, ffc_in_progress boolean, ffc_state string, "
    "tlinear_enabled boolean, tlinear_resolution_k double"
)


def brute_pairs(camera, thermal, reach, cut, watch):
    out, state = [], defaultdict(dict)
    judge = machines.PairFreshness(watch.max_age_us, watch.max_skew_us)
    names, theirs = [x.split()[0] for x in CAMERA.split(", ")], [x.split()[0] for x in THERMAL.split(", ")]
    for frame in sorted(camera, key=lambda r: r[1]):
        own = dict(zip(names, frame))
        t = int(own["ts"].timestamp() * SECOND)
        near = [r for r in thermal if r[0] == own["source"] and own["ts"] - reach <= r[1] <= own["ts"]]
        sample = dict(zip(theirs, max(near, key=lambda r: r[1]) if near else [None] * len(theirs)))
        heard = None if not near else int(sample["thermal_ts"].timestamp() * SECOND)
        row = {**sample, **own, "now_s": own["now_us"], "camera_s": t, "thermal_s": heard}
        state[own["source"]], (reasons,) = judge.step(state[own["source"]], row)
        if t + 1 <= cut:
            out.append((own["source"], t + 1, own["color_frame"], sample["frame_counter"], reasons))
    return sorted(out)


def test_pairs_over_triggers_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    camera, thermal = [], []
    for i in range(150):
        source, s = rng.choice("ab"), i
        camera.append((source, at(s), rng.choice([i, i, i - 3]), i, "x", rng.choice("xxy"), us(s) + rng.randint(-1, 6) * SECOND))
        if rng.random() < 0.6:
            thermal.append((source, at(s - rng.random() * 3), i, rng.choice([i, i - 9]), rng.random() < 0.1, False, rng.choice(["complete", "complete", "imminent"]), True, 0.01))
    # neighbouring files overlap in time by less than the delay
    camera[40], camera[60] = camera[60], camera[40]
    thermal[20], thermal[35] = thermal[35], thermal[20]
    cut = lambda rows, n: [rows[i : i + n] for i in range(0, len(rows), n)]
    a = feed(spark, tmp_path / "camera", *cut(camera, 50), schema=CAMERA)
    b = feed(spark, tmp_path / "thermal", *cut(thermal, 30), schema=THERMAL)
    watch = watches.PairWatch(max_age_us=4 * SECOND, max_skew_us=2 * SECOND)
    got = run.run_available(windows.judged_pairs(a, b, ["source"], "ts", "thermal_ts", watch, reach="5 seconds", delay="30 seconds"), spark)
    newest = min(max(r[1] for r in camera), max(r[1] for r in thermal))
    end = int(newest.timestamp() * 1000) * 1000 - 35 * SECOND
    want = brute_pairs(camera, thermal, timedelta(seconds=5), end, watch)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 80 and any(x[3] is None for x in want)
