"""Streams equal their replays, however the rows are split into triggers."""

import pytest

from emberframe.streaming import machines, run

SAMPLES = [(k, float(t), v) for k in (1, 2) for t, v in enumerate([0, 30, 31, 29, 30, 90, 30, 30, 30, 30, 5, 60, 10, 70, 20])]


def outcome(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_replay(spark, tmp_path, files):
    df = spark.createDataFrame([(k, t, float(v)) for k, t, v in SAMPLES], "k int, t double, value double")
    cuts = [0.0, 5.0, 9.0, 99.0] if files == 3 else [0.0, 99.0]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        df.filter((df.t >= a) & (df.t < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    gate = machines.StableGate(30.0, 2.0, 2.0)
    stream = run.open_table(spark, f"{tmp_path}/in/*.parquet", files_per_trigger=1)
    live = run.run_available(run.stateful(stream, ["k"], ["t"], gate), spark)
    assert outcome(live) == outcome(run.replay(spark.read.parquet(str(tmp_path / "in")), ["k"], ["t"], gate))


def walk(machine, rows):
    state, out = machine.initial(), []
    for row in rows:
        state, result = machine.step(state, row)
        out.append(result)
    return out


def test_cycle_counter():
    values = [0.04, 0.05, 0.06, 0.05, 0.04, 0.05, 0.06, 0.03, 0.07]
    assert [r[0] for r in walk(machines.CycleCounter(), [{"value": v} for v in values])] == [0, 0, 0, 0, 0, 0, 1, 1, 2]


def reading(t, **changes):
    row = {"now_s": t + 0.1, "oak_s": t, "thermal_s": t, "readable": True, "shape_ok": True, "frame_range": 10.0, "content": f"c{t}",
           "roi": [1, 1, 2, 1], "roi_mode": "tips", "quality": 1.0, "crop": [10.0, 20.0], "blob_delta": 0.0, "pinch": 0.1, "enabled": True}
    return {**row, **changes}


def test_pressure_estimator():
    rows = [
        reading(1.0), reading(1.0), reading(0.5), reading(2.0), reading(3.0, pinch=0.04, crop=[34.0, 20.0]),
        reading(4.0, pinch=0.05, crop=[34.0, 44.0]), reading(5.0, pinch=0.06), reading(6.0, oak_s=5.8), reading(7.0, frame_range=1.0),
        reading(8.0, pinch=0.01), reading(9.0, enabled=False), reading(10.0, roi=None, roi_mode="projection_out_of_fov"), reading(11.0, quality=0.1),
    ]
    got = walk(machines.PressureEstimator(), rows)
    assert [r[0] for r in got] == [
        "baseline", "thermal_pending", "thermal_stale", "baseline", "active", "active", "baseline", "oak_stale",
        "thermal_low_contrast", "active_no_baseline", "disabled", "projection_out_of_fov", "low_quality",
    ]
    assert got[4][1] == pytest.approx(0.5) and got[5][1] == pytest.approx(1.0)


def test_limit_has_rounding_slack_and_repeats_end():
    edge = reading(1.0, now_s=1.2, oak_s=1.0)
    assert walk(machines.PressureEstimator(), [edge])[0][0] == "baseline"
    same = [reading(float(t), content="x") for t in range(1, 9)]
    assert [r[0] for r in walk(machines.PressureEstimator(), same)] == ["baseline"] * 6 + ["thermal_stale"] * 2


def test_quota_protocol():
    machine = machines.QuotaProtocol(groups=1, quota=2)
    event = lambda e, t, u=0.0: {"event": e, "t": t, "u": u, "v": 0.0}
    log = [event("unlock", 0.0)]
    for i, phase in enumerate(range(3)):
        log += [event("space", 10.0 * i), event("sample", 10.0 * i + 1, 3.0 * i), event("sample", 10.0 * i + 2, 3.0 * i)]
    got = walk(machine, log)
    assert got[-1][0] == "complete" and got[-1][5] is True
    assert got[5][4] == pytest.approx(3.0) and got[8][4] == pytest.approx(6.0)
    late = walk(machine, [event("unlock", 0.0), event("space", 1.0), event("sample", 12.0)])
    assert late[-1][0] == "complete" and late[-1][2] is False


def test_attempt_loop():
    loop = machines.AttemptLoop(tolerance=1.0, stable_s=1.0, max_reach_s=3.0, max_gap_s=0.5, attempts=2)
    values = [9, 9, 9, 9, 9, 0, 0, 0, 0, 0, 0]
    rows = [{"t": float(t), "value": float(v), "target": 0.0, "hold_s": 2.0} for t, v in enumerate(values)]
    events = [(r[0], r[1]) for r in walk(loop, rows) if r[1]]
    assert events == [(1, "invalid"), (2, "gated_hold_start"), (2, "step_complete")]


def test_publications_and_segments():
    poll = lambda g, now, seen, error=None: {"generation": g, "now_s": now, "observed_s": seen, "started_s": 0.0, "error": error}
    got = walk(machines.PublicationGate(), [poll(1, 1.0, 0.95), poll(1, 1.05, 0.95), poll(1, 1.5, 0.95), poll(1, 1.6, 0.95), poll(2, 1.7, 1.65)])
    assert got == [(True, None), (False, None), (False, "thermal_stale"), (False, None), (True, None)]
    rows = [{"segment": s, "packets": p, "seq": i} for i, (s, p) in enumerate([(1, 60), (2, 60), (3, 60), (4, 60), (1, 60), (2, 61), (1, 61), (2, 61), (3, 61), (None, 61), (4, 61)])]
    assert [r[0] for r in walk(machines.SegmentAssembler(), rows)] == [None] * 3 + [0] + [None] * 7
