"""A session's report by mode and region, and a plan that holds each step once."""

from emberframe.operators.repeatability import session_report

SECOND = 1_000_000_000
FRAME = "run int, frame int, height int, width int, pixels array<int>, ts_ns long, ffc_state string, repeated boolean, display_mode string, raw_low int, raw_high int"
RUN = "session int, run int, mode string, display string, low int, high int"


def _level(run, second):
    if run == 1:
        return 20
    return (10 if second < 5 else 14) if run == 0 else 5 if second < 4 else 9 if second < 7 else 6


def test_regions_share_one_plan(stored):
    """The left half of each frame has the run's level, the right half one more."""
    frames = [
        (run, k, 2, 4, ([level] * 2 + [level + 1] * 2) * 2, k * SECOND, "ffc" if (run, k) == (0, 5) else "normal", False, "dynamic_per_frame_min_max", None, None)
        for run in range(4) for k in range(10) for level in [_level(run, k)]
    ]
    runs = [(0, run, mode, "dynamic", None, None) for run, mode in enumerate(("ffc", "restart", "dynamic", "other"))]
    phases = [(1, "stable", 0, 9), (2, "baseline_0", 0, 3), (2, "hot_hand_0", 4, 6), (2, "recovery_0", 7, 9)]
    windows = [(run, phase, a * SECOND, b * SECOND) for run, phase, a, b in phases]
    out = session_report(
        stored(frames, FRAME), stored(runs, RUN), stored(windows, "run int, phase string, start long, end long"),
        {"left": (0, 0, 2, 2), "right": (2, 0, 2, 2)}, window_ns=30 * SECOND, delay_ns=2 * SECOND, gap_ns=20 * SECOND,
    )
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 20
    expected = [(run, None, "display", None, None, "mode_invalid" if run == 3 else None) for run in range(4)]
    for region, more in (("left", 0.0), ("right", 1.0)):
        expected += [
            (0, region, "ffc_event", "0", 4.0, None), (1, region, "stable", "stable", 20 + more, None), (1, region, "restart_offset", "1", 0.0, None),
            *[(2, region, "phase", f"{name}_0", level + more, None) for name, level in (("baseline", 5), ("hot_hand", 9), ("recovery", 6))],
            (2, region, "hot_minus_baseline", "0", 4.0, None), (2, region, "recovery_minus_baseline", "0", 1.0, None),
        ]
    got = [(r.run, r.region, r.part, r["name"], r.value, r.issue) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
