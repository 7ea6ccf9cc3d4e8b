"""Study scenarios: grip decision, compression steps, paired curves, pinch, classifiers, fits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import calibration, classify, contracts, foam, paired, pinch, summaries
from emberframe.operators.ordered import Series


# --- grip ----------------------------------------------------------------------

def test_windows_restart(stored):
    rows = [(1, i, t, 10.0 * i, 1.0, 2.0, 3.0, 4.0, 5.0) for i, t in enumerate((0.0, 0.1, 0.2, 0.0, 0.1))]
    names = "trial int, frame int, t_capture double, area_px double, mean_delta double, max_delta double, present_load double, present_current double, gripper_pos double"
    df = stored(rows, names)
    series = Series(("trial",), ("frame",))
    bounds = summaries.window_bounds(df, series, "t_capture").orderBy("window").collect()
    assert [(r["start"], r["stop"]) for r in bounds] == [(0, 3), (3, 5)]
    out = summaries.window_summary(df, series, "t_capture").first()
    assert out["baseline_area_px_mean"] == 10.0 and out["hold_area_px_mean"] == 35.0
    assert out["change_area_px_mean"] == 25.0
    alone = summaries.window_summary(df.filter("frame < 3"), series, "t_capture").first()
    assert alone["hold_area_px_mean"] == alone["baseline_area_px_mean"]


@pytest.mark.parametrize("warm_area, decision", [(30.0, "GO"), (10.0, "NO-GO")])
def test_grip_decision(stored, warm_area, decision):
    rows = [("w", "soft", "low", True, warm_area, 12.0)]
    for name in "abc":
        rows += [(name, "soft", lv, False, area, 1.0) for lv, area in (("low", 1.0), ("med", 2.0), ("high", 3.0))]
    rows.append(("d", "solid", "low", False, 2.0, 1.0))
    df = stored(rows, "object_name string, hardness string, grip_level string, warmed boolean, hold_mean_area_px double, hold_max_delta double")
    out = summaries.grip_decision(df).first()
    assert out["decision"] == decision and out["monotonic_objects"] == 3
    assert out["n_passive_trials"] == 10 and out["n_warmed_trials"] == 1


# --- compression ----------------------------------------------------------------

def test_compression_steps(stored):
    key = (1, "steady_state", 1, 1)
    hold = lambda f, state, at, pct: (*key[:2], f, "stable_hold", key[2], key[3], state, 1, True, pct, at)
    telemetry = stored(
        [hold(1, "C0", 1.0, 0.0), hold(2, "C0", 4.0, 1.0), hold(3, "C30", 0.5, 28.0), hold(4, "C30", 4.0, 30.0), hold(5, "C30", 4.5, 31.0)],
        "trial int, block string, frame int, phase string, sequence_id int, step_index int, state string, action_attempt int, marker_detected boolean, compression_pct double, step_elapsed_s double",
    )
    features = stored(
        [(1, f, f, False, h, v) for f, h, v in ((1, "a", 0.1), (2, "b", 0.2), (3, "c", 0.4), (4, "d", 0.42), (5, "d", 0.9))],
        "trial int, frame int, feature_row int, frozen_frame_flag boolean, content string, signal double",
    )
    none = telemetry.limit(0).withColumn("event_type", F.lit("invalid"))
    frames = foam.usable_frames(telemetry, features, none, "signal")
    assert frames.count() == 4
    steps = {r["state"]: r for r in foam.step_summary(frames, ["signal"]).collect()}
    assert steps["C30"]["frame_count"] == 1 and steps["C30"]["signal"] == pytest.approx(0.42)
    assert steps["C0"]["frame_count"] == 2
    relation = foam.compression_relation(foam.step_summary(frames, ["signal"]), "signal").first()
    assert math.isnan(relation["rho"]) and relation["c30_minus_c0"] == pytest.approx(0.27)
    bad = telemetry.filter("frame = 3").withColumn("event_type", F.lit("invalid"))
    assert foam.usable_frames(telemetry, features, bad, "signal").count() == 2


def unsteady(df, column):
    """The column as if each evaluation had added its values in another order."""
    nudge = F.udf(lambda v: v + random.randrange(1, 4000) * 1e-12, "double").asNondeterministic()
    return df.withColumn(column, nudge(column))


def test_ranks_of_means_that_change_in_their_last_bits(stored):
    rows = [(t, "b", 1, k, state, 1, float((7 * k + t) % 40), 3.0 * ((11 * k) % 40) + t) for t in (1, 2) for k, state in enumerate(["C0", "C30"] * 20)]
    names = "trial int, block string, sequence_id int, step_index int, state string, action_attempt int, compression_pct double, signal double"
    steps = stored(rows, names)
    want = {r["trial"]: r["rho"] for r in foam.compression_relation(steps, "signal").collect()}
    got = {r["trial"]: r["rho"] for r in foam.compression_relation(unsteady(unsteady(steps, "compression_pct"), "signal"), "signal").collect()}
    assert got == pytest.approx(want)
    labelled = steps.withColumn("label", (F.col("state") == "C30").cast("int"))
    auc = lambda df: {r["trial"]: r["rank_auc"] for r in classify.rank_auc(df, ["trial"], "signal", "label").collect()}
    assert auc(unsteady(labelled, "signal")) == pytest.approx(auc(labelled))


# --- paired curves ----------------------------------------------------------------

def finger_session(effect=lambda bin_: 0.0, shift=lambda bin_: 0.0, blocks=6, drop=None):
    rng = random.Random(7)
    rows = []
    for block in range(blocks):
        for condition in ("null", "press"):
            wobble = rng.uniform(-0.4, 0.4)
            for step in range(80):
                phase, inside = paired.PHASES[step // 20], (step % 20) // 2
                elapsed = inside * 0.5 + (0.1, 0.3)[step % 2]
                at = (step // 20) * 5.0 + elapsed
                bin_ = int((at - 5.0) // 0.5) if at >= 5 else None
                if drop == (block, condition, phase, inside):
                    continue
                press = condition == "press" and bin_ is not None
                grow = 1.0 + 0.1 * block
                count = 100.0 + 10 * block + 3 * (condition == "press") + (effect(bin_) * grow if press else 0.0) + (wobble if bin_ is not None else 0.0)
                u = 50.0 + (shift(bin_) * grow if press else 0.0)
                rows.append((0, block, condition, "frame", step, phase, elapsed, at, 100.0 * block + 30.0 * (condition == "press") + at, False, True, True, count, u, 40.0, 0.5))
    return rows


FINGER = "session int, block int, condition string, row_type string, frame_index int, phase string, phase_elapsed_s double, global_elapsed_s double, thermal_host_s double, ffc_active boolean, artifact_ok boolean, tracking_valid boolean, primary_signal_count double, u double, v double, depth_m double"


@pytest.mark.parametrize(
    "case, verdict",
    [
        ({}, "NO_DETECTED_SEPARATION_5S"),
        ({"effect": lambda b: 9.0 if 5 <= b <= 9 else 0.0}, "SIGNIFICANT_CURVE_SEPARATION"),
        ({"effect": lambda b: 9.0 if 5 <= b <= 9 else 0.0, "shift": lambda b: 4.0 if 6 <= b <= 8 else 0.0}, "GEOMETRY_CONFOUNDED"),
        ({"drop": (2, "press", "X", 3)}, "INCOMPLETE_FOR_PRIMARY_TEST"),
    ],
)
def test_curve_verdict(stored, case, verdict):
    df = stored(finger_session(**case), FINGER)
    out = paired.analyse_sessions(df, "frame_index")
    assert out["verdict"].first()["verdict"] == verdict
    if "drop" in case:
        broken = out["integrity"].filter(F.size("reasons") > 0).collect()
        assert [(r["block"], r["condition"], r["reasons"]) for r in broken] == [(2, "press", ["thermal_timestamp_gap", "insufficient_tracking:X:3"])]
    if verdict == "SIGNIFICANT_CURVE_SEPARATION":
        best = out["clusters"].filter("field = 'primary_signal_count' and p_corrected <= 0.05").collect()
        assert [(c["start_bin"], c["end_bin"], c["sign"]) for c in best] == [(5, 9, 1)]
        assert best[0]["p_corrected"] == pytest.approx(2 / 64)


def test_cluster_test_brute_force(stored):
    rng = np.random.default_rng(3)
    d = rng.normal(0.6, 1.0, (6, 30))
    d[:, 4] = 2.0

    def t_of(x):
        m, s = x.mean(axis=0), x.std(axis=0, ddof=1) / np.sqrt(6)
        out = np.zeros(30)
        out[s > 0] = m[s > 0] / s[s > 0]
        out[(s <= 0) & (m != 0)] = np.sign(m[(s <= 0) & (m != 0)]) * np.inf
        return out

    def runs(t):
        found, at = [], 0
        while at < 30:
            if abs(t[at]) <= 2.5706:
                at += 1
                continue
            end = at
            while end + 1 < 30 and abs(t[end + 1]) > 2.5706 and (t[end + 1] > 0) == (t[at] > 0):
                end += 1
            found.append((at, end, 1 if t[at] > 0 else -1, float(np.abs(t[at : end + 1]).sum())))
            at = end + 1
        return found

    masses = []
    for perm in range(64):
        signs = np.array([1.0 if perm >> i & 1 else -1.0 for i in range(6)])[:, None]
        masses.append(max((r[3] for r in runs(t_of(d * signs))), default=0.0))
    want = {(a, b, s): np.mean([m >= mass - 1e-9 for m in masses]) for a, b, s, mass in runs(t_of(d))}
    rows = [(0, p, b, float(d[p, b])) for p in range(6) for b in range(30)]
    df = stored(rows, "g int, pair int, bin int, difference double")
    got = {(r["start_bin"], r["end_bin"], r["sign"]): r["p_corrected"] for r in paired.cluster_permutation(df, ["g"], "pair").collect()}
    assert got == pytest.approx(want) and any(a <= 4 <= b for a, b, _ in got)


# --- pinch ---------------------------------------------------------------------

def pinch_rows(signs=(1, 1), back=0.0, patch_sign=1, skip=()):
    rows = [("metadata", "ok", 4, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    labels = pinch.PHASE_LABELS
    for g in range(6):
        for p, phase in enumerate(labels):
            for s in range(5):
                if (g, p, s) in skip:
                    continue
                lift = (0.0, 20.0 + g, back * (20.0 + g))[p]
                tips = [
                    (name, 100.0 + sign * lift, 100.0 + patch_sign * sign * lift, [30.0, 40.0], [30, 40], 0.5, [1, 2], [3, 4])
                    for name, sign in zip(pinch.TIPS, signs)
                ]
                cue = (True, True, [], 5, g, phase, labels[phase])
                rows.append(("attempt", "software_gate_accepted", None, None, None, None, None, None, None, cue, 50.0, [30.0, 40.0], None if p == 0 else 0.5, False, (True, "OK", 0.4 + 0.001 * s, 0.0), tips))
    return rows


PINCH = """row_type string, status string, schema_version int, a string, b string, c string, d string, e string, f string,
 pinch_signal struct<recording:boolean,quota_accepted:boolean,quota_reasons:array<string>,target_valid_samples:int,group_index:int,phase:string,label:string>,
 thermal_frame_median_count double, thermal_pinch_center_uv array<double>, pinch_center_shift_px double, thermal_patches_overlap boolean,
 pinch_geometry struct<valid:boolean,reason:string,pinch_distance_2d_norm:double,pinch_depth_delta_m:double>,
 fingertips array<struct<label:string,thermal_raw_count:double,thermal_patch_3x3_mean_count:double,thermal_uv:array<double>,thermal_pixel:array<int>,depth_m:double,color_pixel:array<int>,depth_pixel:array<int>>>"""


@pytest.mark.parametrize(
    "case, verdict, reasons",
    [
        ({}, "PROCEED_TO_STAGE1F_SHADOW", []),
        ({"signs": (1, -1)}, "STOP_BEFORE_STAGE1F", None),
        ({"patch_sign": -1}, "STOP_BEFORE_STAGE1F", ["sampling_method_sign_disagreement"]),
        ({"back": 0.6}, "STOP_BEFORE_STAGE1F", ["press_recovery_ratio_above_threshold"]),
        ({"skip": {(0, 1, 0)}}, "PROCEED_TO_STAGE1F_SHADOW", []),
        ({"skip": {(0, 1, 0), (3, 2, 4)}}, "BLOCKED_ACQUISITION", ["insufficient_valid_groups"]),
    ],
)
def test_pinch_verdict(stored, case, verdict, reasons):
    df = stored(pinch_rows(**case), PINCH).withColumns(
        {"session": F.lit(1), "attempt": F.monotonically_increasing_id()}
    )
    samples = pinch.accepted_tips(df)
    sessions = stored([(1, True)], "session int, metadata_valid boolean")
    out = pinch.session_analysis(samples, sessions).first()
    assert out["verdict"] == verdict
    if reasons is not None:
        assert out["reasons"] == reasons
    if not case:
        assert out["ir_accuracy"] == 1.0 and out["valid_groups"] == 6


# --- classifiers -----------------------------------------------------------------

def test_hold_samples(stored):
    rows = [(1, 0, 0.0, 0.0, 1.0, False, False), (1, 0, 2.5, 0.0, 2.0, False, False), (1, 1, 2.5, 75.0, 9.0, False, False),
            (1, 1, 2.8, 75.0, 99.0, True, False), (1, 2, 1.0, 60.0, 5.0, False, False)]
    df = stored(rows, "sequence_id int, step_index int, timestamp double, target double, x double, frozen_frame_flag boolean, agc_jump_flag boolean")
    out = classify.hold_samples(df, ["sequence_id", "step_index"], "timestamp", "target", ["x"])
    got = sorted((r["target_percent"], r["hard_label"], r["x"]) for r in out.collect())
    assert got == [(0.0, 0, 2.0), (75.0, 1, 9.0)]


def brute_rule(values, labels):
    unique = np.unique(values)
    if len(unique) == 1:
        cuts = unique
    else:
        margin = max(1.0, np.ptp(unique) * 0.01)
        cuts = np.concatenate(([unique[0] - margin], (unique[:-1] + unique[1:]) / 2, [unique[-1] + margin]))
    best = None
    for sign in (1, -1):
        for cut in cuts:
            said = sign * (values - cut) >= 0
            rates = [np.mean(said[labels == 1]) if (labels == 1).any() else None, np.mean(~said[labels == 0]) if (labels == 0).any() else None]
            known = [r for r in rates if r is not None]
            offer = (round(float(np.mean(known)), 12), sign, -cut)
            best = offer if best is None or offer > best else best
    return best


@pytest.mark.parametrize("seed", range(6))
def test_threshold_brute_force(stored, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 25))
    values, labels = rng.integers(0, 6, n).astype(float), rng.integers(0, 2, n)
    df = stored([(0, float(v), int(y)) for v, y in zip(values, labels)], "g int, value double, label int")
    got = classify.fit_threshold(df, ["g"], rows_per_chunk=4).first()
    accuracy, sign, negated = brute_rule(values, labels)
    assert got["train_balanced_accuracy"] == pytest.approx(accuracy)
    assert (got["sign"], got["threshold"]) == (sign, pytest.approx(-negated))


def test_separable_threshold(stored):
    df = stored([(0, v, y) for v, y in ((0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1))], "g int, value double, label int")
    rule = classify.fit_threshold(df, ["g"]).first()
    assert rule["sign"] == 1 and 0.2 < rule["threshold"] < 0.8 and rule["train_balanced_accuracy"] == 1.0


# --- calibration ------------------------------------------------------------------

def test_affine_fit_against_least_squares(stored):
    rng = np.random.default_rng(0)
    rows = [("good", *map(float, p), float(80 + 30 * p[0] - 4 * p[1] + p[2] + rng.normal()), float(60 + p[0] + 25 * p[1] + rng.normal())) for p in rng.uniform(0, 1, (25, 3))]
    rows += [("few", *r[1:]) for r in rows[:5]]
    rows += [("flat", r[1], r[2], 0.5, r[4], r[5]) for r in rows[:10]]
    rows += [("still", r[1], r[2], r[3], 5.0, r[5]) for r in rows[:10]]
    df = stored(rows, "g string, x double, y double, z double, u double, v double")
    out = {r["g"]: r for r in calibration.fit_affine(df, ["g"]).collect()}
    part = np.array([r[1:] for r in rows if r[0] == "good"])
    design = np.column_stack([np.ones(25), part[:, :3]])
    for target, name in ((3, "coeff_x"), (4, "coeff_y")):
        want = np.linalg.lstsq(design, part[:, target], rcond=None)[0]
        assert np.allclose(out["good"][name], want, atol=1e-9)
    assert out["good"]["condition"] == pytest.approx(np.linalg.cond(design))
    reasons = {g: r["reason"] for g, r in out.items()}
    assert reasons == {"good": None, "few": "too_few_samples", "flat": "rank_deficient", "still": "target_spread_too_small"}


# --- ledger ------------------------------------------------------------------------

def test_ledger_rules(stored):
    ok = dict(pretrial_ffc=True, ffc_reset=True, ffc_active=False, color_valid=True, thermal_valid=True, has_rgb=True, has_depth=True, has_thermal=True)
    base = [(1, 1, 1, "loose", "completed"), (2, 2, 1, "tight", "technical_abort"), (3, 2, 2, "tight", "completed"), (4, 4, 1, "loose", "completed"), (5, 4, 1, "tight", "completed")]
    rows = [(0, *b, *ok.values()) for b in base]
    rows[2] = (*rows[2][:-1], False)
    names = "ledger int, pos int, slot int, attempt int, label string, outcome string, " + ", ".join(f"{k} boolean" for k in ok)
    series = Series(("ledger",), ("pos",))
    slots = contracts.schedule_slots(stored([(0, "LTLT")], "ledger int, primary string"), ["ledger"], "primary")
    out = {r["pos"]: r["violations"] for r in contracts.ledger_violations(stored(rows, names), slots, series).collect()}
    assert out[1] == [] and out[2] == []
    assert out[3] == ["thermal_artifact_missing"]
    assert out[4] == ["duplicate_key", "slot_out_of_order", "label_mismatch"]
    assert out[5] == ["duplicate_key", "attempt_mismatch"]
