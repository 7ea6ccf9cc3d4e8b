"""Pinch, compression and repeatability sessions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import EVENT_SERIES, frames, q, telemetry, with_frames, with_telemetry
from emberframe.catalog.registry import query
from emberframe.operators import foam, pinch, repeatability


def _tips(spark, root):
    """Clicks touch, views press, purchases return; two tips by frame parity."""
    names = {"click": "record_just_touch", "view": "record_press_hard", "purchase": "record_return_touch"}
    phase = F.coalesce(*[F.when(F.col("phase") == k, F.lit(v)) for k, v in names.items()])
    df = telemetry(spark, root).filter(F.col("phase").isin(*names))
    lift = F.when(F.col("phase") == "view", 15.0).otherwise(0.0)
    point = {f"{p}_{a}": (F.col("counter") + F.col("signal") * (i + 1) / 10) for i, p in enumerate(pinch.POINTS) for a in "xy"}
    return df.select(
        (F.col("trial") % 5).alias("session"), F.col("frame").alias("attempt"),
        (F.floor(F.col("trial") / 5) % 6).alias("group_index"), phase.alias("phase"),
        F.when(F.col("frame") % 2 == 0, "thumb_tip").otherwise("index_tip").alias("tip"),
        (F.col("signal") + lift).alias("raw"), (F.col("signal") * 0.9 + lift).alias("patch"),
        (F.col("signal") + lift - 20).alias("corrected_exact"), (F.col("signal") * 0.9 + lift - 20).alias("corrected_patch"),
        (F.col("signal") / 100).alias("depth_m"), *[c.alias(n) for n, c in point.items()],
        (F.col("counter") / 100).alias("pinch_2d"), (F.col("counter") / 10).alias("center_shift_px"),
        (F.col("counter") % 3 == 0).alias("patch_overlap"),
    )


_TIP = """
, s AS (SELECT trial % 5 AS session, (trial // 5) % 6 AS g, CASE phase WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'c' END AS p,
  CASE WHEN frame % 2 = 0 THEN 'thumb_tip' ELSE 'index_tip' END AS tip, signal + CASE WHEN phase = 'view' THEN 15 ELSE 0 END - 20 AS ex,
  signal * 0.9 + CASE WHEN phase = 'view' THEN 15 ELSE 0 END - 20 AS pa, counter / 100 AS pin, counter / 10 AS sh, counter % 3 = 0 AS ov,
  signal / 100 AS dep, counter + signal / 10 AS u FROM ev WHERE phase IN ('click', 'view', 'purchase')),
t AS (SELECT session, g, tip, median(CASE WHEN p = 'b' THEN ex END) - 0.5 * (median(CASE WHEN p = 'a' THEN ex END) + median(CASE WHEN p = 'c' THEN ex END)) AS e,
  median(CASE WHEN p = 'b' THEN pa END) - 0.5 * (median(CASE WHEN p = 'a' THEN pa END) + median(CASE WHEN p = 'c' THEN pa END)) AS pe,
  median(CASE WHEN p = 'c' THEN ex END) - median(CASE WHEN p = 'a' THEN ex END) AS rd,
  median(CASE WHEN p = 'b' THEN dep END) - median(CASE WHEN p = 'a' THEN dep END) AS pd,
  sqrt(2) * abs(median(CASE WHEN p = 'b' THEN u END) - median(CASE WHEN p = 'a' THEN u END)) AS us FROM s GROUP BY ALL),
gg AS (SELECT session, g, median(e) AS primary_effect, median(pe) AS patch_effect, median(rd) AS recovery_delta FROM t GROUP BY ALL),
th AS (SELECT session, g, median(CASE WHEN p = 'b' THEN pin END) - 0.5 * (median(CASE WHEN p = 'a' THEN pin END) + median(CASE WHEN p = 'c' THEN pin END)) AS ge,
  median(CASE WHEN p = 'b' THEN sh END) AS ps, median(CASE WHEN p = 'c' THEN sh END) AS rs, avg(CASE WHEN ov THEN 1 ELSE 0 END) AS ov,
  count(CASE WHEN p = 'a' THEN 1 END) >= 1 AND count(CASE WHEN p = 'b' THEN 1 END) >= 1 AND count(CASE WHEN p = 'c' THEN 1 END) >= 1 AS valid
  FROM s WHERE tip = 'thumb_tip' GROUP BY ALL),
ge AS (SELECT * FROM gg JOIN th USING (session, g) WHERE valid)"""


@query(
    "pinch_tip_effects",
    with_telemetry(
        _TIP
        + """
SELECT session, g AS group_index, tip, round(e, 6) AS exact_effect, round(pe, 6) AS patch_effect, round(rd, 6) AS return_delta,
  round(pd, 6) AS press_depth_shift_m, round(us, 6) AS press_thermal_uv_shift_px FROM t"""
    ),
)
def pinch_tip_effects(spark, root):
    out = pinch.tip_effects(_tips(spark, root))
    names = ("exact_effect", "patch_effect", "return_delta", "press_depth_shift_m", "press_thermal_uv_shift_px")
    return out.select("session", "group_index", "tip", *[q(n).alias(n) for n in names])


@query(
    "pinch_group_effects",
    with_telemetry(
        _TIP
        + """
SELECT session, g AS group_index, round(primary_effect, 6) AS primary_effect, round(patch_effect, 6) AS patch_effect, round(ge, 6) AS geometry_effect,
  round(recovery_delta, 6) AS recovery_delta, round(ps, 6) AS press_center_shift_px, round(rs, 6) AS return_center_shift_px, round(ov, 6) AS patch_overlap_rate FROM ge"""
    ),
)
def pinch_group_effects(spark, root):
    samples = _tips(spark, root)
    out = pinch.group_effects(samples, pinch.valid_groups(samples, wanted=None))
    return out.select("session", "group_index", *[q(c).alias(c) for c in out.columns[2:]])


@query(
    "pinch_session_verdict",
    with_telemetry(
        _TIP
        + """, o AS (SELECT a.session, a.g, a.primary_effect AS v, a.ge AS w, median(b.primary_effect) AS m, median(b.ge) AS n FROM ge a LEFT JOIN ge b ON a.session = b.session AND a.g <> b.g GROUP BY ALL),
ac AS (SELECT session, count(*) AS valid_groups,
  sum(CASE WHEN m IS NOT NULL AND NOT ((m > 0 AND m / 2 <= 0) OR (m < 0 AND m / 2 >= 0)) THEN 1 ELSE 0 END + CASE WHEN (m > 0 AND v >= m / 2) OR (m < 0 AND v <= m / 2) THEN 1 ELSE 0 END) / 12 AS ia,
  sum(CASE WHEN n IS NOT NULL AND NOT ((n > 0 AND n / 2 <= 0) OR (n < 0 AND n / 2 >= 0)) THEN 1 ELSE 0 END + CASE WHEN (n > 0 AND w >= n / 2) OR (n < 0 AND w <= n / 2) THEN 1 ELSE 0 END) / 12 AS ga
  FROM o GROUP BY session),
tp AS (SELECT session, tip, median(e) AS me, count(CASE WHEN e > 0 THEN 1 END) AS up, count(CASE WHEN e < 0 THEN 1 END) AS down, median(abs(rd)) / greatest(median(abs(e)), 1) AS rec
  FROM t JOIN ge USING (session, g) GROUP BY ALL),
ts AS (SELECT session, min(sign(me)) AS d0, max(sign(me)) AS d1, min(CASE WHEN me > 0 THEN up WHEN me < 0 THEN down ELSE 0 END) AS cg, max(rec) AS rec, count(*) AS n FROM tp GROUP BY session),
md AS (SELECT session, median(primary_effect) AS me, median(patch_effect) AS pm FROM ge GROUP BY session),
al AS (SELECT DISTINCT session FROM s),
j AS (SELECT al.session, coalesce(valid_groups, 0) AS vg, coalesce(ia, 0) AS ia, coalesce(ga, 0) AS ga, me, pm, cg, rec,
  coalesce(n = 2 AND d0 = d1 AND d0 <> 0 AND cg >= 4, false) AS ag FROM al LEFT JOIN ac USING (session) LEFT JOIN ts USING (session) LEFT JOIN md USING (session)),
f AS (SELECT *, concat_ws('|', CASE WHEN ia < 0.75 THEN 'ir_eba_below_threshold' END, CASE WHEN ia - ga < 0.1 THEN 'ir_gain_over_geometry_below_threshold' END,
  CASE WHEN NOT ag THEN 'per_tip_press_direction_inconsistent' END, CASE WHEN NOT coalesce(me * pm > 0, false) THEN 'sampling_method_sign_disagreement' END,
  CASE WHEN coalesce(rec > 0.5, true) THEN 'press_recovery_ratio_above_threshold' END) AS failed FROM j)
SELECT session, vg AS valid_groups, round(ia, 6) AS ir_accuracy, round(ga, 6) AS geometry_accuracy, round(ia - ga, 6) AS ir_gain, round(me, 6) AS median_effect,
  round(pm, 6) AS patch_median_effect, cg AS consistent_groups, round(rec, 6) AS press_recovery_ratio, CASE WHEN vg < 5 THEN 'insufficient_valid_groups' ELSE failed END AS reasons,
  CASE WHEN vg < 5 THEN 'BLOCKED_ACQUISITION' WHEN failed <> '' THEN 'STOP_BEFORE_STAGE1F' ELSE 'PROCEED_TO_STAGE1F_SHADOW' END AS verdict FROM f"""
    ),
)
def pinch_session_verdict(spark, root):
    samples = _tips(spark, root)
    sessions = samples.select("session").distinct().withColumn("metadata_valid", F.lit(True))
    out = pinch.session_analysis(samples, sessions, wanted=None)
    numbers = ("ir_accuracy", "geometry_accuracy", "ir_gain", "median_effect", "patch_median_effect", "press_recovery_ratio")
    return out.withColumns({n: q(n) for n in numbers}).withColumn("reasons", F.concat_ws("|", "reasons"))


# --- compression sessions -------------------------------------------------

def _foam(spark, root):
    df = telemetry(spark, root)
    states = F.array(*[F.lit(s) for s in ("C0", "C10", "C20", "C30")])
    rows = df.select(
        (F.col("trial") % 10).alias("trial"), "frame", F.lit("steady_state").alias("block"),
        F.when(F.col("phase") != "signup", "stable_hold").otherwise("approach").alias("phase"),
        (F.floor(F.col("trial") / 10) % 5).alias("sequence_id"), (F.col("counter") % 8).alias("step_index"),
        F.get(states, (F.col("counter") % 4).cast("int")).alias("state"), (F.col("frame") % 2 + 1).alias("action_attempt"),
        (F.col("phase") != "error").alias("marker_detected"), F.col("signal").alias("compression_pct"),
        (F.col("t") / 86400).alias("step_elapsed_s"),
    )
    features = df.select(
        (F.col("trial") % 10).alias("trial"), "frame", F.col("t_us").alias("feature_row"),
        (F.col("frame") % 41 == 0).alias("frozen_frame_flag"), F.sha1(F.concat_ws("-", "signal", "counter")).alias("content"),
        (F.col("signal") * 0.5 + F.col("counter")).alias("foam_center_norm"),
        F.when(F.col("counter") % 5 != 0, F.col("signal")).alias("background_norm"),
    )
    events = rows.filter(F.col("step_index") == 7).select(
        "trial", "block", "sequence_id", "step_index", "state", "action_attempt", F.lit("invalid").alias("event_type")
    ).filter(F.col("trial") % 3 == 0)
    return foam.usable_frames(rows, features, events, "foam_center_norm")


_FOAM = """
, r AS (SELECT trial % 10 AS trial, frame, (trial // 10) % 5 AS sequence_id, counter % 8 AS step_index, CASE counter % 4 WHEN 0 THEN 'C0' WHEN 1 THEN 'C10' WHEN 2 THEN 'C20' ELSE 'C30' END AS state,
  frame % 2 + 1 AS action_attempt, signal AS compression_pct, t / 86400 AS el, signal * 0.5 + counter AS fc, CASE WHEN counter % 5 <> 0 THEN signal END AS bg,
  sha1(signal || '-' || counter) AS content FROM ev WHERE phase <> 'signup' AND phase <> 'error' AND frame % 41 <> 0 AND NOT (counter % 8 = 7 AND (trial % 10) % 3 = 0)),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY trial, content ORDER BY frame) = 1),
e AS (SELECT *, max(el) OVER (PARTITION BY trial, sequence_id, step_index, state, action_attempt) AS m FROM u),
st AS (SELECT trial, sequence_id, step_index, state, action_attempt, count(*) AS frame_count, avg(compression_pct) AS compression_pct, avg(fc) AS foam_center_norm, avg(bg) AS background_norm
  FROM e WHERE el >= m - 3 GROUP BY ALL)"""


@query("foam_usable_frames", with_telemetry(_FOAM + "\nSELECT trial, frame, state, round(fc, 6) AS foam_center_norm FROM u"))
def foam_usable_frames(spark, root):
    return _foam(spark, root).select("trial", "frame", "state", q("foam_center_norm").alias("foam_center_norm"))


@query(
    "foam_step_summary",
    with_telemetry(
        _FOAM
        + """
SELECT trial, sequence_id, step_index, state, action_attempt, frame_count, round(compression_pct, 6) AS compression_pct, round(foam_center_norm, 6) AS foam_center_norm,
  round(background_norm, 6) AS background_norm FROM st"""
    ),
)
def foam_step_summary(spark, root):
    out = foam.step_summary(_foam(spark, root), ["foam_center_norm", "background_norm"]).drop("block")
    return out.withColumns({n: q(n) for n in ("compression_pct", "foam_center_norm", "background_norm")})


@query(
    "foam_relation",
    with_telemetry(
        _FOAM
        + """, k AS (SELECT *, rank() OVER (PARTITION BY trial ORDER BY compression_pct) + (count(*) OVER (PARTITION BY trial, compression_pct) - 1) / 2 AS a,
  rank() OVER (PARTITION BY trial ORDER BY foam_center_norm) + (count(*) OVER (PARTITION BY trial, foam_center_norm) - 1) / 2 AS b FROM st)
SELECT trial, count(*) AS steps, round(avg(CASE WHEN state = 'C30' THEN foam_center_norm END) - avg(CASE WHEN state = 'C0' THEN foam_center_norm END), 9) AS c30_minus_c0,
  round(corr(a, b), 6) AS rho FROM k GROUP BY trial"""
    ),
)
def foam_relation(spark, root):
    steps = foam.step_summary(_foam(spark, root), ["foam_center_norm", "background_norm"])
    out = foam.compression_relation(steps, "foam_center_norm")
    return out.select("trial", "steps", q("c30_minus_c0", 9).alias("c30_minus_c0"), q("rho").alias("rho"))


@query(
    "released_distance",
    with_telemetry(
        """
, s AS (SELECT trial, signal AS d FROM ev WHERE t >= 259200 AND phase <> 'error'),
a AS (SELECT trial, count(*) AS samples, quantile_cont(d, 0.05) AS p5, median(d) AS d0, quantile_cont(d, 0.95) AS p95 FROM s GROUP BY trial)
SELECT trial, samples, round(d0, 6) AS d0_px, round((p95 - p5) / d0, 6) AS relative_span, concat_ws('|', CASE WHEN samples < 54 THEN 'too_few_samples' END,
  CASE WHEN (p95 - p5) / d0 > 4 THEN 'unstable' END) AS issues FROM a"""
    ),
)
def released_distance(spark, root):
    df = telemetry(spark, root).select(
        "trial", F.col("t").alias("elapsed_s"), F.when(F.col("phase") != "error", F.col("signal")).alias("distance_px")
    )
    out = foam.released_distance(df, ["trial"], settle_s=259200.0, expected=F.lit(60), max_span=4.0)
    return out.select(
        "trial", "samples", q("d0_px").alias("d0_px"), q("relative_span").alias("relative_span"),
        F.concat_ws("|", "issues").alias("issues"),
    )


@query(
    "preflight_report",
    with_telemetry(
        """
, d AS (SELECT *, phase <> 'error' AS det FROM ev), c AS (SELECT *, CASE WHEN det = lag(det) OVER (PARTITION BY trial ORDER BY t, frame) THEN 0 ELSE 1 END AS s FROM d),
r AS (SELECT *, sum(s) OVER (PARTITION BY trial ORDER BY t, frame) AS run FROM c),
a AS (SELECT trial, run, count(*) AS n, min(t) AS b, max(t) AS e, bool_or(det) AS det FROM r GROUP BY ALL),
x AS (SELECT *, coalesce(lead(b) OVER (PARTITION BY trial ORDER BY run), e) AS stop FROM a),
m AS (SELECT trial, sum(n) AS ev, sum(CASE WHEN det THEN n ELSE 0 END) AS de, coalesce(max(CASE WHEN NOT det THEN stop - b END), 0) AS lm FROM x GROUP BY trial),
f AS (SELECT trial, max(signal) - min(signal) AS sp, avg(CASE WHEN counter >= 90 THEN 1 ELSE 0 END) AS sat FROM ev GROUP BY trial)
SELECT trial, round(de / ev, 6) AS marker_rate, round(lm, 6) AS longest_missing_s, concat_ws('|', CASE WHEN de / ev < 0.95 THEN 'marker_rate_low' END,
  CASE WHEN lm > 86400 THEN 'marker_lost_too_long' END, CASE WHEN NOT sp >= 150 THEN 'reference_span_small' END, CASE WHEN sat > 0.1 THEN 'reference_saturated' END) AS issues
FROM m JOIN f USING (trial)"""
    ),
)
def preflight_report(spark, root):
    df = telemetry(spark, root)
    detections = df.select("trial", F.col("t").alias("elapsed_s"), "frame", (F.col("phase") != "error").alias("detected"))
    references = df.groupBy("trial").agg(
        (F.max("signal") - F.min("signal")).alias("reference_span"),
        F.avg(F.when(F.col("counter") >= 90, 1.0).otherwise(0.0)).alias("saturated_fraction"),
    )
    out = foam.preflight_report(detections, references, ["trial"], max_missing_s=86400.0, min_span=150.0)
    return out.select(
        "trial", q("marker_rate").alias("marker_rate"), q("longest_missing_s").alias("longest_missing_s"),
        F.concat_ws("|", "issues").alias("issues"),
    )


@query(
    "representative_frames",
    with_telemetry(
        """
, c AS (SELECT * FROM (VALUES ('click'), ('view'), ('refund')) v(phase)),
k AS (SELECT DISTINCT ev.trial, c.phase FROM ev, c), l AS (SELECT trial, phase, arg_max(frame, (t, frame)) AS frame, max(t) AS t FROM ev GROUP BY ALL)
SELECT k.trial, k.phase, frame, round(t, 6) AS step_elapsed_s, CASE WHEN frame IS NULL THEN 'case_missing' END AS issue FROM k LEFT JOIN l ON l.trial = k.trial AND l.phase = k.phase"""
    ),
)
def representative_frames(spark, root):
    df = telemetry(spark, root).select("trial", "phase", "frame", F.col("t").alias("step_elapsed_s"))
    wanted = F.array(*[F.lit(p) for p in ("click", "view", "refund")])
    cases = df.select("trial").distinct().withColumn("phase", F.explode(wanted))
    out = foam.representative_frames(df, cases, ["trial", "phase"])
    return out.withColumn("step_elapsed_s", q("step_elapsed_s"))


def _rounds(spark, root):
    df = telemetry(spark, root)
    names = {"click": "LIGHT_A", "view": "HARD", "purchase": "LIGHT_B"}
    phase = F.coalesce(*[F.when(F.col("phase") == k, F.lit(v)) for k, v in names.items()])
    return df.select(
        "trial", "t_us", "frame", phase.alias("phase"), "signal", (F.col("counter") > 80).alias("ffc_desired"),
        F.col("signal").alias("frame_level"), F.col("counter").cast("double").alias("shift_px"),
    )


@query(
    "round_summary",
    with_telemetry(
        """
, m AS (SELECT trial, count(CASE WHEN phase = 'click' THEN 1 END) AS na, count(CASE WHEN phase = 'view' THEN 1 END) AS nh, count(CASE WHEN phase = 'purchase' THEN 1 END) AS nb,
  median(CASE WHEN phase = 'click' THEN signal END) AS a, median(CASE WHEN phase = 'view' THEN signal END) AS h, median(CASE WHEN phase = 'purchase' THEN signal END) AS b FROM ev GROUP BY trial)
SELECT trial, na AS n_light_a, nh AS n_hard, nb AS n_light_b, round(h - (a + b) / 2, 6) AS aba_effect, round(CASE WHEN h <> a THEN abs(b - a) / abs(h - a) END, 6) AS recovery_ratio,
  na >= 5 AND nh >= 5 AND nb >= 5 AND h - (a + b) / 2 IS NOT NULL AS valid FROM m"""
    ),
)
def round_summary(spark, root):
    out = foam.round_summary(_rounds(spark, root), ["trial"], min_frames=5)
    return out.select(
        "trial", "n_light_a", "n_hard", "n_light_b", q("aba_effect").alias("aba_effect"),
        q("recovery_ratio").alias("recovery_ratio"), "valid",
    )


@query(
    "round_diagnostics",
    with_telemetry(
        """
SELECT trial, round(avg(CASE WHEN counter > 80 THEN 1 ELSE 0 END), 6) AS ffc_desired_fraction, round(arg_max(signal, (t_us, frame)) - arg_min(signal, (t_us, frame)), 6) AS frame_level_drift,
  median(CASE WHEN phase = 'click' THEN counter END) AS shift_light_a, median(CASE WHEN phase = 'view' THEN counter END) AS shift_hard,
  median(CASE WHEN phase = 'purchase' THEN counter END) AS shift_light_b FROM ev GROUP BY trial"""
    ),
)
def round_diagnostics(spark, root):
    out = foam.round_diagnostics(_rounds(spark, root), ["trial"], ["t_us", "frame"])
    return out.withColumns({n: q(n) for n in ("ffc_desired_fraction", "frame_level_drift")})


@query(
    "reason_histogram",
    with_telemetry(
        """
, r AS (SELECT trial, unnest(list_filter([CASE WHEN signal < 10 THEN 'low' END, CASE WHEN counter > 50 THEN 'late' END, CASE WHEN phase = 'error' THEN 'fault' END], lambda x: x IS NOT NULL)) AS reason FROM ev)
SELECT trial, reason, count(*) AS n FROM r GROUP BY ALL"""
    ),
)
def reason_histogram(spark, root):
    from emberframe.functions.numbers import all_reasons

    df = telemetry(spark, root)
    reasons = all_reasons(
        (F.col("signal") < 10, "low"), (F.col("counter") > 50, "late"), (F.col("phase") == "error", "fault")
    )
    return foam.reason_histogram(df.withColumn("reasons", reasons), ["trial"], "reasons")


@query(
    "attempt_accounting",
    with_telemetry(
        """
, l AS (SELECT *, lag(counter // 25) OVER (PARTITION BY trial ORDER BY t_us, frame) AS p FROM ev), f AS (SELECT *, p IS NULL OR p <> counter // 25 AS fresh FROM l)
SELECT trial, count(*) AS frame_events, count(CASE WHEN NOT fresh THEN 1 END) AS reused_depth_frames, count(CASE WHEN fresh THEN 1 END) AS fresh_attempts,
  count(CASE WHEN fresh AND phase <> 'error' THEN 1 END) AS accepted, count(CASE WHEN fresh AND phase = 'error' THEN 1 END) AS blocked FROM f GROUP BY trial"""
    ),
)
def attempt_accounting(spark, root):
    df = telemetry(spark, root).withColumns(
        {
            "depth_frame": F.floor(F.col("counter") / 25),
            "status": F.when(F.col("phase") == "error", "blocked").otherwise("accepted"),
        }
    )
    return foam.attempt_accounting(df, EVENT_SERIES, "depth_frame", "status")


@query(
    "comparable_scale",
    with_frames(
        """, a AS (SELECT trial, frame, frame % 4 = 1 AS touch FROM px GROUP BY trial, frame),
c AS (SELECT trial, count(*) AS frames, count(CASE WHEN touch THEN 1 END) AS touch_frames, arg_min(frame, (CASE WHEN touch THEN 0 ELSE 1 END, frame)) AS scale_frame FROM a GROUP BY trial)
SELECT c.trial, any_value(frames) AS frames, any_value(touch_frames) AS touch_frames, scale_frame, round(quantile_cont(v, 0.01), 6) AS low, round(quantile_cont(v, 0.99), 6) AS high
FROM c JOIN px ON px.trial = c.trial AND px.frame = scale_frame GROUP BY c.trial, scale_frame"""
    ),
)
def comparable_scale(spark, root):
    stack = frames(spark, root).withColumn("accepted_touch", F.col("frame") % 4 == 1)
    out = foam.comparable_scale(stack, ["trial"], ["frame"])
    return out.withColumns({n: q(n) for n in ("low", "high")})


# --- raw-count repeatability ----------------------------------------------

REGION = (2, 2, 4, 4)
_SECOND = 1_000_000_000


def _raw(spark, root):
    """Embedding frames as raw counts, one second per vector id, some in shutter state."""
    stack = frames(spark, root)
    number = F.col("frame")
    state = F.when(F.floor(number / 6) % 9 == 4, "ffc").when(number % 23 == 0, "post_ffc_discarded").otherwise("normal")
    return stack.withColumns(
        {
            "pixels": F.transform("pixels", lambda v: v + 3000), "ts_ns": number * _SECOND,
            "ffc_state": state, "repeated": number % 19 == 0,
        }
    )


_RAW = """,
st AS (SELECT trial, frame, frame * 1000000000 AS ts, CASE WHEN (frame // 6) % 9 = 4 THEN 'ffc' WHEN frame % 23 = 0 THEN 'post_ffc_discarded' ELSE 'normal' END AS state, frame % 19 = 0 AS rep FROM px GROUP BY trial, frame),
lv AS (SELECT st.trial, st.frame, ts, CAST(floor(median(v + 3000)) AS BIGINT) AS level FROM st JOIN px ON px.trial = st.trial AND px.frame = st.frame
  WHERE state = 'normal' AND NOT rep AND x >= 2 AND x < 6 AND y >= 2 AND y < 6 GROUP BY ALL)"""


@query("frame_level_medians", with_frames(_RAW + "\nSELECT trial, frame, ts AS ts_ns, level FROM lv"))
def frame_level_medians(spark, root):
    return repeatability.frame_medians(_raw(spark, root), ["trial"], REGION)


@query(
    "phase_metric",
    with_frames(
        _RAW
        + """
SELECT trial, ts // 100000000000 AS phase, count(*) AS unique_frame_count, CAST(floor(median(level)) AS BIGINT) AS median, round(avg(level), 6) AS mean,
  round(stddev_pop(level), 6) AS population_stdev, min(ts) AS start_ns, max(ts) AS end_ns FROM lv GROUP BY ALL"""
    ),
)
def phase_metric(spark, root):
    levels = repeatability.frame_medians(_raw(spark, root), ["trial"], REGION)
    placed = levels.withColumn("phase", F.floor(F.col("ts_ns") / (100 * _SECOND)))
    out = repeatability.phase_metric(placed, ["trial", "phase"])
    return out.withColumns({n: q(n) for n in ("mean", "population_stdev")})


def _recovery_sql(clusters: str) -> str:
    return with_frames(
        f"""{_RAW}, sh AS (SELECT trial, frame, ts FROM st WHERE state = 'ffc'), {clusters},
e AS (SELECT trial, cluster, count(*) AS n, min(ts) AS s, max(ts) AS x FROM cl GROUP BY ALL),
a AS (SELECT e.trial, e.cluster, CAST(floor(median(level)) AS BIGINT) AS m, count(*) AS k, stddev_pop(level) AS sd FROM e JOIN lv ON lv.trial = e.trial AND ts BETWEEN s - 30000000000 AND s - 1 GROUP BY ALL),
b AS (SELECT e.trial, e.cluster, CAST(floor(median(level)) AS BIGINT) AS m, count(*) AS k, stddev_pop(level) AS sd FROM e JOIN lv ON lv.trial = e.trial AND ts BETWEEN x + 2000000000 AND x + 32000000000 GROUP BY ALL)
SELECT e.trial, CAST(e.cluster AS BIGINT) AS cluster, n AS ffc_frame_count, s AS ffc_start_ns, x AS ffc_end_ns, a.m AS pre_median, b.m AS post_median, a.k AS pre_unique_frame_count, b.k AS post_unique_frame_count,
  round(a.sd, 6) AS pre_population_stdev, round(b.sd, 6) AS post_population_stdev, b.m - a.m AS post_minus_pre_counts,
  CASE WHEN a.m IS NULL THEN 'pre_window_empty' WHEN b.m IS NULL THEN 'post_window_empty' END AS reason
FROM e LEFT JOIN a ON a.trial = e.trial AND a.cluster = e.cluster LEFT JOIN b ON b.trial = e.trial AND b.cluster = e.cluster"""
    )


def _recovery(spark, root, gap):
    raw = _raw(spark, root)
    levels = repeatability.frame_medians(raw, ["trial"], REGION)
    spans = repeatability.recovery_windows(
        raw.select("trial", "frame", "ts_ns", "ffc_state"), ["trial"],
        window_ns=30 * _SECOND, delay_ns=2 * _SECOND, gap_ns=gap,
    )
    out = repeatability.ffc_recovery(levels, spans, ["trial"], window_ns=30 * _SECOND)
    return out.withColumns({n: q(n) for n in ("pre_population_stdev", "post_population_stdev")})


@query(
    "ffc_recovery_events",
    _recovery_sql(
        """gp AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY trial ORDER BY ts, frame) > 20000000000 THEN 1 ELSE 0 END AS g FROM sh),
cl AS (SELECT *, sum(g) OVER (PARTITION BY trial ORDER BY ts, frame) AS cluster FROM gp)"""
    ),
)
def ffc_recovery_events(spark, root):
    return _recovery(spark, root, 20 * _SECOND)


@query("ffc_recovery_whole", _recovery_sql("cl AS (SELECT *, 0 AS cluster FROM sh)"))
def ffc_recovery_whole(spark, root):
    return _recovery(spark, root, None)


@query(
    "restart_offsets",
    with_frames(
        _RAW
        + """, r AS (SELECT trial % 2 AS device, trial AS run, CAST(floor(median(level)) AS BIGINT) AS level FROM lv GROUP BY ALL),
f AS (SELECT device, arg_min(level, run) AS ref, min(run) AS reference_run FROM r GROUP BY device)
SELECT device, run, level, ref AS reference_level, reference_run, level - ref AS "offset", max(abs(level - ref)) OVER (PARTITION BY device) AS max_absolute_offset FROM r JOIN f USING (device)"""
    ),
)
def restart_offsets(spark, root):
    levels = repeatability.frame_medians(_raw(spark, root), ["trial"], REGION)
    runs = repeatability.phase_metric(levels, ["trial"]).select(
        (F.col("trial") % 2).alias("device"), F.col("trial").alias("run"), F.col("median").alias("level")
    )
    return repeatability.restart_offsets(runs, ["device"], "run", "level")


@query(
    "dynamic_cycles",
    with_frames(
        _RAW
        + """, p AS (SELECT trial, (ts // 20000000000) % 3 AS k, ts // 120000000000 AS c, level FROM lv),
m AS (SELECT trial, c, k, CAST(floor(median(level)) AS BIGINT) AS m FROM p GROUP BY ALL),
w AS (SELECT trial, c, max(CASE WHEN k = 0 THEN m END) AS b, max(CASE WHEN k = 1 THEN m END) AS h, max(CASE WHEN k = 2 THEN m END) AS r FROM m GROUP BY ALL)
SELECT trial, CAST(c AS VARCHAR) AS cycle, h - b AS hot_minus_baseline, r - b AS recovery_minus_baseline, CASE WHEN h IS NULL OR r IS NULL THEN 'cycle_incomplete' END AS issue FROM w WHERE b IS NOT NULL"""
    ),
)
def dynamic_cycles(spark, root):
    levels = repeatability.frame_medians(_raw(spark, root), ["trial"], REGION)
    names = F.array(*[F.lit(n) for n in ("baseline", "hot_hand", "recovery")])
    kind = F.get(names, (F.floor(F.col("ts_ns") / (20 * _SECOND)) % 3).cast("int"))
    cycle = F.floor(F.col("ts_ns") / (120 * _SECOND)).cast("string")
    placed = levels.withColumn("phase", F.concat_ws("_", kind, cycle))
    metrics = repeatability.phase_metric(placed, ["trial", "phase"])
    return repeatability.dynamic_cycles(metrics, ["trial"], "phase", "median")


@query(
    "palette_comparison",
    with_frames(
        _RAW
        + """, m AS (SELECT trial, CAST(floor(median(level)) AS BIGINT) AS m FROM lv GROUP BY trial), o AS (SELECT trial, CAST(count(*) % 256 AS INTEGER) AS ob FROM st GROUP BY trial)
SELECT trial, m AS target_raw_median, CAST(least(255, greatest(0, (m - 2900) * 255 // 200)) AS INTEGER) AS expected_palette_index, ob AS observed_palette_index,
  CAST(ob - least(255, greatest(0, (m - 2900) * 255 // 200)) AS INTEGER) AS observed_minus_expected FROM m LEFT JOIN o USING (trial)"""
    ),
)
def palette_comparison(spark, root):
    raw = _raw(spark, root)
    levels = repeatability.phase_metric(repeatability.frame_medians(raw, ["trial"], REGION), ["trial"])
    observed = raw.groupBy("trial").agg(
        (F.count(F.lit(1)) % 256).cast("int").alias("observed_palette_index")
    )
    return repeatability.palette_comparison(levels, observed, ["trial"], F.lit(2900), F.lit(3100))


@query(
    "capture_audit",
    with_frames(
        _RAW
        + """, s2 AS (SELECT trial, frame, min(v + 3000) AS lo, max(v + 3000) AS hi, CAST(floor(median(v + 3000)) AS BIGINT) AS me FROM px GROUP BY ALL),
j AS (SELECT s2.*, ts, state, rep, CASE WHEN s2.frame % 31 = 0 THEN lo + 1 ELSE lo END AS raw_min FROM s2 JOIN st ON st.trial = s2.trial AND st.frame = s2.frame)
SELECT trial, count(*) AS frame_count, CAST(1 AS BIGINT) AS dimension_count, count(CASE WHEN lo <> raw_min THEN 1 END) AS stat_mismatch_count, bool_or(hi > 255) AS has_values_above_255,
  count(CASE WHEN rep THEN 1 END) AS repeated_frame_count, count(CASE WHEN state = 'ffc' THEN 1 END) AS ffc_frame_count, count(CASE WHEN state = 'normal' THEN 1 END) AS normal_frame_count,
  count(CASE WHEN state = 'normal' AND NOT rep THEN 1 END) AS deduplicated_normal_frame_count, round(avg(CASE WHEN state = 'normal' AND NOT rep THEN me END), 6) AS level_mean,
  round(regr_slope(CASE WHEN state = 'normal' AND NOT rep THEN me END, ts / 1e9), 6) AS drift_counts_per_s, round(count(CASE WHEN rep THEN 1 END) / count(*), 6) AS repeated_frame_fraction,
  true AS raw_stream_accepted, CASE WHEN count(CASE WHEN lo <> raw_min THEN 1 END) > 0 THEN 'stat_mismatch' WHEN count(CASE WHEN rep THEN 1 END) / count(*) > 0.05 THEN 'repeated_fraction_exceeded' END AS issue
FROM j GROUP BY trial"""
    ),
)
def capture_audit(spark, root):
    from emberframe.functions import arrays

    raw = _raw(spark, root)
    ordered = F.array_sort("pixels")
    low = F.get(ordered, 0)
    stored = raw.withColumns(
        {
            "raw_min": F.when(F.col("frame") % 31 == 0, low + 1).otherwise(low),
            "raw_max": F.array_max("pixels"), "raw_median": F.floor(arrays.quantile(ordered, 0.5)).cast("long"),
        }
    )
    out = repeatability.capture_audit(stored, ["trial"], max_repeated=0.05).drop("level_min", "level_max", "level_stdev")
    return out.withColumns({n: q(n) for n in ("level_mean", "drift_counts_per_s", "repeated_frame_fraction")})


def _report_sql() -> str:
    """Modes side by side: one subquery a part, the regions as columns of the level."""
    boxes = {"target": "x >= 2 AND x < 6 AND y >= 2 AND y < 6", "control": "x < 3 AND y < 8"}
    levels = " UNION ALL ".join(
        f"""SELECT '{region}' AS region, st.trial AS run, st.frame, ts, CAST(floor(median(v + 3000)) AS BIGINT) AS level FROM st JOIN px ON px.trial = st.trial AND px.frame = st.frame
        WHERE state = 'normal' AND NOT rep AND {box} GROUP BY ALL"""
        for region, box in boxes.items()
    )
    return with_frames(
        _RAW
        + f""", rn AS (SELECT DISTINCT trial AS run, trial // 5 AS session, ['ffc', 'restart', 'dynamic', 'restart', 'dynamic', 'other'][trial % 6 + 1] AS mode FROM px),
lr AS ({levels}), l AS (SELECT lr.*, session, mode FROM lr JOIN rn USING (run)),
fr AS (SELECT run, session, mode, frame, CASE WHEN run % 4 = 1 AND frame % 40 > 36 THEN 'display_mode_mismatch' WHEN run % 4 = 3 AND frame % 50 > 45 THEN 'display_bounds_mismatch' END AS issue FROM st JOIN rn ON rn.run = st.trial),
di AS (SELECT run, arg_min(issue, frame) AS issue FROM fr WHERE issue IS NOT NULL GROUP BY run),
sh AS (SELECT trial AS run, frame, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY trial ORDER BY ts, frame) > 20000000000 THEN 1 ELSE 0 END AS g FROM st WHERE state = 'ffc'),
cl AS (SELECT run, sum(g) OVER (PARTITION BY run ORDER BY ts, frame) AS cluster, ts FROM sh),
ev AS (SELECT r.session, r.run, r.mode, cluster, min(ts) AS s, max(ts) AS x FROM cl JOIN rn r USING (run) WHERE mode = 'ffc' GROUP BY ALL),
rg AS (SELECT unnest(['target', 'control']) AS region),
er AS (SELECT ev.*, region, (SELECT CAST(floor(median(level)) AS BIGINT) FROM l WHERE l.run = ev.run AND l.region = rg.region AND ts BETWEEN s - 30000000000 AND s - 1) AS a,
  (SELECT CAST(floor(median(level)) AS BIGINT) FROM l WHERE l.run = ev.run AND l.region = rg.region AND ts BETWEEN x + 2000000000 AND x + 32000000000) AS b FROM ev, rg),
wn AS (SELECT run, mode, ts // 100000000000 AS c, min(ts) AS lo, max(ts) AS hi FROM (SELECT trial AS run, ts FROM st) JOIN rn USING (run) WHERE mode <> 'ffc' GROUP BY ALL),
wi AS (SELECT run, CASE WHEN mode = 'restart' THEN CASE WHEN c = 1 AND run % 3 <> 0 THEN 'stable' ELSE 'other_' || c END ELSE ['baseline', 'hot_hand', 'recovery'][c % 3 + 1] || '_' || c // 3 END AS phase, lo, hi FROM wn),
me AS (SELECT l.session, l.run, l.mode, region, phase, CAST(floor(median(level)) AS BIGINT) AS m FROM l JOIN wi ON wi.run = l.run AND ts BETWEEN lo AND hi WHERE l.mode <> 'ffc' GROUP BY ALL),
sa AS (SELECT * FROM me WHERE mode = 'restart' AND phase = 'stable'),
rf AS (SELECT session, region, arg_min(m, run) AS ref, min(run) AS first FROM sa GROUP BY ALL),
cy AS (SELECT session, run, mode, region, regexp_extract(phase, '_([0-9]+)$', 1) AS cycle, max(m) FILTER (phase LIKE 'baseline%') AS b, max(m) FILTER (phase LIKE 'hot%') AS h, max(m) FILTER (phase LIKE 'recovery%') AS r
  FROM me WHERE mode = 'dynamic' GROUP BY ALL)
SELECT session, run, mode, NULL AS region, 'display' AS part, NULL AS name, CAST(NULL AS DOUBLE) AS value, CASE WHEN mode = 'other' THEN 'mode_invalid' ELSE issue END AS issue FROM rn LEFT JOIN di USING (run)
UNION ALL SELECT session, run, mode, region, 'ffc_event', CAST(CAST(cluster AS BIGINT) AS VARCHAR), b - a, CASE WHEN a IS NULL THEN 'pre_window_empty' WHEN b IS NULL THEN 'post_window_empty' END FROM er
UNION ALL SELECT rn.session, rn.run, rn.mode, rg.region, 'stable', 'stable', m, CASE WHEN m IS NULL THEN 'stable_phase_missing' END FROM rn CROSS JOIN rg LEFT JOIN sa ON sa.run = rn.run AND sa.region = rg.region WHERE rn.mode = 'restart'
UNION ALL SELECT sa.session, run, mode, sa.region, 'restart_offset', CAST(first AS VARCHAR), m - ref, NULL FROM sa JOIN rf ON rf.session = sa.session AND rf.region = sa.region
UNION ALL SELECT session, run, mode, region, 'phase', phase, m, NULL FROM me WHERE mode = 'dynamic'
UNION ALL SELECT session, run, mode, region, 'hot_minus_baseline', cycle, h - b, CASE WHEN h IS NULL OR r IS NULL THEN 'cycle_incomplete' END FROM cy WHERE b IS NOT NULL
UNION ALL SELECT session, run, mode, region, 'recovery_minus_baseline', cycle, r - b, CASE WHEN h IS NULL OR r IS NULL THEN 'cycle_incomplete' END FROM cy WHERE b IS NOT NULL"""
    )


@query("session_report", _report_sql())
def session_report(spark, root):
    """Shutter, restart and dynamic runs of repeatability sessions, each analysed by its mode, with its display contract."""
    run, frame = F.col("run"), F.col("frame")
    fixed = run % 4 == 3
    raw = _raw(spark, root).withColumnRenamed("trial", "run").withColumns(
        {
            "display_mode": F.when(fixed | ((run % 4 == 1) & (frame % 40 > 36)), "fixed_raw_counts").otherwise("dynamic_per_frame_min_max"),
            "raw_low": F.when(fixed, 2900), "raw_high": F.when(fixed, F.when(frame % 50 > 45, 3000).otherwise(3100)),
        }
    )
    modes = F.array(*[F.lit(m) for m in ("ffc", "restart", "dynamic", "restart", "dynamic", "other")])
    runs = raw.select("run").distinct().select(
        F.floor(run / 5).cast("int").alias("session"), "run", F.get(modes, run % 6).alias("mode"),
        F.when(fixed, "fixed").otherwise("dynamic").alias("display"), F.when(fixed, 2900).alias("low"), F.when(fixed, 3100).alias("high"),
    )
    part = F.floor(F.col("ts_ns") / (100 * _SECOND))
    names = F.array(*[F.lit(n) for n in ("baseline", "hot_hand", "recovery")])
    cycle = F.concat_ws("_", F.get(names, (F.col("c") % 3).cast("int")), F.floor(F.col("c") / 3).cast("string"))
    restart = F.when((F.col("c") == 1) & (run % 3 != 0), "stable").otherwise(F.concat(F.lit("other_"), F.col("c").cast("string")))
    spans = raw.join(runs.select("run", "mode"), "run").where("mode <> 'ffc'").groupBy("run", "mode", part.alias("c")).agg(F.min("ts_ns").alias("start"), F.max("ts_ns").alias("end"))
    windows = spans.select("run", F.when(F.col("mode") == "restart", restart).otherwise(cycle).alias("phase"), "start", "end")
    return repeatability.session_report(
        raw, runs, windows, {"target": REGION, "control": (0, 0, 3, 8)}, window_ns=30 * _SECOND, delay_ns=2 * _SECOND, gap_ns=20 * _SECOND
    )
