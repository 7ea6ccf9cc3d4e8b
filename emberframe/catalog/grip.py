"""Grip-recording summaries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import EVENT_SERIES, q, telemetry, with_telemetry
from emberframe.catalog.registry import query
from emberframe.operators import summaries


def _recording(spark, root):
    return telemetry(spark, root).select(
        "trial", "t_us", "frame", "phase",
        F.col("counter").alias("t_capture"),
        (F.col("counter") * 5).cast("double").alias("area_px"),
        F.col("signal").alias("mean_delta"),
        F.col("signal").alias("max_delta"),
        (F.col("signal") * 2).alias("present_load"),
        F.col("signal").alias("present_current"),
        (F.col("counter") / 100).alias("gripper_pos"),
    )


_RECORDING = """,
rec AS (
  SELECT trial, t_us, frame, phase, counter AS t_capture, CAST(counter * 5 AS DOUBLE) AS area_px,
         signal AS mean_delta, signal AS max_delta, signal * 2 AS present_load,
         signal AS present_current, counter / 100 AS gripper_pos
  FROM ev
), marked AS (
  SELECT *, CASE WHEN t_capture < lag(t_capture) OVER (PARTITION BY trial ORDER BY t_us, frame)
                 THEN 1 ELSE 0 END AS fell FROM rec
), win AS (
  SELECT *, sum(fell) OVER (PARTITION BY trial ORDER BY t_us, frame) AS w,
         row_number() OVER (PARTITION BY trial ORDER BY t_us, frame) AS rn FROM marked
)"""


@query(
    "capture_windows",
    with_telemetry(
        _RECORDING
        + """
SELECT trial, CAST(w AS BIGINT) AS "window", min(rn) - 1 AS "start", max(rn) AS stop
FROM win GROUP BY trial, w"""
    ),
)
def capture_windows(spark, root):
    return summaries.window_bounds(_recording(spark, root), EVENT_SERIES, "t_capture")


_MEASURES = {
    "frame_count": "CAST(count(*) AS DOUBLE)",
    "area_px_mean": "avg(area_px)",
    "mean_delta_mean": "avg(mean_delta)",
    "max_delta_max": "max(max_delta)",
    "present_load_max": "max(present_load)",
    "present_current_max": "max(present_current)",
}


def _window_summary_sql() -> str:
    per_window = ", ".join(f"{sql} AS {n}" for n, sql in _MEASURES.items())
    out = ["b.trial AS trial"]
    for n in _MEASURES:
        out.append(f"round(b.{n}, 6) AS baseline_{n}")
        out.append(f"round(coalesce(h.{n}, b.{n}), 6) AS hold_{n}")
        if n != "frame_count":
            out.append(f"round(coalesce(h.{n}, b.{n}) - b.{n}, 6) AS change_{n}")
    return with_telemetry(
        f"""{_RECORDING}, agg AS (SELECT trial, w, {per_window} FROM win WHERE w <= 1 GROUP BY trial, w)
SELECT {', '.join(out)} FROM agg b LEFT JOIN agg h ON h.trial = b.trial AND h.w = 1 WHERE b.w = 0"""
    )


@query("window_summary", _window_summary_sql())
def window_summary(spark, root):
    wide = summaries.window_summary(_recording(spark, root), EVENT_SERIES, "t_capture")
    return wide.select("trial", *[q(c).alias(c) for c in wide.columns if c != "trial"])


_PAIRS = f"""{_RECORDING}, agg AS (
  SELECT trial, w, count(*) AS n, avg(area_px) AS area, avg(mean_delta) AS md, max(max_delta) AS xd,
         max(present_load) AS lp, max(present_current) AS cp,
         arg_max(present_load, rn) AS lf, arg_max(present_current, rn) AS cf, avg(gripper_pos) AS g
  FROM win GROUP BY trial, w
), pairs AS (
  SELECT b.trial, CAST(b.w // 2 AS BIGINT) AS pair_index, b.n AS baseline_rows, h.n AS hold_rows,
         b.area AS baseline_area_px, h.area AS hold_area_px, h.area - b.area AS area_delta_px,
         b.md AS baseline_mean_delta, h.md AS hold_mean_delta, h.xd AS hold_max_delta,
         h.lp AS hold_load_peak, h.cp AS hold_current_peak, h.lf AS hold_load_final,
         h.cf AS hold_current_final, h.g AS hold_gripper_mean
  FROM agg b JOIN agg h ON h.trial = b.trial AND h.w = b.w + 1 WHERE b.w % 2 = 0
)"""
_PAIR_NUMBERS = (
    "baseline_area_px", "hold_area_px", "area_delta_px", "baseline_mean_delta", "hold_mean_delta",
    "hold_max_delta", "hold_load_peak", "hold_current_peak", "hold_load_final",
    "hold_current_final", "hold_gripper_mean",
)


@query(
    "window_pairs",
    with_telemetry(
        _PAIRS
        + f"""
SELECT trial, pair_index, baseline_rows, hold_rows,
       {', '.join(f'round({c}, 6) AS {c}' for c in _PAIR_NUMBERS)},
       concat_ws('|', CASE WHEN area_delta_px < 0 THEN 'area_collapsed' END,
                 CASE WHEN baseline_area_px >= 500 THEN 'large_baseline_mask' END,
                 CASE WHEN hold_area_px < 100 THEN 'weak_hold_mask' END,
                 CASE WHEN area_delta_px < 0 AND hold_load_peak >= 300
                      THEN 'force_spike_without_contact_area' END) AS flags
FROM pairs"""
    ),
)
def window_pairs(spark, root):
    pairs = summaries.window_pairs(_recording(spark, root), EVENT_SERIES, "t_capture")
    return pairs.select(
        "trial", "pair_index", "baseline_rows", "hold_rows", "flags",
        *[q(F.col(c)).alias(c) for c in _PAIR_NUMBERS],
    )


@query(
    "level_comparison",
    with_telemetry(
        _PAIRS
        + """, lp AS (
  SELECT trial // 4 AS object_id,
         CASE trial % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'med' WHEN 2 THEN 'high' ELSE 'xhigh' END AS level,
         * FROM pairs QUALIFY row_number() OVER (PARTITION BY trial ORDER BY pair_index DESC) = 1
), vis AS (SELECT trial, count(CASE WHEN phase = 'view' THEN 1 END) AS visible FROM ev GROUP BY trial
), wide AS (
  SELECT object_id,
    max(CASE WHEN level = 'high' THEN area_delta_px END) AS high_delta,
    max(CASE WHEN level = 'xhigh' THEN area_delta_px END) AS xhigh_delta,
    max(CASE WHEN level = 'high' THEN baseline_area_px END) AS high_baseline,
    max(CASE WHEN level = 'xhigh' THEN baseline_area_px END) AS xhigh_baseline,
    CAST(sum(visible) AS BIGINT) AS visible_frames
  FROM lp JOIN vis USING (trial) GROUP BY object_id
)
SELECT object_id, round(high_delta, 6) AS high_delta, round(xhigh_delta, 6) AS xhigh_delta,
       round(high_baseline, 6) AS high_baseline, round(xhigh_baseline, 6) AS xhigh_baseline,
       visible_frames,
       concat_ws('|', CASE WHEN xhigh_delta < 0 AND high_delta >= 0 THEN 'xhigh_contact_collapse' END,
         CASE WHEN xhigh_delta IS NOT NULL AND xhigh_baseline > greatest(high_baseline * 3, 500)
              THEN 'xhigh_baseline_mask_large' END,
         CASE WHEN visible_frames = 0 THEN 'no_visible_frames' END) AS diagnosis
FROM wide"""
    ),
)
def level_comparison(spark, root):
    recording = _recording(spark, root)
    pairs = summaries.window_pairs(recording, EVENT_SERIES, "t_capture")
    visible = recording.groupBy("trial").agg(
        F.count(F.when(F.col("phase") == "view", 1)).alias("visible_frames")
    )
    levels = F.array(*[F.lit(v) for v in ("low", "med", "high", "xhigh")])
    latest = (
        summaries.latest_pair(pairs, ["trial"])
        .join(visible, "trial")
        .withColumns(
            {
                "object_id": F.floor(F.col("trial") / 4),
                "level": F.get(levels, (F.col("trial") % 4).cast("int")),
            }
        )
    )
    wide = summaries.level_comparison(latest, ["object_id"])
    numbers = ("high_delta", "xhigh_delta", "high_baseline", "xhigh_baseline")
    return wide.select(
        "object_id", *[q(F.col(c)).alias(c) for c in numbers], "visible_frames", "diagnosis"
    )


_TRIALS = f"""{_RECORDING}, sized AS (
  SELECT *, count(*) OVER (PARTITION BY trial) AS n FROM win
), summ AS (
  SELECT trial, max(present_current) AS peak_current,
         avg(CASE WHEN rn - 1 >= floor(n * 0.5) THEN area_px END) AS hold_mean_area_px,
         avg(CASE WHEN rn - 1 >= floor(n * 0.5) THEN mean_delta END) AS hold_mean_delta,
         max(CASE WHEN rn - 1 >= floor(n * 0.5) THEN max_delta END) AS hold_max_delta
  FROM sized GROUP BY trial
)"""


@query(
    "trial_summary",
    with_telemetry(
        _TRIALS
        + """
SELECT trial, round(peak_current, 6) AS peak_current, round(hold_mean_area_px, 6) AS hold_mean_area_px,
       round(hold_mean_delta, 6) AS hold_mean_delta, round(hold_max_delta, 6) AS hold_max_delta
FROM summ"""
    ),
)
def trial_summary(spark, root):
    out = summaries.trial_summary(_recording(spark, root), EVENT_SERIES)
    return out.select("trial", *[q(F.col(c)).alias(c) for c in out.columns if c != "trial"])


_LABELLED = """, lab AS (
  SELECT *, trial // 6 AS object_name, trial % 7 = 0 AS warmed,
         CASE WHEN trial % 2 = 0 THEN 'soft' ELSE 'solid' END AS hardness,
         CASE trial % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'med' ELSE 'high' END AS grip_level
  FROM summ
)"""


def _labelled(spark, root):
    out = summaries.trial_summary(_recording(spark, root), EVENT_SERIES)
    grip = F.array(F.lit("low"), F.lit("med"), F.lit("high"))
    return out.withColumns(
        {
            "object_name": F.floor(F.col("trial") / 6),
            "warmed": F.col("trial") % 7 == 0,
            "hardness": F.when(F.col("trial") % 2 == 0, F.lit("soft")).otherwise(F.lit("solid")),
            "grip_level": F.get(grip, (F.col("trial") % 3).cast("int")),
        }
    )


_MONO = """, lv AS (
  SELECT object_name,
    avg(CASE WHEN grip_level = 'low' THEN hold_mean_area_px END) AS low,
    avg(CASE WHEN grip_level = 'med' THEN hold_mean_area_px END) AS med,
    avg(CASE WHEN grip_level = 'high' THEN hold_mean_area_px END) AS high
  FROM lab WHERE NOT warmed GROUP BY object_name
), mono AS (
  SELECT *, low IS NOT NULL AND med IS NOT NULL AND high IS NOT NULL AS complete,
    CASE WHEN low IS NOT NULL AND med IS NOT NULL AND high IS NOT NULL THEN
      CASE WHEN med > low THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN high > med THEN 0.5::DOUBLE ELSE 0 END
    END AS monotonic_fraction FROM lv
)"""


@query(
    "monotonic_levels",
    with_telemetry(
        _TRIALS + _LABELLED + _MONO
        + """
SELECT object_name, round(low, 6) AS low, round(med, 6) AS med, round(high, 6) AS high, complete,
       monotonic_fraction FROM mono"""
    ),
)
def monotonic_levels(spark, root):
    out = summaries.monotonic_objects(_labelled(spark, root).filter(~F.col("warmed")))
    return out.select(
        "object_name", *[q(F.col(c)).alias(c) for c in ("low", "med", "high")],
        "complete", "monotonic_fraction",
    )


@query(
    "grip_decision",
    with_telemetry(
        _TRIALS + _LABELLED + _MONO
        + """, t AS (
  SELECT coalesce(bool_or(warmed AND hold_mean_area_px >= 25 AND hold_max_delta >= 10), false) AS ok,
    count(CASE WHEN NOT warmed THEN 1 END) AS n_passive_trials,
    count(CASE WHEN warmed THEN 1 END) AS n_warmed_trials,
    abs(avg(CASE WHEN NOT warmed AND hardness = 'soft' THEN hold_mean_area_px END)
      - avg(CASE WHEN NOT warmed AND hardness = 'solid' THEN hold_mean_area_px END))
      / stddev_pop(CASE WHEN NOT warmed THEN hold_mean_area_px END) AS effect,
    (SELECT count(*) FROM mono WHERE monotonic_fraction >= 1) AS monotonic_objects
  FROM lab
)
SELECT CASE WHEN ok AND (monotonic_objects >= 3 OR effect >= 0.8) THEN 'GO' ELSE 'NO-GO' END AS decision,
       ok AS warmed_sanity_passed, monotonic_objects, round(effect, 6) AS hardness_effect_size,
       n_passive_trials, n_warmed_trials FROM t"""
    ),
)
def grip_decision(spark, root):
    out = summaries.grip_decision(_labelled(spark, root))
    return out.withColumn("hardness_effect_size", q(F.col("hardness_effect_size")))
