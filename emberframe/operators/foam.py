"""Compression recordings: step summaries, calibration distance, preflight, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions import arrays
from emberframe.functions.numbers import all_reasons, is_finite
from emberframe.operators.joins import frame_join, without_invalid_actions
from emberframe.operators.ordered import Series, previous, scan
from emberframe.operators.quantiles import exact_quantiles
from emberframe.operators.settle import settle
from emberframe.operators.statistics import spearman
from emberframe.operators.windows import final_window, first_per_content, missing_runs

ACTION = ["trial", "block", "sequence_id", "step_index", "state", "action_attempt"]


def usable_frames(telemetry: DataFrame, features: DataFrame, events: DataFrame, primary: str) -> DataFrame:
    """Stable-hold frames that count: features joined by frame, the last duplicate winning;
    invalid actions, frozen frames, lost markers and repeated frame contents removed.

    The first frame of each content is kept after all other filters.
    """
    joined = frame_join(telemetry, features, ["trial", "frame"], F.col("feature_row"))
    kept = without_invalid_actions(joined.filter(F.col("phase") == "stable_hold"), events, ACTION)
    whole = (
        ~F.coalesce(F.col("frozen_frame_flag"), F.lit(False))
        & F.coalesce(F.col("marker_detected"), F.lit(False))
        & F.col("content").isNotNull() & (F.col("content") != "")
        & is_finite(F.col("compression_pct")) & is_finite(F.col(primary)) & is_finite(F.col("step_elapsed_s"))
    )
    return first_per_content(kept.filter(whole), ["trial"], "content", ["frame"])


def step_summary(frames: DataFrame, columns: list[str], *, stable_window_s: float = 3.0) -> DataFrame:
    """Means over the last stretch of every action."""
    steady = final_window(frames, ACTION, "step_elapsed_s", stable_window_s)
    known = lambda c: F.avg(F.when(is_finite(F.col(c)), F.col(c))).alias(c)
    return steady.groupBy(*ACTION).agg(
        F.count(F.lit(1)).alias("frame_count"), *[known(c) for c in ("compression_pct", *columns)]
    )


def compression_relation(steps: DataFrame, primary: str) -> DataFrame:
    """Per trial: rank correlation of compression and signal, and the C30 - C0 difference.

    The steps are written first: ranks are joined by value, and a mean computed again from blocks fetched in
    another order may differ in its last bit and would find no rank.
    """
    steps = settle(steps)
    at = lambda state: F.avg(F.when(F.col("state") == state, F.col(primary)))
    levels = steps.groupBy("trial").agg(
        F.count(F.lit(1)).alias("steps"), (at("C30") - at("C0")).alias("c30_minus_c0")
    )
    finite = steps.filter(is_finite(F.col(primary)))
    rank = spearman(finite, ["trial"], ACTION[1:], "compression_pct", primary)
    enough = F.col("n") >= 3
    nan = F.lit(float("nan"))
    return levels.join(rank, "trial", "left").select(
        "trial", "steps", "c30_minus_c0",
        F.when(enough, F.col("rho")).otherwise(nan).alias("rho"),
        F.when(enough, F.col("p_value")).otherwise(nan).alias("p_value"),
    )


def released_distance(
    samples: DataFrame, keys: list[str], *, settle_s: float, expected: Column, max_span: float
) -> DataFrame:
    """Reference marker distance: median after settling, if enough samples and steady.

    ``samples`` has elapsed_s and distance_px; ``expected`` is the sample count a
    complete calibration would give.
    """
    settled = samples.filter((F.col("elapsed_s") >= settle_s) & F.col("distance_px").isNotNull())
    counts = settled.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    levels = exact_quantiles(settled, keys, "distance_px", {"p5": 0.05, "d0_px": 0.5, "p95": 0.95})
    span = F.when(F.col("d0_px") > 0, F.try_divide(F.col("p95") - F.col("p5"), F.col("d0_px"))).otherwise(
        F.lit(float("inf"))
    )
    out = counts.join(levels, keys).withColumn("relative_span", span)
    issues = all_reasons(
        (F.col("samples") < expected * 0.9, "too_few_samples"), (F.col("relative_span") > max_span, "unstable")
    )
    return out.withColumn("issues", issues).drop("p5", "p95")


def preflight_report(
    detections: DataFrame, references: DataFrame, keys: list[str], *,
    settle_s: float = 0.0, min_rate: float = 0.95, max_missing_s: float = 0.5, min_span: float = 5.0,
    max_saturated: float = 0.10,
) -> DataFrame:
    """Marker rate, longest loss, reference span and saturation per key, as one issue list.

    ``detections`` has elapsed_s, frame and detected; ``references`` one row per key
    with reference_span and saturated_fraction.
    """
    series = Series(tuple(keys), ("elapsed_s", "frame"))
    seen = missing_runs(detections.filter(F.col("elapsed_s") >= settle_s), series, "elapsed_s", "detected")
    joined = seen.join(references, keys, "left").withColumn(
        "marker_rate", F.try_divide(F.col("detected"), F.col("evaluated"))
    )
    span = F.abs("reference_span")
    issues = all_reasons(
        (F.col("marker_rate") < min_rate, "marker_rate_low"),
        (F.col("longest_missing_s") > max_missing_s, "marker_lost_too_long"),
        (~F.coalesce(span >= min_span, F.lit(False)), "reference_span_small"),
        (F.col("saturated_fraction") > max_saturated, "reference_saturated"),
    )
    return joined.withColumn("issues", issues)


def representative_frames(frames: DataFrame, cases: DataFrame, on: list[str]) -> DataFrame:
    """The last valid stable frame of every declared case; a case without one says so."""
    last = frames.groupBy(*on).agg(
        F.max_by("frame", F.struct("step_elapsed_s", "frame")).alias("frame"),
        F.max("step_elapsed_s").alias("step_elapsed_s"),
    )
    joined = cases.join(last, on, "left")
    return joined.withColumn("issue", F.when(F.col("frame").isNull(), "case_missing"))


def round_summary(rows: DataFrame, keys: list[str], *, min_frames: int = 20) -> DataFrame:
    """Light-hard-light round: phase medians, effect, recovery ratio and validity."""
    phases = ("LIGHT_A", "HARD", "LIGHT_B")
    counts = rows.groupBy(*keys).agg(
        *[F.count(F.when(F.col("phase") == p, F.col("signal"))).alias(f"n_{p.lower()}") for p in phases]
    )
    medians = exact_quantiles(rows, [*keys, "phase"], "signal", {"m": 0.5})
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("phase") == p, F.col("m"))).alias(f"median_{p.lower()}") for p in phases]
    )
    joined = counts.join(wide, keys, "left")
    a, hard, b = (F.col(f"median_{p.lower()}") for p in phases)
    recovery = F.when(hard != a, F.try_divide(F.abs(b - a), F.abs(hard - a)))
    full = F.lit(True)
    for p in phases:
        full = full & (F.col(f"n_{p.lower()}") >= min_frames)
    effect = hard - (a + b) / 2
    return joined.withColumns(
        {"aba_effect": effect, "recovery_ratio": recovery, "valid": full & effect.isNotNull()}
    )


def round_diagnostics(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Share of frames that ask for a shutter, drift of the frame level, shift per phase."""
    at = F.struct(*order)
    base = rows.groupBy(*keys).agg(
        F.avg(F.when(F.col("ffc_desired"), 1.0).otherwise(0.0)).alias("ffc_desired_fraction"),
        (F.max_by("frame_level", at) - F.min_by("frame_level", at)).alias("frame_level_drift"),
    )
    shifts = exact_quantiles(rows, [*keys, "phase"], "shift_px", {"m": 0.5})
    wide = shifts.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("phase") == p, F.col("m"))).alias(f"shift_{p.lower()}")
            for p in ("LIGHT_A", "HARD", "LIGHT_B")
        ]
    )
    return base.join(wide, keys, "left")


def reason_histogram(rows: DataFrame, keys: list[str], reasons: str) -> DataFrame:
    """How often each reason occurs."""
    return rows.select(*keys, F.explode(reasons).alias("reason")).groupBy(*keys, "reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def attempt_accounting(rows: DataFrame, series: Series, depth_frame: str, status: str, *, rows_per_chunk: int | None = None) -> DataFrame:
    """Frame events, re-used depth frames, fresh attempts, and how they ended."""
    back = scan(rows, series, {"_d": previous(F.col(depth_frame))}, rows_per_chunk=rows_per_chunk)
    fresh = F.col("_d").isNull() | (F.col("_d") != F.col(depth_frame))
    count = lambda c: F.count(F.when(c, 1))
    return back.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("frame_events"),
        count(~fresh).alias("reused_depth_frames"),
        count(fresh).alias("fresh_attempts"),
        count(fresh & (F.col(status) == "accepted")).alias("accepted"),
        count(fresh & (F.col(status) != "accepted")).alias("blocked"),
    )


def comparable_scale(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Display bounds p1/p99 of the first accepted touch frame, else of the first frame."""
    priority = F.struct(F.when(F.col("accepted_touch"), 0).otherwise(1).alias("p"), *order)
    first = frames.groupBy(*keys).agg(
        F.min_by(F.struct("frame", "pixels"), priority).alias("_f"),
        F.count(F.lit(1)).alias("frames"),
        F.count(F.when(F.col("accepted_touch"), 1)).alias("touch_frames"),
    )
    ordered = first.withColumn("_s", F.array_sort("_f.pixels"))
    return ordered.select(
        *keys, "frames", "touch_frames", F.col("_f.frame").alias("scale_frame"),
        arrays.quantile(F.col("_s"), 0.01).alias("low"), arrays.quantile(F.col("_s"), 0.99).alias("high"),
    )
