"""Trial, window and level summaries of grip recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.numbers import all_reasons
from emberframe.operators.ordered import (
    Series,
    islands,
    previous,
    row_index,
    running_sum,
    scan,
    with_group_stats,
)

SUMMARY_FIELDS = ("area_px", "mean_delta", "max_delta", "present_load", "present_current")


def split_windows(
    df: DataFrame, series: Series, clock: str, *, rows_per_chunk: int | None = None
) -> DataFrame:
    """Number capture windows (``window``, from 0): a new one where ``clock`` falls."""
    fell = F.col("_before").isNotNull() & (F.col(clock) < F.col("_before"))
    return islands(
        df, series, fell, "window",
        carry={"_before": previous(F.col(clock))},
        rows_per_chunk=rows_per_chunk,
    ).drop("_before")


def window_bounds(df: DataFrame, series: Series, clock: str, *, rows_per_chunk: int | None = None) -> DataFrame:
    """Half-open row ranges ``[start, stop)`` of the capture windows, from row counts."""
    windows = split_windows(df, series, clock, rows_per_chunk=rows_per_chunk)
    sizes = windows.groupBy(*series.keys, "window").agg(F.count(F.lit(1)).alias("rows"))
    by_window = Series(series.keys, ("window",))
    bounds = scan(sizes, by_window, {"stop": running_sum(F.col("rows"))}, rows_per_chunk=rows_per_chunk)
    return bounds.select(
        *series.keys, "window", (F.col("stop") - F.col("rows")).alias("start"), "stop"
    )


def _window_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).cast("double").alias("frame_count"),
        F.avg("area_px").alias("area_px_mean"),
        F.avg("mean_delta").alias("mean_delta_mean"),
        F.max("max_delta").alias("max_delta_max"),
        F.max("present_load").alias("present_load_max"),
        F.max("present_current").alias("present_current_max"),
    ]


def window_summary(df: DataFrame, series: Series, clock: str, *, rows_per_chunk: int | None = None) -> DataFrame:
    """Baseline (window 0), hold (window 1, or 0 when alone) and their change per trial."""
    windows = split_windows(df, series, clock, rows_per_chunk=rows_per_chunk)
    keys = list(series.keys)
    per_window = (
        windows.filter(F.col("window") <= 1).groupBy(*keys, "window").agg(*_window_measures())
    )
    names = [c for c in per_window.columns if c not in (*keys, "window")]
    at = lambda name, w: F.max(F.when(F.col("window") == w, F.col(name)))
    wide = per_window.groupBy(*keys).agg(
        *[at(n, 0).alias(f"baseline_{n}") for n in names],
        *[F.coalesce(at(n, 1), at(n, 0)).alias(f"hold_{n}") for n in names],
    )
    changes = {
        f"change_{n}": F.col(f"hold_{n}") - F.col(f"baseline_{n}")
        for n in names
        if n != "frame_count"
    }
    return wide.withColumns(changes)


def window_pairs(df: DataFrame, series: Series, clock: str, *, rows_per_chunk: int | None = None) -> DataFrame:
    """Consecutive (baseline, hold) windows with peaks, finals and condition flags."""
    windows = split_windows(df, series, clock, rows_per_chunk=rows_per_chunk)
    keys = list(series.keys)
    last = series.position()
    per_window = windows.groupBy(*keys, "window").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("area_px").alias("area"),
        F.avg("mean_delta").alias("mean_delta"),
        F.max("max_delta").alias("max_delta"),
        F.max("present_load").alias("load_peak"),
        F.max("present_current").alias("current_peak"),
        F.max_by("present_load", last).alias("load_final"),
        F.max_by("present_current", last).alias("current_final"),
        F.avg("gripper_pos").alias("gripper_mean"),
    )
    pair = per_window.withColumns(
        {"pair_index": F.floor(F.col("window") / 2), "is_hold": F.col("window") % 2 == 1}
    )
    base = lambda n: F.max(F.when(~F.col("is_hold"), F.col(n)))
    hold = lambda n: F.max(F.when(F.col("is_hold"), F.col(n)))
    wide = (
        pair.groupBy(*keys, "pair_index")
        .agg(
            F.count(F.lit(1)).alias("_windows"),
            base("rows").alias("baseline_rows"),
            hold("rows").alias("hold_rows"),
            base("area").alias("baseline_area_px"),
            hold("area").alias("hold_area_px"),
            base("mean_delta").alias("baseline_mean_delta"),
            hold("mean_delta").alias("hold_mean_delta"),
            hold("max_delta").alias("hold_max_delta"),
            hold("load_peak").alias("hold_load_peak"),
            hold("current_peak").alias("hold_current_peak"),
            hold("load_final").alias("hold_load_final"),
            hold("current_final").alias("hold_current_final"),
            hold("gripper_mean").alias("hold_gripper_mean"),
        )
        .filter(F.col("_windows") == 2)
        .drop("_windows")
        .withColumn("area_delta_px", F.col("hold_area_px") - F.col("baseline_area_px"))
    )
    collapsed = F.col("area_delta_px") < 0
    return wide.withColumn(
        "flags",
        F.concat_ws(
            "|",
            all_reasons(
                (collapsed, "area_collapsed"),
                (F.col("baseline_area_px") >= 500, "large_baseline_mask"),
                (F.col("hold_area_px") < 100, "weak_hold_mask"),
                (collapsed & (F.col("hold_load_peak") >= 300), "force_spike_without_contact_area"),
            ),
        ),
    )


def latest_pair(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The last pair of each group."""
    fields = [c for c in pairs.columns if c not in keys]
    newest = F.max_by(F.struct(*fields), F.col("pair_index"))
    return pairs.groupBy(*keys).agg(newest.alias("_p")).select(*keys, "_p.*")


def level_comparison(latest: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """Compare the highest grip level with the one below and name what looks wrong.

    ``latest`` has one row per (keys, level) with ``baseline_area_px``,
    ``area_delta_px`` and ``visible_frames``.
    """
    at = lambda name, lv: F.max(F.when(F.col(level) == lv, F.col(name)))
    wide = latest.groupBy(*keys).agg(
        at("area_delta_px", "high").alias("high_delta"),
        at("area_delta_px", "xhigh").alias("xhigh_delta"),
        at("baseline_area_px", "high").alias("high_baseline"),
        at("baseline_area_px", "xhigh").alias("xhigh_baseline"),
        F.sum("visible_frames").alias("visible_frames"),
    )
    both = F.col("high_delta").isNotNull() & F.col("xhigh_delta").isNotNull()
    collapse = both & (F.col("xhigh_delta") < 0) & (F.col("high_delta") >= 0)
    mask_limit = F.greatest(F.col("high_baseline") * 3, F.lit(500.0))
    return wide.withColumn(
        "diagnosis",
        F.concat_ws(
            "|",
            all_reasons(
                (collapse, "xhigh_contact_collapse"),
                (both & (F.col("xhigh_baseline") > mask_limit), "xhigh_baseline_mask_large"),
                (F.col("visible_frames") == 0, "no_visible_frames"),
            ),
        ),
    )


def trial_summary(
    df: DataFrame, series: Series, *, hold_fraction: float = 0.5, rows_per_chunk: int | None = None
) -> DataFrame:
    """Peak current over the trial; area and deltas over its last part."""
    keys = list(series.keys)
    indexed = scan(df, series, {"_row": row_index()}, rows_per_chunk=rows_per_chunk)
    sized = with_group_stats(indexed, keys, {"_rows": F.count(F.lit(1))})
    held = (F.col("_row") - 1) >= F.floor(F.col("_rows") * F.lit(hold_fraction))
    return sized.groupBy(*keys).agg(
        F.max("present_current").alias("peak_current"),
        F.avg(F.when(held, F.col("area_px"))).alias("hold_mean_area_px"),
        F.avg(F.when(held, F.col("mean_delta"))).alias("hold_mean_delta"),
        F.max(F.when(held, F.col("max_delta"))).alias("hold_max_delta"),
    )


GRIP_LEVELS = ("low", "med", "high")


def monotonic_objects(summaries: DataFrame, value: str = "hold_mean_area_px") -> DataFrame:
    """Per object: mean per grip level and whether it rises low < med < high."""
    levels = summaries.groupBy("object_name").agg(
        *[F.avg(F.when(F.col("grip_level") == lv, F.col(value))).alias(lv) for lv in GRIP_LEVELS]
    )
    complete = F.col("low").isNotNull() & F.col("med").isNotNull() & F.col("high").isNotNull()
    rises = [(F.col("low"), F.col("med")), (F.col("med"), F.col("high"))]
    share = sum(F.when(b > a, 0.5).otherwise(0.0) for a, b in rises)
    return levels.withColumns(
        {
            "complete": complete,
            "monotonic_fraction": F.when(complete, share),
        }
    )


def grip_decision(summaries: DataFrame) -> DataFrame:
    """One row: GO when the warmed check holds and either level order or hardness separates.

    Needs object_name, hardness, grip_level, warmed, hold_mean_area_px and
    hold_max_delta per trial.
    """
    passive = summaries.filter(~F.col("warmed"))
    area = F.col("hold_mean_area_px")
    sane = F.col("warmed") & (area >= 25) & (F.col("hold_max_delta") >= 10)
    totals = summaries.agg(
        F.coalesce(F.bool_or(sane), F.lit(False)).alias("warmed_sanity_passed"),
        F.count(F.when(~F.col("warmed"), 1)).alias("n_passive_trials"),
        F.count(F.when(F.col("warmed"), 1)).alias("n_warmed_trials"),
    )
    mono = monotonic_objects(passive).agg(
        F.count(F.when(F.col("monotonic_fraction") >= 1.0, 1)).alias("monotonic_objects")
    )
    known = F.col("hardness").isin("soft", "solid")
    spread = F.stddev_pop(F.when(known, area))
    gap = F.abs(
        F.avg(F.when(F.col("hardness") == "soft", area))
        - F.avg(F.when(F.col("hardness") == "solid", area))
    )
    effect = passive.agg(
        F.coalesce(F.when(spread > 0, F.try_divide(gap, spread)), F.lit(0.0)).alias(
            "hardness_effect_size"
        )
    )
    # Three one-row frames: glued on a constant key.
    one = lambda d: d.withColumn("_one", F.lit(1))
    joined = one(totals).join(one(mono), "_one").join(one(effect), "_one").drop("_one")
    go = F.col("warmed_sanity_passed") & (
        (F.col("monotonic_objects") >= 3) | (F.col("hardness_effect_size") >= 0.8)
    )
    return joined.withColumn("decision", F.when(go, F.lit("GO")).otherwise(F.lit("NO-GO")))
