"""Look-back, smoothing, run and rank columns over sensor series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.joins import first_per_key
from emberframe.operators.keys import join_same
from emberframe.operators.ordered import (
    Series,
    following,
    islands,
    last_known,
    neighbours,
    next_known,
    previous,
    prior_max,
    row_index,
    running_sum,
    scan,
    with_group_stats,
)
from emberframe.operators.quantiles import exact_median


def rolling_median(
    df: DataFrame, series: Series, value: str, name: str, *, width: int = 5,
    keep_null_centre: bool = True, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Centred median of ``width`` rows, cut at the ends, nulls skipped.

    A null centre stays null, or takes its neighbours' median.
    """
    reach = width // 2

    def build(window):
        median = F.percentile(value, 0.5).over(window.rowsBetween(-reach, reach))
        return {name: F.when(F.col(value).isNotNull(), median) if keep_null_centre else median}

    return neighbours(df, series, reach, build, rows_per_chunk=rows_per_chunk)


def frozen_and_jump(
    df: DataFrame, series: Series, content: str, level: str, *, jump: float = 8.0,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Flags: same content as the row before; level moved by at least ``jump``."""
    back = scan(
        df, series,
        {"_content": previous(F.col(content)), "_level": previous(F.col(level))},
        rows_per_chunk=rows_per_chunk,
    )
    moved = F.abs(F.col(level) - F.col("_level")) >= jump
    return back.withColumns(
        {
            "frozen_frame_flag": F.coalesce(F.col(content) == F.col("_content"), F.lit(False)),
            "agc_jump_flag": F.coalesce(moved, F.lit(False)),
        }
    ).drop("_content", "_level")


def first_per_content(df: DataFrame, keys: list[str], content: str, order: list[str]) -> DataFrame:
    """Keep the first row of each content hash; combines map-side, so a hot hash is cheap."""
    return first_per_key(df, [*keys, content], F.struct(*order))


def final_window(df: DataFrame, keys: list[str], at: str, width: float) -> DataFrame:
    """Rows within ``width`` of the group's last time."""
    ends = with_group_stats(df, keys, {"_end": F.max(at)})
    return ends.filter(F.col(at) >= F.col("_end") - F.lit(width)).drop("_end")


def gap_clusters(
    df: DataFrame, series: Series, at: str, gap: float, *, rows_per_chunk: int | None = None
) -> DataFrame:
    """Number clusters (``cluster``, from 0); a gap above ``gap`` starts a new one."""
    starts = F.col("_at").isNotNull() & (F.col(at) - F.col("_at") > gap)
    return islands(
        df, series, starts, "cluster", carry={"_at": previous(F.col(at))},
        rows_per_chunk=rows_per_chunk,
    ).drop("_at")


def onset(df: DataFrame, keys: list[str], index: str, value: str, threshold: Column) -> DataFrame:
    """First index above the threshold per group, null when none."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(value) > threshold, F.col(index))).alias("onset"))


def average_rank(
    df: DataFrame, keys: list[str], value: str, name: str = "rank", *, rows_per_chunk: int | None = None
) -> DataFrame:
    """0-based rank where ties share their mean rank.

    Ranks come from counts of equal values, so only distinct values are ordered
    and a heavily tied value is one row. A null value has no rank and counts for none.
    The rows are read twice and meet by value: settle sums and means of fractions before.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    by_value = Series(tuple(keys), (value,))
    ranked = scan(counted, by_value, {"_upto": running_sum(F.col("_n"))}, rows_per_chunk=rows_per_chunk)
    rank = (F.col("_upto") - F.col("_n")) + (F.col("_n") - 1) / 2
    return join_same(df, ranked.select(*keys, value, rank.alias(name)), [*keys, value], "left")


def interpolate_missing(
    df: DataFrame, series: Series, position: str, value: str, name: str, *,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Fill null values on the line between known neighbours, flat outside them."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    both = scan(
        df, series, {"_left": last_known(known), "_right": next_known(known)},
        rows_per_chunk=rows_per_chunk,
    )
    left, right = F.col("_left"), F.col("_right")
    share = F.try_divide(F.col(position) - left["p"], (right["p"] - left["p"]).cast("double"))
    between = left["v"] + (right["v"] - left["v"]) * share
    filled = F.coalesce(F.col(value), between, left["v"], right["v"])
    return both.withColumn(name, filled).drop("_left", "_right")


def timestamp_faults(
    df: DataFrame, series: Series, at: str, max_gap: float, *, rows_per_chunk: int | None = None
) -> DataFrame:
    """Rows with a gap above ``max_gap`` or a time that does not increase."""
    back = scan(df, series, {"_at": previous(F.col(at))}, rows_per_chunk=rows_per_chunk)
    step = F.col(at) - F.col("_at")
    return back.withColumns(
        {
            "gap_fault": F.coalesce(step > max_gap, F.lit(False)),
            "order_fault": F.coalesce(step <= 0, F.lit(False)),
        }
    ).drop("_at")


def counter_faults(
    df: DataFrame, series: Series, counters: list[str], *, rows_per_chunk: int | None = None
) -> DataFrame:
    """Per counter: not above the highest value seen before (null counters are skipped)."""
    marks = scan(
        df, series, {f"_high_{c}": prior_max(F.col(c)) for c in counters},
        rows_per_chunk=rows_per_chunk,
    )
    return marks.withColumns(
        {
            f"{c}_non_increasing": F.coalesce(F.col(c) <= F.col(f"_high_{c}"), F.lit(False))
            for c in counters
        }
    ).drop(*[f"_high_{c}" for c in counters])


def repeat_counter(
    df: DataFrame, series: Series, content: str, *, limit: int = 5, rows_per_chunk: int | None = None
) -> DataFrame:
    """How often the content has just repeated (0 on a new one) and whether it is stuck."""
    changed = F.col("_content").isNull() | (F.col("_content") != F.col(content))
    runs = islands(
        df, series, changed, "_run", carry={"_content": previous(F.col(content))},
        rows_per_chunk=rows_per_chunk,
    ).drop("_content")
    indexed = scan(
        runs, Series((*series.keys, "_run"), series.order), {"_nth": row_index()},
        rows_per_chunk=rows_per_chunk,
    )
    return indexed.withColumns(
        {"repeats": F.col("_nth") - 1, "stuck": F.col("_nth") - 1 > limit}
    ).drop("_run", "_nth")


def interval_stats(
    df: DataFrame, series: Series, at: str, *, rows_per_chunk: int | None = None
) -> DataFrame:
    """Frame interval summary and frame rate per key."""
    keys = list(series.keys)
    steps = scan(df, series, {"_at": previous(F.col(at))}, rows_per_chunk=rows_per_chunk)
    steps = steps.withColumn("_step", F.col(at) - F.col("_at"))
    totals = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.min("_step").alias("interval_min"),
        F.max("_step").alias("interval_max"),
        F.avg("_step").alias("interval_mean"),
        F.stddev_pop("_step").alias("interval_stdev"),
        (F.max(at) - F.min(at)).alias("duration"),
    )
    fps = F.when(
        F.col("duration") > 0, F.try_divide((F.col("frame_count") - 1).cast("double"), F.col("duration"))
    )
    medians = exact_median(steps, keys, "_step", "interval_median")
    return totals.withColumn("observed_fps", fps).join(medians, keys, "left")


def missing_runs(
    df: DataFrame, series: Series, at: str, detected: str, end: Column | None = None, *,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Samples, detections and the longest undetected stretch per key.

    A stretch runs from its first missing sample to the next detection, or to
    ``end`` (per key, defaults to the last sample) when none follows.
    """
    keys = list(series.keys)
    changed = F.col("_seen").isNull() | (F.col("_seen") != F.col(detected))
    runs = islands(
        df, series, changed, "_run", carry={"_seen": previous(F.col(detected))},
        rows_per_chunk=rows_per_chunk,
    )
    per_run = runs.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(at).alias("begin"),
        F.max(at).alias("last"),
        F.bool_or(detected).alias("seen"),
    )
    by_run = Series(series.keys, ("_run",))
    ended = scan(per_run, by_run, {"_next": following(F.col("begin"))}, rows_per_chunk=rows_per_chunk)
    stop = F.coalesce(F.col("_next"), end if end is not None else F.col("last"))
    missing = F.when(~F.col("seen"), stop - F.col("begin"))
    return ended.groupBy(*keys).agg(
        F.sum("n").alias("evaluated"),
        F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0)).alias("detected"),
        F.coalesce(F.max(missing), F.lit(0.0)).alias("longest_missing_s"),
    )


def attempt_faults(
    df: DataFrame, series: Series, slot: str, attempt: str, completed: Column, *,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Ledger order: the slot each row must have, and the attempt number within it.

    The expected slot is one more than the completed rows before it; the expected
    attempt is one more than the rows already recorded for that slot.
    """
    done = F.when(completed, 1).otherwise(0).cast("long")
    placed = scan(df, series, {"_done": running_sum(done)}, rows_per_chunk=rows_per_chunk)
    expected = placed.withColumn("expected_slot", F.col("_done") - done + 1)
    within = Series((*series.keys, slot), series.order)
    numbered = scan(expected, within, {"expected_attempt": row_index()}, rows_per_chunk=rows_per_chunk)
    return numbered.withColumns(
        {
            "slot_out_of_order": F.col(slot) != F.col("expected_slot"),
            "attempt_mismatch": F.col(attempt) != F.col("expected_attempt"),
        }
    ).drop("_done")


def first_k_valid(df: DataFrame, series: Series, valid: Column, k: int) -> DataFrame:
    """Valid rows while fewer than ``k`` valid ones came before."""
    flag = F.when(valid, 1).otherwise(0).cast("long")
    counted = scan(df, series, {"_valid": running_sum(flag)})
    return counted.filter(valid & (F.col("_valid") <= k)).drop("_valid")


def nearest_row(df: DataFrame, keys: list[str], distance: Column, tie: list[str]) -> DataFrame:
    """The row with the smallest distance per group."""
    fields = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*fields), F.struct(distance.alias("_d"), *tie))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


