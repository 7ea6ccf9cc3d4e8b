"""Stable, hold and hysteresis gates over recorded samples (the batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.numbers import is_finite
from emberframe.operators.ordered import (
    Series,
    islands,
    last_known,
    previous,
    running_sum,
    scan,
)


def in_tolerance(value: Column, target: Column | float, tolerance: Column | float) -> Column:
    target = target if isinstance(target, Column) else F.lit(target)
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    return F.coalesce(F.abs(value - target) <= tolerance, F.lit(False))


def _run_starts(
    df: DataFrame, series: Series, flag: Column, at: str, rows_per_chunk: int | None
) -> DataFrame:
    """Per row: the time at which its run of equal ``flag`` began (``_since``)."""
    flagged = df.withColumn("_in", flag)
    marked = scan(flagged, series, {"_was": previous(F.col("_in"))}, rows_per_chunk=rows_per_chunk)
    begins = F.col("_was").isNull() | (F.col("_was") != F.col("_in"))
    begun = marked.withColumn("_begin", F.when(begins, F.col(at))).drop("_was")
    return scan(begun, series, {"_since": last_known(F.col("_begin"))}, rows_per_chunk=rows_per_chunk).drop(
        "_begin"
    )


def stable_gate(
    df: DataFrame, series: Series, at: str, value: str, *, target, tolerance, required_s: float,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """``stable_s`` in tolerance without a break, and whether that is long enough.

    The first in-tolerance sample only arms the gate.
    """
    runs = _run_starts(df, series, in_tolerance(F.col(value), target, tolerance), at, rows_per_chunk)
    held = F.when(F.col("_in"), F.greatest(F.col(at) - F.col("_since"), F.lit(0.0))).otherwise(F.lit(0.0))
    armed = F.col("_in") & (F.col(at) != F.col("_since"))
    return runs.withColumns(
        {"stable_s": held, "gate_open": armed & (held >= required_s)}
    ).drop("_in", "_since")


def hold_gate(
    df: DataFrame, series: Series, at: str, value: str, *, target, tolerance, max_gap_s: float,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """True while in tolerance, and through an outlier stretch of up to ``max_gap_s``."""
    runs = _run_starts(df, series, in_tolerance(F.col(value), target, tolerance), at, rows_per_chunk)
    out_for = F.col(at) - F.col("_since")
    return runs.withColumn("hold_ok", F.col("_in") | (out_for <= max_gap_s)).drop("_in", "_since")


def hysteresis(
    df: DataFrame, series: Series, value: str, name: str, *, enter: float, leave: float,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Active once ``value`` falls to ``enter`` until it rises to ``leave``."""
    verdict = F.when(F.col(value) <= enter, F.lit(True)).when(F.col(value) >= leave, F.lit(False))
    known = scan(df, series, {name: last_known(verdict)}, rows_per_chunk=rows_per_chunk)
    return known.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def cycle_count(
    df: DataFrame, series: Series, value: str, *, close: float, reopen: float,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Complete open, closed, open cycles so far (``cycles``).

    Only clear samples count (at or beyond a threshold). A cycle ends on the
    opening that follows a closing, and closings before the first opening are
    ignored.
    """
    clear = F.when(F.col(value) >= reopen, F.lit("open")).when(F.col(value) <= close, F.lit("closed"))
    marked = df.withColumn("_mark", clear)
    state = scan(
        marked, series,
        {
            "_opened": running_sum(F.when(F.col("_mark") == "open", 1).otherwise(0).cast("long")),
            "_state": last_known(F.col("_mark")),
        },
        rows_per_chunk=rows_per_chunk,
    )
    state = scan(state, series, {"_was": previous(F.col("_state"))}, rows_per_chunk=rows_per_chunk)
    reopened = (F.col("_mark") == "open") & (F.col("_was") == "closed") & (F.col("_opened") > 1)
    counted = state.withColumn("_cycle", F.when(reopened, 1).otherwise(0).cast("long"))
    return scan(
        counted, series, {"cycles": running_sum(F.col("_cycle"))}, rows_per_chunk=rows_per_chunk
    ).drop("_mark", "_opened", "_state", "_was", "_cycle")


def stream_gap_runs(
    df: DataFrame, series: Series, at: str, missing: Column, *, limit: int = 15,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Runs of missing reads: where they begin, how long, and whether to give up."""
    flagged = df.withColumn("_gap", F.coalesce(missing, F.lit(False)))
    changed = F.col("_was").isNull() | (F.col("_was") != F.col("_gap"))
    runs = islands(
        flagged, series, changed, "run", carry={"_was": previous(F.col("_gap"))},
        rows_per_chunk=rows_per_chunk,
    )
    return (
        runs.filter("_gap")
        .groupBy(*series.keys, "run")
        .agg(F.min(at).alias("begin"), F.max(at).alias("end"), F.count(F.lit(1)).alias("reads"))
        .withColumn("gave_up", F.col("reads") >= limit)
        .drop("run")
    )


def usable_metrics(rows: DataFrame, numbers: list[str]) -> DataFrame:
    """Rows with a detected hand, no frozen or jumping frame and every number finite."""
    keep = F.coalesce(F.col("hand_detected"), F.lit(False))
    for flag in ("frozen_frame_flag", "agc_jump_flag"):
        keep = keep & ~F.coalesce(F.col(flag), F.lit(False))
    for name in numbers:
        keep = keep & is_finite(F.col(name))
    return rows.filter(keep)
