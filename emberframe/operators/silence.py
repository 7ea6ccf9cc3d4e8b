"""Stalls of sources on recorded tables, set-based: look-back columns and running counts, no row walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators import ordered


def silence_reports(df: DataFrame, series: ordered.Series, kind: Column, *, limit_us: int, idle_us: int, until_us: int) -> DataFrame:
    """keys, at_us, generation, report: what ``SilenceWatch`` reports over a table whose clock is in microseconds.

    A frame or an error is a new generation, counted anew after ``idle_us`` without a row. An error reports at
    once; any other row if nothing follows within ``limit_us``, as stale once a frame has come since the start.
    """
    clock = F.col(series.clock)
    rows = df.select(*series.keys, *series.order, kind.alias("_kind")).where(clock <= until_us)
    near = {"_before": ordered.previous(clock), "_after": ordered.following(clock)}
    fresh = F.col("_before").isNull() | (clock - F.col("_before") > idle_us)
    lives = ordered.islands(rows, series, fresh, "_life", carry=near)
    own = ordered.Series((*series.keys, "_life"), series.order)
    heard = F.when(F.col("_kind") != "error", F.col("_kind"))
    counted = ordered.scan(
        lives, own, {"generation": ordered.running_sum((F.col("_kind") != "start").cast("long")), "_heard": ordered.last_known(heard)}
    )
    due = clock + F.lit(limit_us + 1)
    failed = F.col("_kind") == "error"
    stalled = ~failed & (due <= F.coalesce("_after", F.lit(until_us)))
    return counted.where(failed | stalled).select(
        *series.keys,
        F.when(failed, clock).otherwise(due).alias("at_us"),
        "generation",
        F.when(stalled & (F.col("_heard") == "frame"), "thermal_stale").otherwise("thermal_unavailable").alias("report"),
    )
