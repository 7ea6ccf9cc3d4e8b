"""Order-dependent columns over keyed series that survive a hot key.

A plain ``Window.partitionBy(trial).orderBy(t)`` puts one trial into one task.
That is fine while the whole input is small and is what these functions do then.
Above the size check the series is cut into clock chunks: every chunk is
windowed on its own, one summary row per chunk carries totals across the cut,
and the summaries (not the rows) are windowed per key.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from emberframe.functions.scale import (
    ROWS_PER_CHUNK,
    ROWS_PER_CHUNK_SETTING,
    fits_one_task,
    setting,
)
from emberframe.operators.keys import join_same
from emberframe.operators.settle import settle

_CHUNK = "_chunk"
#: Splitters of a key are at most 2 to this power; keys that would need more have larger chunks.
MOST_SPLITS = 12


@dataclass(frozen=True)
class Series:
    """Column bindings of a keyed series.

    ``order`` is a total order inside one key; its first column is a non-null
    number (a clock or a frame counter) and cuts the series into chunks.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def clock(self) -> str:
        return self.order[0]

    def window(self, *extra: str, descending: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, *extra).orderBy(*order)

    def position(self) -> Column:
        return F.struct(*self.order)


@dataclass(frozen=True)
class Step:
    """One order-dependent output: what to compute and over which expression."""

    kind: str
    value: Column | None = None


def row_index() -> Step:
    """1-based position in the series."""
    return Step("index")


def running_sum(value: Column) -> Step:
    """Sum from the first row to this row; null counts as zero."""
    return Step("sum", value)


def running_max(value: Column) -> Step:
    return Step("max", value)


def prior_max(value: Column) -> Step:
    """Largest value strictly before this row."""
    return Step("prior_max", value)


def previous(value: Column) -> Step:
    """Value of the row just before this one."""
    return Step("previous", value)


def following(value: Column) -> Step:
    """Value of the row just after this one."""
    return Step("following", value)


def last_known(value: Column) -> Step:
    """Last non-null value up to and including this row."""
    return Step("last_known", value)


def next_known(value: Column) -> Step:
    """First non-null value from this row on."""
    return Step("next_known", value)


_BACKWARD = {"following", "next_known"}


def _local(step: Step, window: WindowSpec) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    match step.kind:
        case "index":
            return F.row_number().over(window).cast("long")
        case "sum":
            return F.coalesce(F.sum(step.value).over(upto), F.lit(0))
        case "max":
            return F.max(step.value).over(upto)
        case "prior_max":
            return F.max(step.value).over(before)
        case "previous" | "following":
            return F.lag(step.value).over(window)
        case "last_known" | "next_known":
            return F.last(step.value, ignorenulls=True).over(upto)
    raise ValueError(f"unknown step {step.kind}")


def _chunk_total(step: Step, position: Column) -> Column:
    match step.kind:
        case "index":
            return F.count(F.lit(1))
        case "sum":
            return F.coalesce(F.sum(step.value), F.lit(0))
        case "max" | "prior_max":
            return F.max(step.value)
        case "previous":
            return F.max_by(F.struct(step.value.alias("v")), position)
        case "following":
            return F.min_by(F.struct(step.value.alias("v")), position)
        case "last_known":
            known = F.when(step.value.isNotNull(), position)
            return F.max_by(step.value, known)
        case "next_known":
            known = F.when(step.value.isNotNull(), position)
            return F.min_by(step.value, known)
    raise ValueError(f"unknown step {step.kind}")


def _carried(step: Step, total: Column, keys: tuple[str, ...]) -> Column:
    order = F.col(_CHUNK).desc() if step.kind in _BACKWARD else F.col(_CHUNK).asc()
    window = Window.partitionBy(*keys).orderBy(order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    match step.kind:
        case "index" | "sum":
            return F.sum(total).over(before)
        case "max" | "prior_max":
            return F.max(total).over(before)
        case "previous" | "following":
            return F.lag(total).over(window)["v"]
        case "last_known" | "next_known":
            return F.last(total, ignorenulls=True).over(before)
    raise ValueError(f"unknown step {step.kind}")


def _stitched(step: Step, local: Column, carried: Column, first: Column) -> Column:
    match step.kind:
        case "index" | "sum":
            return local + F.coalesce(carried, F.lit(0))
        case "max" | "prior_max":
            return F.greatest(local, carried)
        case "previous" | "following":
            return F.when(first, carried).otherwise(local)
        case "last_known" | "next_known":
            return F.coalesce(local, carried)
    raise ValueError(f"unknown step {step.kind}")


def split_evenly(df: DataFrame, keys: tuple[str, ...] | list[str], value: Column, rows_per_chunk: int) -> DataFrame | None:
    """Add a chunk number that grows with ``value`` within each key, about ``rows_per_chunk`` rows each.

    Only keys with more rows are cut. Their splitters are approximate quantiles of their own rows, so neither a
    long tail nor a far outlier makes an uneven chunk; equal values stay together, null ones are in the first
    chunk. The splitters are a written table of one row a cut key: whoever reads the chunks sees the same cuts.
    A chunk is found by binary search. None when no key is that large.
    """
    at = value.cast("double")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_chunk)
    largest = counts.agg(F.max("_rows")).first()[0]
    if largest is None:
        return None
    bits = min(MOST_SPLITS, max(2, math.ceil(math.log2(2 * largest / rows_per_chunk))))
    shares = F.array(*[F.lit(k / (1 << bits)) for k in range(1, 1 << bits)])
    cut = join_same(df.select(*keys, at.alias("_at")), counts.select(*keys), list(keys))
    knots = cut.groupBy(*keys).agg(
        F.percentile_approx("_at", shares, 20 << bits).alias("_knots"), F.ceil(F.count(F.lit(1)) / rows_per_chunk).alias("_pieces")
    )
    found = join_same(df.withColumn("_at", at), settle(knots), list(keys), "left").withColumn("_k", F.lit(0))
    for bit in reversed(range(bits)):
        # knots are numbered from 0; _k of them lie at or below the value
        above = F.get("_knots", F.col("_k") + ((1 << bit) - 1)) <= F.col("_at")
        found = found.withColumn("_k", F.col("_k") + F.when(above, 1 << bit).otherwise(0))
    chunk = F.floor(F.col("_k") * F.coalesce("_pieces", F.lit(1)) / (1 << bits)).cast("long")
    return found.withColumn(_CHUNK, chunk).drop("_at", "_knots", "_pieces", "_k")


def chunked(df: DataFrame, series: Series, rows_per_chunk: int) -> DataFrame | None:
    """Add a chunk number that grows with the clock; None when every key fits one chunk."""
    return split_evenly(df, series.keys, F.col(series.clock), rows_per_chunk)


def scan(
    df: DataFrame,
    series: Series,
    outputs: dict[str, Step],
    *,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Add order-dependent columns; pass ``rows_per_chunk`` to force the split form."""
    pieces = None
    if rows_per_chunk is not None or not fits_one_task(df):
        rows_per_chunk = rows_per_chunk or setting(df, ROWS_PER_CHUNK_SETTING, ROWS_PER_CHUNK)
        pieces = chunked(df, series, rows_per_chunk)
    if pieces is None:
        return df.withColumns(
            {
                name: _local(step, series.window(descending=step.kind in _BACKWARD))
                for name, step in outputs.items()
            }
        )
    at = [*series.keys, _CHUNK]
    totals = pieces.groupBy(*at).agg(
        *[
            _chunk_total(step, series.position()).alias(f"_total_{name}")
            for name, step in outputs.items()
        ]
    )
    carries = totals.select(
        *at,
        *[
            _carried(step, F.col(f"_total_{name}"), series.keys).alias(f"_carry_{name}")
            for name, step in outputs.items()
        ],
    )
    local = {}
    for name, step in outputs.items():
        window = series.window(_CHUNK, descending=step.kind in _BACKWARD)
        local[f"_local_{name}"] = _local(step, window)
        if step.kind in ("previous", "following"):
            local[f"_first_{name}"] = F.row_number().over(window) == 1
    joined = join_same(pieces.withColumns(local), carries, at, "left")
    result = {
        name: _stitched(
            step,
            F.col(f"_local_{name}"),
            F.col(f"_carry_{name}"),
            F.col(f"_first_{name}") if f"_first_{name}" in local else F.lit(False),
        )
        for name, step in outputs.items()
    }
    kept = [c for c in df.columns if c not in outputs]
    return joined.select(*kept, *[expr.alias(name) for name, expr in result.items()])


def neighbours(
    df: DataFrame,
    series: Series,
    reach: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    *,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Add columns over windows that look at most ``reach`` rows back or ahead.

    In the split form rows near a cut are copied to the neighbouring chunk, so
    every window sees its whole neighbourhood; the copies are dropped afterwards.
    """
    if rows_per_chunk is None and fits_one_task(df):
        return df.withColumns(build(series.window()))
    rows_per_chunk = rows_per_chunk or setting(df, ROWS_PER_CHUNK_SETTING, ROWS_PER_CHUNK)
    size = max(rows_per_chunk, 2 * reach)
    at = F.col("_row") - 1
    own = F.floor(at / size).cast("long")
    offset = at % size
    placed = scan(df, series, {"_row": row_index()}, rows_per_chunk=rows_per_chunk).withColumn(
        _CHUNK,
        F.explode(
            F.filter(
                F.array(
                    own,
                    F.when((offset < reach) & (own > 0), own - 1),
                    F.when(offset >= size - reach, own + 1),
                ),
                lambda c: c.isNotNull(),
            )
        ),
    )
    windowed = placed.withColumns(build(series.window(_CHUNK)))
    return windowed.filter(F.col(_CHUNK) == own).drop("_row", _CHUNK)


def with_group_stats(df: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    """Join whole-group aggregates back to the rows.

    The aggregate combines map-side; the join is broadcast by size or, for many
    groups, a shuffle join whose hot key AQE splits. A null key is a group like any other.
    """
    totals = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    own = {key: f"_group_{i}" for i, key in enumerate(keys)}
    same = [F.col(key).eqNullSafe(F.col(name)) for key, name in own.items()]
    rest = [c for c in df.columns if c not in keys]
    return df.join(totals.withColumnsRenamed(own), same).select(*keys, *rest, *stats)


def islands(
    df: DataFrame,
    series: Series,
    starts: Column,
    name: str,
    *,
    carry: dict[str, Step] | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Number runs: ``starts`` is true on the first row of each run.

    ``carry`` holds the look-back columns that ``starts`` needs.
    """
    if carry:
        df = scan(df, series, carry, rows_per_chunk=rows_per_chunk)
    marked = df.withColumn("_start", F.when(starts, 1).otherwise(0).cast("long"))
    return scan(
        marked, series, {name: running_sum(F.col("_start"))}, rows_per_chunk=rows_per_chunk
    ).drop("_start")
