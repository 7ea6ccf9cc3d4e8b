"""Summaries, ranks, correlations and regressions per group."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.functions.numbers import (
    finite_or_null,
    first_reason,
    guarded_correlation,
    is_finite,
    min_max_scaled,
    standardised,
)
from emberframe.functions.text import labelled_values
from emberframe.operators.ordered import (
    Series,
    neighbours,
    previous,
    row_index,
    running_sum,
    scan,
    with_group_stats,
)
from emberframe.operators.quantiles import exact_median, exact_quantiles
from emberframe.operators.settle import settle
from emberframe.operators.windows import average_rank


def metric_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, max, mean, population stdev, p50, p95 and p99 of the non-null values."""
    totals = df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("stdev"),
    )
    levels = exact_quantiles(df, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return totals.join(levels, keys, "left")


def nearest_rank(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], *,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Value at sorted position ``round((n - 1) q)``, halves to even.

    Works on counts of equal values: raw counts have at most 65,536 of them, so
    a frame archive shrinks to one small histogram per group.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = scan(
        counted, Series(tuple(keys), (value,)), {"_upto": running_sum(F.col("_n"))},
        rows_per_chunk=rows_per_chunk,
    )
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_rows"))
    joined = upto.join(totals, keys)
    picks = []
    for name, p in probabilities.items():
        position = F.rint((F.col("_rows") - 1) * F.lit(float(p)))
        reached = (position < F.col("_upto")) & (position >= F.col("_upto") - F.col("_n"))
        picks.append(F.max(F.when(reached, F.col(value))).alias(name))
    return joined.groupBy(*keys).agg(F.max("_rows").alias("rows"), *picks)


def integer_median(df: DataFrame, keys: list[str], value: str, name: str = "median", *, split: bool | None = None) -> DataFrame:
    """Median of integers; an even count gives the floor of the middle mean."""
    medians = exact_quantiles(df, keys, value, {name: 0.5}, split=split)
    return medians.withColumn(name, F.floor(name).cast("long"))


def drift_per_second(at: Column, value: Column) -> Column:
    """Least-squares slope; null below two points or without spread in time."""
    return F.regr_slope(value, at)


def scaled_in_group(df: DataFrame, keys: list[str], columns: list[str], suffix: str = "_norm") -> DataFrame:
    """Add min-max scaled copies per group; a flat group gives zeros."""
    stats = {f"_lo_{c}": F.min(c) for c in columns} | {f"_hi_{c}": F.max(c) for c in columns}
    joined = with_group_stats(df, keys, stats)
    scaled = {
        f"{c}{suffix}": min_max_scaled(
            F.col(c).cast("double"), F.col(f"_lo_{c}").cast("double"), F.col(f"_hi_{c}").cast("double")
        )
        for c in columns
    }
    return joined.withColumns(scaled).drop(*stats)


def standardised_in_group(df: DataFrame, keys: list[str], columns: list[str], suffix: str = "_z") -> DataFrame:
    """Add population z-scores per group; a flat group gives zeros."""
    stats = {f"_m_{c}": F.avg(c) for c in columns} | {f"_s_{c}": F.stddev_pop(c) for c in columns}
    stats |= {f"_flat_{c}": F.min(c) == F.max(c) for c in columns}
    joined = with_group_stats(df, keys, stats)
    scores = {
        f"{c}{suffix}": F.when(F.col(f"_flat_{c}"), F.lit(0.0)).otherwise(
            standardised(F.col(c).cast("double"), F.col(f"_m_{c}"), F.col(f"_s_{c}"))
        )
        for c in columns
    }
    return joined.withColumns(scores).drop(*stats)


def pearson(df: DataFrame, keys: list[str], x: str, y: str, name: str = "pearson") -> DataFrame:
    return df.groupBy(*keys).agg(
        guarded_correlation(F.col(x), F.col(y)).alias(name), F.count(F.lit(1)).alias("n")
    )


def rank_columns(
    df: DataFrame, keys: list[str], row_id: list[str], columns: list[str], suffix: str = "_rank"
) -> DataFrame:
    """Average-tie ranks of several columns within the groups, one shuffle for all of them."""
    long = df.select(
        *keys, *row_id,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("_c"),
    ).select(*keys, *row_id, F.col("_c.name").alias("_name"), F.col("_c.value").alias("_value"))
    ranked = average_rank(long.where(F.col("_value").isNotNull()), [*keys, "_name"], "_value", "_rank")
    ids = list(dict.fromkeys([*keys, *row_id]))
    wide = ranked.groupBy(*ids).agg(
        *[F.max(F.when(F.col("_name") == c, F.col("_rank"))).alias(f"{c}{suffix}") for c in columns]
    )
    return df.join(wide, ids)


def spearman(df: DataFrame, keys: list[str], row_id: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks and its two-sided p-value."""
    ranked = rank_columns(df, keys, row_id, [x, y])
    rho = ranked.groupBy(*keys).agg(
        guarded_correlation(F.col(f"{x}_rank"), F.col(f"{y}_rank")).alias("rho"),
        F.count(F.lit(1)).alias("n"),
    )
    return rho.withColumn("p_value", correlation_p_value("rho", "n"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def correlation_p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation through the t distribution with n - 2 degrees."""

    def one(r: float, rows: float) -> float:
        if not math.isfinite(r) or rows < 3:
            return math.nan
        if abs(r) >= 1.0:
            return 0.0
        degrees = rows - 2.0
        t2 = r * r * degrees / (1.0 - r * r)
        return regularised_beta(degrees / 2.0, 0.5, degrees / (degrees + t2))

    return pd.Series([one(r, k) for r, k in zip(rho, n)], dtype="float64")


def finite_abs(value: Column) -> Column:
    return F.when(is_finite(value), F.abs(value))


def correlation_table(
    records: DataFrame, *, row_id: list[str], rep: str, proxies: list[str], signals: list[str]
) -> DataFrame:
    """Every proxy against every signal.

    Pooled Pearson and Spearman over values scaled per repetition, the median
    absolute Pearson over repetitions and the per-repetition labels.
    """
    names = [*proxies, *signals]
    scaled = scaled_in_group(records, [rep], names)
    norms = [f"{c}_norm" for c in names]
    ranked = rank_columns(scaled.withColumn("_all", F.lit(0)), ["_all"], [*row_id], norms)
    def against_signals(df: DataFrame, kept: list[str], fields: dict[str, str]) -> DataFrame:
        signal = lambda s: F.struct(F.lit(s).alias("name"), *[F.col(f"{s}{tail}").cast("double").alias(n) for n, tail in fields.items()])
        return df.select(*kept, F.explode(F.array(*[signal(s) for s in signals])).alias("_s")).withColumn("_signal", F.col("_s.name"))

    def melted(grouped: DataFrame, fields: dict[str, str], *kept: str) -> DataFrame:
        return grouped.select(
            *kept, F.col("_signal").alias("signal"),
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(p).alias("proxy"),
                            *[F.col(f"{p}{tail}").alias(name) for name, tail in fields.items()],
                        )
                        for p in proxies
                    ]
                )
            ).alias("_p"),
        ).select(*kept, "signal", "_p.*")

    norm_columns = [f"{p}_norm" for p in proxies] + [f"{p}_norm_rank" for p in proxies]
    pooled = against_signals(ranked, norm_columns, {"norm": "_norm", "rank": "_norm_rank"}).groupBy("_signal").agg(
        *[guarded_correlation(F.col(f"{p}_norm"), F.col("_s.norm")).alias(f"{p}_pearson") for p in proxies],
        *[guarded_correlation(F.col(f"{p}_norm_rank"), F.col("_s.rank")).alias(f"{p}_spearman") for p in proxies],
    )
    # raw values need no ranks; a row without any value counts for no repetition, as among the ranks
    valued = scaled.where(F.coalesce(*norms).isNotNull())
    per_rep = against_signals(valued, [rep, *proxies], {"raw": ""}).groupBy(rep, "_signal").agg(
        *[guarded_correlation(F.col(p), F.col("_s.raw")).alias(f"{p}_r") for p in proxies]
    )
    overall = melted(pooled, {"pooled_normalized_pearson": "_pearson", "pooled_normalized_spearman": "_spearman"})
    each = settle(melted(per_rep, {"r": "_r"}, rep).withColumn("_abs", finite_abs(F.col("r"))))
    medians = exact_median(each, ["proxy", "signal"], "_abs", "median_abs_per_rep_pearson")
    labels = each.groupBy("proxy", "signal").agg(
        labelled_values(F.col(rep).cast("string"), F.col("r")).alias("per_rep_pearson")
    )
    return overall.join(medians, ["proxy", "signal"], "left").join(labels, ["proxy", "signal"], "left")


def time_control(
    records: DataFrame, *, rep: str, proxy: str, time: str, signals: list[str]
) -> DataFrame:
    """How much a signal explains of a proxy beyond time.

    With one or two predictors every fit follows from the pairwise correlations,
    so one aggregation serves all of them: R² of time, of the signal and of both,
    and the correlation that is left after removing time from both sides.
    """
    scaled = scaled_in_group(records, [rep], [proxy, time, *signals])
    long = scaled.select(
        rep, F.col(f"{proxy}_norm").alias("p"), F.col(f"{time}_norm").alias("t"),
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("name"), F.col(f"{s}_norm").alias("s")) for s in signals])
        ).alias("_s"),
    ).select(rep, "p", "t", F.col("_s.name").alias("signal"), F.col("_s.s").alias("s"))

    def correlations(grouped) -> DataFrame:
        return grouped.agg(
            guarded_correlation(F.col("p"), F.col("t")).alias("pt"),
            guarded_correlation(F.col("p"), F.col("s")).alias("ps"),
            guarded_correlation(F.col("t"), F.col("s")).alias("ts"),
            (F.min("p") < F.max("p")).alias("p_moves"),
        )

    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    pt, ps, ts = zero(F.col("pt")), zero(F.col("ps")), zero(F.col("ts"))
    free = 1 - ts * ts
    left = (1 - pt * pt) * free
    partial = F.when(left > 1e-12, F.try_divide(ps - pt * ts, F.sqrt(left))).otherwise(F.lit(float("nan")))
    both = F.when(
        free > 1e-12, F.try_divide(pt * pt + ps * ps - 2 * pt * ps * ts, free)
    ).otherwise(pt * pt)
    moves = lambda c: F.when(F.col("p_moves"), c).otherwise(F.lit(float("nan")))
    pooled = correlations(long.groupBy("signal")).select(
        "signal",
        moves(pt * pt).alias("time_only_r2"),
        moves(ps * ps).alias("ir_only_r2"),
        moves(both).alias("time_plus_ir_r2"),
        moves(both - pt * pt).alias("delta_r2"),
        partial.alias("partial_pearson_after_time"),
    )
    per_rep = correlations(long.groupBy(rep, "signal")).select(rep, "signal", partial.alias("r"))
    per_rep = per_rep.withColumn("_abs", finite_abs(F.col("r")))
    medians = exact_median(per_rep, ["signal"], "_abs", "median_abs_per_rep_partial")
    labels = per_rep.groupBy("signal").agg(
        labelled_values(F.col(rep).cast("string"), F.col("r")).alias("per_rep_partial")
    )
    return pooled.join(medians, "signal", "left").join(labels, "signal", "left")


def _lagged(
    df: DataFrame, series: Series, x: str, y: str, max_lag: int, rows_per_chunk: int | None
) -> DataFrame:
    """(keys, lag, x, y) pairs where y comes ``lag`` rows later; exploded but never shuffled."""

    def build(window):
        return {
            "_lagged": F.array(
                *[
                    F.struct(F.lit(k).alias("lag"), F.lead(y, k).over(window).alias("y"))
                    for k in range(-max_lag, max_lag + 1)
                ]
            )
        }

    shifted = neighbours(df, series, max_lag, build, rows_per_chunk=rows_per_chunk)
    pairs = shifted.select(*series.keys, F.col(x).alias("x"), F.explode("_lagged").alias("_l"))
    return pairs.select(*series.keys, "x", F.col("_l.lag").alias("lag"), F.col("_l.y").alias("y")).filter(
        F.col("y").isNotNull()
    )


def _moments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys, "lag").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"),
        F.covar_pop("x", "y").alias("cxy"),
        guarded_correlation(F.col("x"), F.col("y")).alias("r"),
    )


def pooled_lag_scan(
    df: DataFrame, series: Series, proxy: str, signal: str, *, max_lag: int = 10,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Lagged Pearson over per-series scaled values: pooled, and the median absolute one."""
    keys = list(series.keys)
    scaled = scaled_in_group(df, keys, [proxy, signal])
    each = _moments(
        _lagged(scaled, series, f"{proxy}_norm", f"{signal}_norm", max_lag, rows_per_chunk), keys
    ).filter(F.col("n") >= 2)
    totals = with_group_stats(
        each, ["lag"],
        {
            "_n": F.sum("n"),
            "_mx": F.try_divide(F.sum(F.col("mx") * F.col("n")), F.sum("n").cast("double")),
            "_my": F.try_divide(F.sum(F.col("my") * F.col("n")), F.sum("n").cast("double")),
        },
    )
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    pooled = totals.groupBy("lag").agg(
        F.max("_n").alias("pair_count"),
        F.sum((F.col("vx") + dx * dx) * F.col("n")).alias("_sx"),
        F.sum((F.col("vy") + dy * dy) * F.col("n")).alias("_sy"),
        F.sum((F.col("cxy") + dx * dy) * F.col("n")).alias("_sxy"),
    )
    spread = F.sqrt(F.col("_sx") * F.col("_sy"))
    pooled = pooled.select(
        "lag", "pair_count",
        F.when(spread > 0, F.try_divide(F.col("_sxy"), spread)).otherwise(F.lit(float("nan"))).alias(
            "pooled_pearson"
        ),
    )
    medians = exact_median(
        each.withColumn("_abs", finite_abs(F.col("r"))), ["lag"], "_abs", "median_abs_per_rep_pearson"
    )
    return pooled.join(medians, "lag", "left")


def step_lag_scan(
    df: DataFrame, series: Series, proxy: str, signal: str, *, max_lag: int = 10, fps: float = 10.0,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Lagged Pearson of z-scored values inside every step, summarised over steps."""
    keys = list(series.keys)
    sized = with_group_stats(df, keys, {"_rows": F.count(F.lit(1))})
    scored = standardised_in_group(sized, keys, [proxy, signal])
    pairs = _lagged(
        scored.withColumn("_x", F.struct(f"{proxy}_z", "_rows")), series, "_x", f"{signal}_z", max_lag,
        rows_per_chunk,
    )
    enough = F.col("x._rows") >= F.abs("lag") + 3
    pairs = pairs.filter(enough).withColumn("x", F.col(f"x.{proxy}_z"))
    each = _moments(pairs, keys).withColumn("_r", finite_or_null(F.col("r")))
    totals = each.groupBy("lag").agg(
        F.avg("_r").alias("mean_pearson"),
        F.count("_r").alias("segment_count"),
        F.coalesce(F.sum(F.when(F.col("_r").isNotNull(), F.col("n"))), F.lit(0)).alias("pair_count"),
    )
    medians = exact_median(each, ["lag"], "_r", "median_pearson")
    joined = totals.join(medians, "lag", "left")
    return joined.withColumn("lag_seconds", F.col("lag") / F.lit(fps))


def best_lag(scan_rows: DataFrame, value: str) -> DataFrame:
    """The lag with the largest finite value; the earliest lag on ties."""
    known = F.when(is_finite(F.col(value)), F.struct(F.col(value), -F.col("lag")))
    return scan_rows.agg(F.max_by("lag", known).alias("lag"), F.max(finite_or_null(F.col(value))).alias(value))


def window_change(
    df: DataFrame, keys: list[str], at: str, columns: list[str], *, window_s: float = 0.75
) -> DataFrame:
    """Mean in the first and the last window of every step and the change between."""
    bounds = with_group_stats(df, keys, {"_first": F.min(at), "_last": F.max(at)})
    early = F.col(at) <= F.col("_first") + F.lit(window_s)
    late = F.col(at) >= F.col("_last") - F.lit(window_s)
    means = []
    for c in columns:
        means.append(F.avg(F.when(early, F.col(c))).alias(f"{c}_first"))
        means.append(F.avg(F.when(late, F.col(c))).alias(f"{c}_last"))
    out = bounds.groupBy(*keys).agg(F.count(F.lit(1)).alias("frame_count"), *means)
    return out.withColumns({f"{c}_change": F.col(f"{c}_last") - F.col(f"{c}_first") for c in columns})


def equal_count_bins(
    df: DataFrame, x: str, y: str, tie: list[str], *, bins: int = 6, rows_per_chunk: int | None = None
) -> DataFrame:
    """Bins of equal size along x with medians and quartiles.

    The overall order comes from the chunked row index, not from one global sort
    task; the first bins take the remainder.
    """
    series = Series(("_all",), (x, *tie))
    indexed = scan(
        df.withColumn("_all", F.lit(0)), series, {"_row": row_index()}, rows_per_chunk=rows_per_chunk
    )
    sized = with_group_stats(indexed, ["_all"], {"_rows": F.count(F.lit(1))})
    k = F.least(F.lit(bins).cast("long"), F.col("_rows"))
    size, extra = F.floor(F.col("_rows") / k), F.col("_rows") % k
    at = F.col("_row") - 1
    head = extra * (size + 1)
    index = F.when(at < head, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - head) / size))
    placed = sized.withColumn("bin", index.cast("long"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    xs = exact_median(placed, ["bin"], x, "x_median")
    ys = exact_quantiles(placed, ["bin"], y, {"y_q25": 0.25, "y_median": 0.5, "y_q75": 0.75})
    return counts.join(xs, "bin").join(ys, "bin")


def representative_groups(df: DataFrame, keys: list[str], x: str, y: str, *, minimum: float = 0.5) -> DataFrame:
    """Groups with r of at least ``minimum``; all groups when none reaches it."""
    each = pearson(df, keys, x, y, "r").drop("n").withColumn("_one", F.lit(1))
    good = is_finite(F.col("r")) & (F.col("r") >= minimum)
    flags = each.agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("_any"), F.lit(1).alias("_one"))
    return each.join(flags, "_one").filter(good | ~F.col("_any")).drop("_one", "_any")


def quartile_contrast(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median y at or below the lower x quartile and at or above the upper one."""
    cuts = exact_quantiles(df, keys, x, {"_q25": 0.25, "_q75": 0.75})
    placed = df.join(cuts, keys).withColumns(
        {
            "_low": F.when(F.col(x) <= F.col("_q25"), F.col(y)),
            "_high": F.when(F.col(x) >= F.col("_q75"), F.col(y)),
        }
    )
    rows = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    low = exact_median(placed, keys, "_low", "low_median")
    high = exact_median(placed, keys, "_high", "high_median")
    return rows.join(low, keys).join(high, keys).filter(F.col("points") >= 4)


def ranked_features(table: DataFrame, value: str, k: int = 12) -> DataFrame:
    """The k rows with the largest finite value: a report, so its size is the feature."""
    return table.filter(is_finite(F.col(value))).orderBy(F.col(value).desc(), *[c for c in table.columns if c != value][:2]).limit(k)


def reference_line(observations: DataFrame, keys: list[str], reference: str, count: str) -> DataFrame:
    """Count to temperature line through the mean count of every reference level.

    Reports strict order, slope, intercept, R² and the in-sample mean absolute error.
    """
    levels = observations.groupBy(*keys, reference).agg(F.avg(count).alias("_c"))
    by_level = Series(tuple(keys), (reference,))
    levels = scan(levels, by_level, {"_before": previous(F.col("_c"))})
    fit = levels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("levels"),
        F.bool_and(F.coalesce(F.col("_c") > F.col("_before"), F.lit(True))).alias("strictly_ordered"),
        F.regr_slope(F.col(reference).cast("double"), F.col("_c")).alias("slope"),
        F.avg("_c").alias("_mc"), F.avg(reference).alias("_mr"),
        F.max("_c").alias("_top"), F.min("_c").alias("_bottom"),
    )
    fit = fit.withColumn("intercept", F.col("_mr") - F.col("slope") * F.col("_mc"))
    missed = F.col(reference) - (F.col("slope") * F.col("_c") + F.col("intercept"))
    errors = levels.join(fit, keys).groupBy(*keys).agg(
        F.avg(F.abs(missed)).alias("mae"),
        F.sum(missed * missed).alias("_res"),
        (F.var_pop(reference) * F.count(F.lit(1))).alias("_tot"),
    )
    r2 = F.when(F.col("_tot") == 0, F.lit(1.0)).otherwise(1 - F.try_divide(F.col("_res"), F.col("_tot")))
    joined = fit.join(errors, keys).withColumn("r_squared", r2)
    issue = first_reason(
        (F.col("levels") < 2, "too_few_levels"), (F.col("_top") == F.col("_bottom"), "constant_counts")
    )
    return joined.withColumn("issue", issue).select(
        *keys, "levels", "strictly_ordered", "slope", "intercept", "r_squared", "mae", "issue"
    )
