"""Correlations, lags, bins, regressions and calibration fits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import EVENT_SERIES, q, table, telemetry, with_telemetry
from emberframe.catalog.registry import query
from emberframe.operators import calibration, statistics
from emberframe.operators.ordered import Series
from emberframe.operators.windows import final_window


def _records(spark, root):
    return telemetry(spark, root).select(
        "trial", "t_us", "frame", "t", "phase",
        F.col("counter").cast("double").alias("proxy"), "signal",
        F.sqrt("signal").alias("root_signal"),
    )


_REC = """
, rec AS (SELECT trial, t_us, frame, t, phase, CAST(counter AS DOUBLE) AS proxy, signal, sqrt(signal) AS root_signal FROM ev),
mm AS (SELECT trial, min(proxy) AS p0, max(proxy) AS p1, min(signal) AS s0, max(signal) AS s1, min(root_signal) AS r0,
   max(root_signal) AS r1, min(t) AS t0, max(t) AS t1 FROM rec GROUP BY trial),
nm AS (SELECT rec.*, CASE WHEN p1 > p0 THEN (proxy - p0) / (p1 - p0) ELSE 0 END AS pn,
   CASE WHEN s1 > s0 THEN (signal - s0) / (s1 - s0) ELSE 0 END AS sn,
   CASE WHEN r1 > r0 THEN (root_signal - r0) / (r1 - r0) ELSE 0 END AS rn,
   CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END AS tn FROM rec JOIN mm USING (trial))"""


@query(
    "grouped_correlation",
    with_telemetry(
        """
, g AS (SELECT trial, phase, counter, signal, rank() OVER (PARTITION BY trial, phase ORDER BY counter)
   + (count(*) OVER (PARTITION BY trial, phase, counter) - 1) / 2 AS rc,
   rank() OVER (PARTITION BY trial, phase ORDER BY signal) + (count(*) OVER (PARTITION BY trial, phase, signal) - 1) / 2 AS rs FROM ev),
r AS (SELECT trial, phase, count(*) AS n, CASE WHEN count(*) < 2 OR min(counter) = max(counter) OR min(signal) = max(signal) THEN NULL
   ELSE corr(counter, signal) END AS pearson,
   CASE WHEN count(*) < 2 OR min(counter) = max(counter) OR min(signal) = max(signal) THEN NULL ELSE corr(rc, rs) END AS rho FROM g GROUP BY ALL)
SELECT trial, phase, n, round(pearson, 6) AS pearson, round(rho, 6) AS rho FROM r"""
    ),
)
def grouped_correlation(spark, root):
    df = telemetry(spark, root)
    keys = ["trial", "phase"]
    p = statistics.pearson(df, keys, "counter", "signal")
    ranked = statistics.rank_columns(df, keys, ["frame"], ["counter", "signal"])
    rho = statistics.pearson(ranked, keys, "counter_rank", "signal_rank", "rho").drop("n")
    from emberframe.functions.numbers import nan_as_null

    return p.join(rho, keys).select(
        *keys, "n", q(nan_as_null(F.col("pearson"))).alias("pearson"), q(nan_as_null(F.col("rho"))).alias("rho")
    )


@query("spearman_with_p")
def spearman_with_p(spark, root):
    """The p-value needs the incomplete beta function, which plain SQL lacks."""
    out = statistics.spearman(telemetry(spark, root), ["trial"], ["frame"], "counter", "signal")
    return out.select("trial", "n", q("rho").alias("rho"), q("p_value").alias("p_value"))


def _table_sql() -> str:
    names = {"proxy": ("pn", "proxy"), "time": ("tn", "t")}
    signals = {"signal": ("sn", "signal"), "root_signal": ("rn", "root_signal")}
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}_rank"
        for c in ("pn", "tn", "sn", "rn")
    )
    pooled, each = [], []
    for p, (pn, pr) in names.items():
        for s, (sn, sr) in signals.items():
            pooled.append(
                f"SELECT '{p}' AS proxy, '{s}' AS signal, corr({pn}, {sn}) AS a, corr({pn}_rank, {sn}_rank) AS b FROM rk"
            )
            each.append(
                f"SELECT '{p}' AS proxy, '{s}' AS signal, trial, CASE WHEN count(*) < 2 OR min({pr}) = max({pr}) "
                f"OR min({sr}) = max({sr}) THEN NULL ELSE corr({pr}, {sr}) END AS r FROM rec GROUP BY trial"
            )
    return with_telemetry(
        f"""{_REC}, rk AS (SELECT *, {ranks} FROM nm), pooled AS ({' UNION ALL '.join(pooled)}),
each AS ({' UNION ALL '.join(each)}),
m AS (SELECT proxy, signal, median(abs(r)) AS m, count(*) AS reps FROM each GROUP BY proxy, signal)
SELECT proxy, signal, round(a, 6) AS pooled_normalized_pearson, round(b, 6) AS pooled_normalized_spearman,
  round(m, 6) AS median_abs_per_rep_pearson, reps FROM pooled JOIN m USING (proxy, signal)"""
    )


def _correlations(spark, root):
    records = _records(spark, root).withColumnRenamed("t", "time")
    return statistics.correlation_table(
        records, row_id=["frame"], rep="trial", proxies=["proxy", "time"], signals=["signal", "root_signal"]
    )


@query("correlation_table", _table_sql())
def correlation_table(spark, root):
    out = _correlations(spark, root)
    return out.select(
        "proxy", "signal", *[q(c).alias(c) for c in (
            "pooled_normalized_pearson", "pooled_normalized_spearman", "median_abs_per_rep_pearson")],
        F.size(F.split("per_rep_pearson", ";")).cast("long").alias("reps"),
    )


@query(
    "feature_ranking",
    f"WITH c AS ({_table_sql()}) SELECT proxy, signal, median_abs_per_rep_pearson FROM c "
    "ORDER BY median_abs_per_rep_pearson DESC, proxy, signal LIMIT 3",
)
def feature_ranking(spark, root):
    out = statistics.ranked_features(_correlations(spark, root), "median_abs_per_rep_pearson", 3)
    return out.select("proxy", "signal", q("median_abs_per_rep_pearson").alias("median_abs_per_rep_pearson"))


@query(
    "time_control",
    with_telemetry(
        _REC
        + """, l AS (SELECT trial, pn AS p, tn AS t, 'signal' AS signal, sn AS s FROM nm UNION ALL SELECT trial, pn, tn, 'root_signal', rn FROM nm),
f AS (SELECT signal, regr_slope(p, t) AS pb, regr_intercept(p, t) AS pa, regr_slope(s, t) AS sb, regr_intercept(s, t) AS sa,
   regr_r2(p, t) AS tr, regr_r2(p, s) AS sr FROM l GROUP BY signal),
e AS (SELECT l.*, p - (pa + pb * t) AS pe, s - (sa + sb * t) AS se, tr, sr FROM l JOIN f USING (signal)),
o AS (SELECT signal, any_value(tr) AS tr, any_value(sr) AS sr, corr(pe, se) AS partial FROM e GROUP BY signal),
g AS (SELECT signal, trial, regr_slope(p, t) AS pb, regr_intercept(p, t) AS pa, regr_slope(s, t) AS sb, regr_intercept(s, t) AS sa FROM l GROUP BY ALL),
h AS (SELECT signal, trial, corr(p - (pa + pb * t), s - (sa + sb * t)) AS r FROM l JOIN g USING (signal, trial) GROUP BY ALL),
m AS (SELECT signal, median(abs(r)) AS m, count(*) AS reps FROM h WHERE isfinite(r) GROUP BY signal)
SELECT signal, round(tr, 6) AS time_only_r2, round(sr, 6) AS ir_only_r2, round(tr + (1 - tr) * partial * partial, 6) AS time_plus_ir_r2,
  round((1 - tr) * partial * partial, 6) AS delta_r2, round(partial, 6) AS partial_pearson_after_time,
  round(m, 6) AS median_abs_per_rep_partial, reps FROM o JOIN m USING (signal)"""
    ),
)
def time_control(spark, root):
    out = statistics.time_control(
        _records(spark, root), rep="trial", proxy="proxy", time="t", signals=["signal", "root_signal"]
    )
    names = (
        "time_only_r2", "ir_only_r2", "time_plus_ir_r2", "delta_r2", "partial_pearson_after_time",
        "median_abs_per_rep_partial",
    )
    reps = F.size(F.filter(F.split("per_rep_partial", ";"), lambda r: ~r.contains("NaN"))).cast("long")
    return out.select("signal", *[q(n).alias(n) for n in names], reps.alias("reps"))


_LAGS = """, ix AS (SELECT *, row_number() OVER (PARTITION BY trial{extra} ORDER BY t_us, frame) AS i,
   count(*) OVER (PARTITION BY trial{extra}) AS n FROM {src}),
lg AS (SELECT CAST(lag AS INTEGER) AS lag FROM (SELECT unnest(range(-{k}, {k} + 1)) AS lag)),"""


@query(
    "lag_scan_pooled",
    with_telemetry(
        _REC + _LAGS.format(extra="", src="nm", k=10)
        + """
pr AS (SELECT lag, a.trial, a.pn AS x, b.sn AS y FROM lg, ix a JOIN ix b ON a.trial = b.trial AND b.i = a.i + lag WHERE a.n - abs(lag) >= 2),
each AS (SELECT lag, trial, CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN NULL ELSE abs(corr(x, y)) END AS r FROM pr GROUP BY ALL),
m AS (SELECT lag, median(r) AS m FROM each GROUP BY lag)
SELECT lag, count(*) AS pair_count, round(corr(x, y), 6) AS pooled_pearson, round(any_value(m), 6) AS median_abs_per_rep_pearson
FROM pr JOIN m USING (lag) GROUP BY lag"""
    ),
)
def lag_scan_pooled(spark, root):
    out = statistics.pooled_lag_scan(_records(spark, root), EVENT_SERIES, "proxy", "signal", max_lag=10)
    return out.select(
        "lag", "pair_count", q("pooled_pearson").alias("pooled_pearson"),
        q("median_abs_per_rep_pearson").alias("median_abs_per_rep_pearson"),
    )


_STEP_LAGS = with_telemetry(
    """
, st AS (SELECT *, avg(counter) OVER s AS pm, stddev_pop(counter) OVER s AS pd, avg(signal) OVER s AS sm, stddev_pop(signal) OVER s AS sd
   FROM ev WINDOW s AS (PARTITION BY trial, phase)),
z AS (SELECT *, CASE WHEN pd > 0 THEN (counter - pm) / pd ELSE 0 END AS pz, CASE WHEN sd > 0 THEN (signal - sm) / sd ELSE 0 END AS sz FROM st)"""
    + _LAGS.format(extra=", phase", src="z", k=4)
    + """
pr AS (SELECT lag, a.trial, a.phase, a.pz AS x, b.sz AS y FROM lg, ix a JOIN ix b ON a.trial = b.trial AND a.phase = b.phase AND b.i = a.i + lag
   WHERE a.n >= abs(lag) + 3),
each AS (SELECT lag, trial, phase, count(*) AS n, CASE WHEN count(*) < 2 OR min(x) = max(x) OR min(y) = max(y) THEN NULL ELSE corr(x, y) END AS r FROM pr GROUP BY ALL),
o AS (SELECT lag, lag / 10.0 AS lag_seconds, median(r) AS med, avg(r) AS mean, count(r) AS segment_count,
  CAST(sum(CASE WHEN r IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS pair_count FROM each GROUP BY lag)"""
)


def _step_lags(spark, root):
    series = Series(("trial", "phase"), ("t_us", "frame"))
    return statistics.step_lag_scan(_records(spark, root), series, "proxy", "signal", max_lag=4)


@query(
    "lag_scan_steps",
    _STEP_LAGS
    + """
SELECT lag, CAST(lag_seconds AS DOUBLE) AS lag_seconds, round(med, 6) AS median_pearson, round(mean, 6) AS mean_pearson,
  segment_count, pair_count FROM o""",
)
def lag_scan_steps(spark, root):
    out = _step_lags(spark, root)
    return out.withColumns({n: q(n) for n in ("median_pearson", "mean_pearson")})


@query("best_lag", _STEP_LAGS + "\nSELECT arg_max(lag, med) AS lag, round(max(med), 6) AS median_pearson FROM o")
def best_lag(spark, root):
    out = statistics.best_lag(_step_lags(spark, root), "median_pearson")
    return out.withColumn("median_pearson", q("median_pearson"))


@query(
    "window_change",
    with_telemetry(
        """
, b AS (SELECT *, min(t) OVER (PARTITION BY trial, phase) AS f, max(t) OVER (PARTITION BY trial, phase) AS l FROM ev)
SELECT trial, phase, count(*) AS frame_count, round(avg(CASE WHEN t <= f + 86400 THEN signal END), 6) AS signal_first,
  round(avg(CASE WHEN t >= l - 86400 THEN signal END), 6) AS signal_last,
  round(avg(CASE WHEN t >= l - 86400 THEN signal END) - avg(CASE WHEN t <= f + 86400 THEN signal END), 6) AS signal_change
FROM b GROUP BY trial, phase"""
    ),
)
def window_change(spark, root):
    out = statistics.window_change(telemetry(spark, root), ["trial", "phase"], "t", ["signal"], window_s=86400.0)
    return out.withColumns({n: q(n) for n in ("signal_first", "signal_last", "signal_change")})


@query(
    "steady_drift",
    with_telemetry(
        """
, m AS (SELECT *, max(t) OVER (PARTITION BY trial, phase) AS e FROM ev),
k AS (SELECT * FROM m WHERE t >= e - 432000 AND phase = 'view')
SELECT trial, count(*) AS n, round(CASE WHEN count(*) < 2 OR min(signal) = max(signal) THEN NULL ELSE corr(t, signal) END, 6) AS drift_r,
  round(CASE WHEN count(*) >= 2 THEN regr_slope(signal, t) END, 9) AS drift_per_second FROM k GROUP BY trial"""
    ),
)
def steady_drift(spark, root):
    from emberframe.functions.numbers import guarded_correlation, nan_as_null

    steady = final_window(telemetry(spark, root), ["trial", "phase"], "t", 432000.0)
    return steady.filter(F.col("phase") == "view").groupBy("trial").agg(
        F.count(F.lit(1)).alias("n"),
        q(nan_as_null(guarded_correlation(F.col("t"), F.col("signal")))).alias("drift_r"),
        q(statistics.drift_per_second(F.col("t"), F.col("signal")), 9).alias("drift_per_second"),
    )


@query(
    "quantile_bins",
    with_telemetry(
        """
, b AS (SELECT *, ntile(6) OVER (ORDER BY signal, frame) - 1 AS bin FROM ev)
SELECT bin, count(*) AS count, round(median(signal), 6) AS x_median, round(median(counter), 6) AS y_median,
  round(quantile_cont(counter, 0.25), 6) AS y_q25, round(quantile_cont(counter, 0.75), 6) AS y_q75 FROM b GROUP BY bin"""
    ),
)
def quantile_bins(spark, root):
    out = statistics.equal_count_bins(telemetry(spark, root), "signal", "counter", ["frame"])
    return out.withColumns({n: q(n) for n in ("x_median", "y_median", "y_q25", "y_q75")})


@query(
    "representative_reps",
    with_telemetry(
        """
, r AS (SELECT trial, CASE WHEN count(*) < 2 OR min(counter) = max(counter) OR min(signal) = max(signal) THEN NULL ELSE corr(counter, signal) END AS r FROM ev GROUP BY trial),
k AS (SELECT trial, r FROM r WHERE r >= 0.15 OR NOT EXISTS (SELECT 1 FROM r WHERE r >= 0.15)),
c AS (SELECT trial, quantile_cont(counter, 0.25) AS a, quantile_cont(counter, 0.75) AS b, count(*) AS n FROM ev GROUP BY trial)
SELECT trial, round(any_value(r), 6) AS r, any_value(n) AS points, round(median(CASE WHEN counter <= a THEN signal END), 6) AS low_median,
  round(median(CASE WHEN counter >= b THEN signal END), 6) AS high_median FROM ev JOIN k USING (trial) JOIN c USING (trial) WHERE n >= 4 GROUP BY trial"""
    ),
)
def representative_reps(spark, root):
    df = telemetry(spark, root)
    kept = statistics.representative_groups(df, ["trial"], "counter", "signal", minimum=0.15)
    contrast = statistics.quartile_contrast(df, ["trial"], "counter", "signal")
    out = kept.join(contrast, "trial")
    return out.withColumns({n: q(n) for n in ("r", "low_median", "high_median")})


@query(
    "zscore_in_step",
    """
SELECT l_orderkey, l_linenumber, round(CASE WHEN stddev_pop(l_extendedprice) OVER w > 0 THEN
  (l_extendedprice - avg(l_extendedprice) OVER w) / stddev_pop(l_extendedprice) OVER w ELSE 0 END, 6) AS z,
  round(CASE WHEN max(l_quantity) OVER w > min(l_quantity) OVER w THEN
  (l_quantity - min(l_quantity) OVER w) / (max(l_quantity) OVER w - min(l_quantity) OVER w) ELSE 0 END, 6) AS scaled
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""",
)
def zscore_in_step(spark, root):
    df = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    df = statistics.standardised_in_group(df, ["l_orderkey"], ["l_extendedprice"])
    df = statistics.scaled_in_group(df, ["l_orderkey"], ["l_quantity"])
    return df.select(
        "l_orderkey", "l_linenumber", q("l_extendedprice_z").alias("z"), q("l_quantity_norm").alias("scaled")
    )


@query(
    "ols_r2",
    """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem GROUP BY ALL""",
)
def ols_r2(spark, root):
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), q(F.regr_slope(y, x), 4).alias("slope"),
        q(F.regr_intercept(y, x), 4).alias("intercept"), q(F.regr_r2(y, x)).alias("r2"),
    )


@query(
    "reference_line",
    """
WITH l AS (SELECT l_returnflag, l_discount AS ref, avg(l_extendedprice) AS c FROM lineitem GROUP BY ALL),
o AS (SELECT *, lag(c) OVER (PARTITION BY l_returnflag ORDER BY ref) AS b FROM l),
f AS (SELECT l_returnflag, count(*) AS levels, bool_and(coalesce(c > b, true)) AS strictly_ordered, regr_slope(ref, c) AS slope,
  regr_intercept(ref, c) AS intercept, regr_r2(ref, c) AS r2 FROM o GROUP BY l_returnflag)
SELECT l_returnflag, any_value(levels) AS levels, any_value(strictly_ordered) AS strictly_ordered, round(any_value(slope), 9) AS slope,
  round(any_value(intercept), 6) AS intercept, round(any_value(r2), 6) AS r_squared, round(avg(abs(ref - (slope * c + intercept))), 6) AS mae,
  CAST(NULL AS VARCHAR) AS issue FROM l JOIN f USING (l_returnflag) GROUP BY l_returnflag""",
)
def reference_line(spark, root):
    df = table(spark, root, "lineitem")
    out = statistics.reference_line(df, ["l_returnflag"], "l_discount", "l_extendedprice")
    return out.withColumns({"slope": q("slope", 9)} | {n: q(n) for n in ("intercept", "r_squared", "mae")})


def _samples(spark, root):
    return table(spark, root, "lineitem").select(
        F.col("l_returnflag").alias("g"), "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"),
        (F.col("l_extendedprice") / 1000).alias("u"), (F.col("l_extendedprice") / 500 + F.col("l_tax")).alias("v"),
    )


# The normal equations of centred data by Cramer's rule.
_FIT_SQL = """
WITH s AS (SELECT l_returnflag AS g, l_orderkey, l_linenumber, l_quantity AS x, l_discount AS y, l_tax AS z,
   l_extendedprice / 1000 AS u, l_extendedprice / 500 + l_tax AS v FROM lineitem),
m AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(u) AS mu, avg(v) AS mv,
  covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, covar_pop(y, y) AS d, covar_pop(y, z) AS e, covar_pop(z, z) AS f,
  covar_pop(x, u) AS pu, covar_pop(y, u) AS qu, covar_pop(z, u) AS ru, covar_pop(x, v) AS pv, covar_pop(y, v) AS qv, covar_pop(z, v) AS rv
  FROM s GROUP BY g),
k AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
w AS (SELECT *, (pu * (d * f - e * e) - b * (qu * f - e * ru) + c * (qu * e - d * ru)) / det AS u1,
  (a * (qu * f - e * ru) - pu * (b * f - c * e) + c * (b * ru - c * qu)) / det AS u2,
  (a * (d * ru - e * qu) - b * (b * ru - c * qu) + pu * (b * e - c * d)) / det AS u3,
  (pv * (d * f - e * e) - b * (qv * f - e * rv) + c * (qv * e - d * rv)) / det AS v1,
  (a * (qv * f - e * rv) - pv * (b * f - c * e) + c * (b * rv - c * qv)) / det AS v2,
  (a * (d * rv - e * qv) - b * (b * rv - c * qv) + pv * (b * e - c * d)) / det AS v3 FROM k),
r AS (SELECT s.*, n, mu - u1 * mx - u2 * my - u3 * mz AS u0, u1, u2, u3, mv - v1 * mx - v2 * my - v3 * mz AS v0, v1, v2, v3 FROM s JOIN w USING (g)),
p AS (SELECT *, u0 + u1 * x + u2 * y + u3 * z AS iu, v0 + v1 * x + v2 * y + v3 * z AS iv FROM r),
e2 AS (SELECT *, sqrt((iu - u) ** 2 + (iv - v) ** 2) AS err FROM p)"""


@query(
    "affine_fit",
    _FIT_SQL
    + """
SELECT g, any_value(n) AS sample_count, round(any_value(u1), 5) AS cu, round(any_value(u2), 3) AS cy, round(any_value(v3), 3) AS cz,
  round(sqrt(avg(err * err)), 5) AS rms_error_px, round(max(err), 5) AS max_error_px,
  CASE WHEN sqrt(avg(err * err)) <= 40 AND max(err) <= 40 THEN 'GO' ELSE 'ESCALATE' END AS decision FROM e2 GROUP BY g""",
)
def affine_fit(spark, root):
    fitted = calibration.fit_decision(calibration.fit_affine(_samples(spark, root), ["g"]), 40.0)
    return fitted.select(
        "g", "sample_count", q(F.get("coeff_x", 1), 5).alias("cu"), q(F.get("coeff_x", 2), 3).alias("cy"),
        q(F.get("coeff_y", 3), 3).alias("cz"), q("rms_error_px", 5).alias("rms_error_px"),
        q("max_error_px", 5).alias("max_error_px"), "decision",
    )


@query(
    "affine_project",
    _FIT_SQL
    + """
SELECT l_orderkey, l_linenumber, l_quantity, round(iu, 4) AS ir_x, round(iv, 4) AS ir_y,
  CASE WHEN iu >= 0 AND iu < 60 AND iv >= 0 AND iv < 100 THEN 'ok' ELSE 'projection_out_of_fov' END AS status
FROM (SELECT *, x AS l_quantity FROM e2)""",
)
def affine_project(spark, root):
    samples = _samples(spark, root)
    fitted = calibration.fit_affine(samples, ["g"])
    out = calibration.project_affine(samples, fitted, ["g"], 60, 100)
    return out.select(
        "l_orderkey", "l_linenumber", F.col("x").alias("l_quantity"),
        q("ir_x", 4).alias("ir_x"), q("ir_y", 4).alias("ir_y"), "status",
    )


@query(
    "projection_errors",
    """
WITH p AS (SELECT l_returnflag AS g, l_linenumber AS image, sqrt((l_quantity - l_quantity * (1 + l_discount)) ** 2 + (l_tax * 10) ** 2) AS e FROM lineitem),
i AS (SELECT g, image, count(*) AS n, max(e) AS m, sum(e * e) AS s FROM p GROUP BY ALL)
SELECT g, count(*) AS image_count, CAST(sum(n) AS BIGINT) AS point_count, round(max(m), 6) AS global_max_error_px,
  round(sqrt(sum(s) / sum(n)), 6) AS rms_error_px, 'fail' AS status FROM i GROUP BY g""",
)
def projection_errors(spark, root):
    points = table(spark, root, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("image"),
        F.col("l_quantity").alias("projected_u"), (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("detected_u"),
        (F.col("l_tax") * 10).alias("projected_v"), F.lit(0.0).alias("detected_v"),
    )
    per_image = calibration.projection_errors(points, ["g"], "image")
    out = calibration.projection_verdict(per_image, ["g"], images=5, points_per_image=12, limit_px=3.0)
    return out.withColumns({n: q(n) for n in ("global_max_error_px", "rms_error_px")})


@query(
    "calibration_gate",
    _FIT_SQL
    + """, o AS (SELECT g, any_value(n) AS n, sqrt(avg(err * err)) AS rms, max(err) AS top FROM e2 GROUP BY g)
SELECT g, concat_ws('|', CASE WHEN n < 12 THEN 'too_few_samples' END, CASE WHEN rms > 8 THEN 'rms_above_limit' END,
  CASE WHEN top > 16 THEN 'max_above_limit' END) AS issues FROM o""",
)
def calibration_gate(spark, root):
    fitted = calibration.fit_affine(_samples(spark, root), ["g"])
    issues = calibration.calibration_issues(min_samples=12, max_rms=8.0, max_error=16.0)
    return fitted.select("g", F.concat_ws("|", issues).alias("issues"))


@query(
    "epipolar_distance",
    """
WITH p AS (SELECT l_orderkey, l_linestatus AS ordering, l_discount * 2 AS cx, l_tax * 3 AS cy, l_quantity / 50 AS tx, l_tax * 2 AS ty FROM lineitem),
e AS (SELECT *, 0.2 * ty - 0.1 AS e0, 0.3 - 0.2 * tx AS e1, 0.1 * tx - 0.3 * ty AS e2,
      -0.2 * cy + 0.1 AS f0, 0.2 * cx - 0.3 AS f1 FROM p),
d AS (SELECT *, sqrt((cx * e0 + cy * e1 + e2) ** 2 / greatest(e0 * e0 + e1 * e1 + f0 * f0 + f1 * f1, 1e-12)) * 600 AS d FROM e),
o AS (SELECT l_orderkey, ordering, avg(d) AS m, max(d) AS x FROM d GROUP BY ALL)
SELECT l_orderkey, arg_min(ordering, (m, ordering)) AS ordering, round(min(m), 5) AS mean_px, round(arg_min(x, (m, ordering)), 5) AS max_px FROM o GROUP BY l_orderkey""",
)
def epipolar_distance(spark, root):
    points = table(spark, root, "lineitem").select(
        "l_orderkey", F.col("l_linestatus").alias("ordering"),
        (F.col("l_discount") * 2).alias("cx"), (F.col("l_tax") * 3).alias("cy"),
        (F.col("l_quantity") / 50).alias("tx"), (F.col("l_tax") * 2).alias("ty"),
    )
    essential = [[0.0, 0.2, -0.1], [-0.2, 0.0, 0.3], [0.1, -0.3, 0.0]]
    out = calibration.epipolar_distance(points, ["l_orderkey"], essential, 600.0)
    return out.withColumns({n: q(n, 5) for n in ("mean_px", "max_px")})
