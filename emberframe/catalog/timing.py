"""Windows, runs, gates and ranks over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import EVENT_SERIES, q, telemetry, with_telemetry
from emberframe.catalog.registry import query
from emberframe.operators import gates, windows
from emberframe.operators.ordered import Series, with_group_stats
from emberframe.operators.quantiles import exact_quantiles

_W = "(PARTITION BY trial ORDER BY t_us, frame)"


@query(
    "rolling_median5",
    with_telemetry(
        """
, s AS (SELECT *, CASE WHEN phase = 'error' THEN NULL ELSE signal END AS v FROM ev), w AS (
  SELECT trial, frame, v, list_filter(list(v) OVER (PARTITION BY trial ORDER BY t_us, frame
    ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), lambda x: x IS NOT NULL) AS l FROM s)
SELECT trial, frame, round(CASE WHEN v IS NOT NULL THEN list_aggregate(l, 'median') END, 6) AS kept_null,
  round(list_aggregate(l, 'median'), 6) AS bridged FROM w"""
    ),
)
def rolling_median5(spark, root):
    df = telemetry(spark, root).withColumn("v", F.when(F.col("phase") != "error", F.col("signal")))
    df = windows.rolling_median(df, EVENT_SERIES, "v", "kept_null")
    df = windows.rolling_median(df, EVENT_SERIES, "v", "bridged", keep_null_centre=False)
    return df.select("trial", "frame", q("kept_null").alias("kept_null"), q("bridged").alias("bridged"))


@query(
    "frozen_and_jump",
    with_telemetry(
        f"""
SELECT trial, frame, coalesce(phase = lag(phase) OVER {_W}, false) AS frozen_frame_flag,
       coalesce(abs(signal - lag(signal) OVER {_W}) >= 8, false) AS agc_jump_flag FROM ev"""
    ),
)
def frozen_and_jump(spark, root):
    flags = windows.frozen_and_jump(telemetry(spark, root), EVENT_SERIES, "phase", "signal")
    return flags.select("trial", "frame", "frozen_frame_flag", "agc_jump_flag")


@query(
    "duplicate_hash_first",
    """SELECT source, sha1(text) AS hash, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang
FROM documents GROUP BY source, sha1(text)""",
)
def duplicate_hash_first(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet").select(
        "source", "doc_id", "lang", F.sha1("text").alias("hash")
    )
    return windows.first_per_content(docs, ["source"], "hash", ["doc_id"])


@query(
    "final_window",
    with_telemetry(
        """
, m AS (SELECT *, max(t) OVER (PARTITION BY trial, phase) AS e FROM ev)
SELECT trial, phase, count(*) AS rows, round(avg(signal), 6) AS mean_signal
FROM m WHERE t >= e - 86400 GROUP BY trial, phase"""
    ),
)
def final_window(spark, root):
    kept = windows.final_window(telemetry(spark, root), ["trial", "phase"], "t", 86400.0)
    return kept.groupBy("trial", "phase").agg(
        F.count(F.lit(1)).alias("rows"), q(F.avg("signal")).alias("mean_signal")
    )


@query(
    "gap_clusters",
    with_telemetry(
        f"""
, g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER {_W} > 43200000000 THEN 1 ELSE 0 END AS s FROM ev),
c AS (SELECT *, sum(s) OVER {_W} AS cluster FROM g)
SELECT trial, CAST(cluster AS BIGINT) AS cluster, count(*) AS rows, min(t_us) AS begin_us,
       max(t_us) AS end_us FROM c GROUP BY trial, cluster"""
    ),
)
def gap_clusters(spark, root):
    df = windows.gap_clusters(telemetry(spark, root), EVENT_SERIES, "t_us", 43_200_000_000)
    return df.groupBy("trial", "cluster").agg(
        F.count(F.lit(1)).alias("rows"), F.min("t_us").alias("begin_us"), F.max("t_us").alias("end_us")
    )


@query(
    "signal_onset",
    with_telemetry(
        """
, b AS (SELECT trial, avg(signal) + 2 * stddev_pop(signal) AS thr FROM ev GROUP BY trial)
SELECT trial, coalesce(min(CASE WHEN signal > greatest(thr, 2.0) THEN t_us END), 0) AS onset,
       count(CASE WHEN signal > greatest(thr, 2.0) THEN 1 END) > 0 AS found
FROM ev JOIN b USING (trial) GROUP BY trial"""
    ),
)
def signal_onset(spark, root):
    df = with_group_stats(
        telemetry(spark, root), ["trial"],
        {"thr": F.avg("signal") + 2 * F.stddev_pop("signal")},
    )
    found = windows.onset(df, ["trial"], "t_us", "signal", F.greatest(F.col("thr"), F.lit(2.0)))
    return found.select(
        "trial", F.coalesce("onset", F.lit(0)).alias("onset"), F.col("onset").isNotNull().alias("found")
    )


@query(
    "average_rank",
    with_telemetry(
        """
SELECT trial, frame, rank() OVER (PARTITION BY trial ORDER BY counter) - 1
  + (count(*) OVER (PARTITION BY trial, counter) - 1) / 2 AS rank FROM ev"""
    ),
)
def average_rank(spark, root):
    return windows.average_rank(telemetry(spark, root), ["trial"], "counter").select("trial", "frame", "rank")


@query(
    "bin_interpolate",
    with_telemetry(
        """
, b AS (SELECT trial, CAST(floor(t / 43200) AS BIGINT) AS bin, count(*) AS n, median(signal) AS med
        FROM ev WHERE t >= 0 AND t < 2592000 GROUP BY ALL),
g AS (SELECT trial, bin FROM (SELECT DISTINCT trial FROM ev), (SELECT unnest(range(60)) AS bin)),
v AS (SELECT trial, bin, coalesce(n, 0) AS n, med FROM g LEFT JOIN b USING (trial, bin)),
k AS (SELECT *,
  last_value(CASE WHEN med IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY trial ORDER BY bin) AS lb,
  last_value(med IGNORE NULLS) OVER (PARTITION BY trial ORDER BY bin) AS lv,
  first_value(CASE WHEN med IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY trial ORDER BY bin
     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rb,
  first_value(med IGNORE NULLS) OVER (PARTITION BY trial ORDER BY bin
     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv FROM v)
SELECT trial, bin, n, round(med, 6) AS measured,
  round(coalesce(med, lv + (rv - lv) * (bin - lb) / (rb - lb), lv, rv), 6) AS filled,
  round(CASE WHEN n >= 2 THEN med END, 6) AS two_or_more FROM k"""
    ),
)
def bin_interpolate(spark, root):
    from emberframe.operators.paired import binned_curve

    bins = binned_curve(telemetry(spark, root), ["trial"], "t", "signal", start=0.0, width=43200.0, bins=60)
    filled = windows.interpolate_missing(bins, Series(("trial",), ("bin",)), "bin", "median", "filled")
    return filled.select(
        "trial", F.col("bin").cast("long").alias("bin"), "n", q("median").alias("measured"),
        q("filled").alias("filled"),
        q(F.when(F.col("n") >= 2, F.col("median"))).alias("two_or_more"),
    )


@query(
    "time_bins",
    with_telemetry(
        """
SELECT trial, CAST(floor(t / 43200) AS INTEGER) AS bin, count(*) AS n, round(median(signal), 6) AS median
FROM ev WHERE t >= 0 AND t < 1296000 GROUP BY ALL"""
    ),
)
def time_bins(spark, root):
    from emberframe.operators.paired import measured_bins

    out = measured_bins(telemetry(spark, root), ["trial"], "t", "signal", start=0.0, width=43200.0, bins=30)
    return out.withColumn("median", q("median"))


@query(
    "timestamp_faults",
    with_telemetry(
        f"""
, s AS (SELECT trial, t_us - lag(t_us) OVER {_W} AS step FROM ev)
SELECT trial, count(*) AS rows, count(CASE WHEN step > 64800000000 THEN 1 END) AS gaps,
       count(CASE WHEN step <= 0 THEN 1 END) AS regressions FROM s GROUP BY trial"""
    ),
)
def timestamp_faults(spark, root):
    df = windows.timestamp_faults(telemetry(spark, root), EVENT_SERIES, "t_us", 64_800_000_000)
    return df.groupBy("trial").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("gap_fault"), 1)).alias("gaps"),
        F.count(F.when(F.col("order_fault"), 1)).alias("regressions"),
    )


@query(
    "counter_high_water",
    with_telemetry(
        f"""
, h AS (SELECT *, max(counter) OVER (PARTITION BY trial ORDER BY t_us, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM ev)
SELECT trial, frame, coalesce(counter <= high, false) AS counter_non_increasing FROM h"""
    ),
)
def counter_high_water(spark, root):
    df = windows.counter_faults(telemetry(spark, root), EVENT_SERIES, ["counter"])
    return df.select("trial", "frame", "counter_non_increasing")


@query(
    "repeat_counter",
    with_telemetry(
        f"""
, c AS (SELECT *, CASE WHEN phase = lag(phase) OVER {_W} THEN 0 ELSE 1 END AS s FROM ev),
r AS (SELECT *, sum(s) OVER {_W} AS run FROM c)
SELECT trial, frame, row_number() OVER (PARTITION BY trial, run ORDER BY t_us, frame) - 1 AS repeats,
       row_number() OVER (PARTITION BY trial, run ORDER BY t_us, frame) - 1 > 5 AS stuck FROM r"""
    ),
)
def repeat_counter(spark, root):
    df = windows.repeat_counter(telemetry(spark, root), EVENT_SERIES, "phase")
    return df.select("trial", "frame", "repeats", "stuck")


@query(
    "frame_intervals",
    with_telemetry(
        f"""
, s AS (SELECT trial, t, t - lag(t) OVER {_W} AS step FROM ev)
SELECT trial, count(*) AS frame_count, round(min(step), 6) AS interval_min, round(max(step), 6) AS interval_max,
  round(avg(step), 6) AS interval_mean, round(stddev_pop(step), 4) AS interval_stdev,
  round(max(t) - min(t), 6) AS duration, round(median(step), 6) AS interval_median,
  round((count(*) - 1) / (max(t) - min(t)), 9) AS observed_fps FROM s GROUP BY trial"""
    ),
)
def frame_intervals(spark, root):
    out = windows.interval_stats(telemetry(spark, root), EVENT_SERIES, "t")
    names = ("interval_min", "interval_max", "interval_mean", "duration", "interval_median")
    return out.select(
        "trial", "frame_count", *[q(n).alias(n) for n in names],
        q("interval_stdev", 4).alias("interval_stdev"), q("observed_fps", 9).alias("observed_fps"),
    )


@query(
    "marker_availability",
    with_telemetry(
        f"""
, d AS (SELECT *, phase <> 'error' AS det FROM ev),
c AS (SELECT *, CASE WHEN det = lag(det) OVER {_W} THEN 0 ELSE 1 END AS s FROM d),
r AS (SELECT *, sum(s) OVER {_W} AS run FROM c),
a AS (SELECT trial, run, count(*) AS n, min(t) AS b, max(t) AS e, bool_or(det) AS det FROM r GROUP BY ALL),
x AS (SELECT *, coalesce(lead(b) OVER (PARTITION BY trial ORDER BY run), e) AS stop FROM a)
SELECT trial, CAST(sum(n) AS BIGINT) AS evaluated,
  CAST(sum(CASE WHEN det THEN n ELSE 0 END) AS BIGINT) AS detected,
  round(coalesce(max(CASE WHEN NOT det THEN stop - b END), 0), 6) AS longest_missing_s
FROM x GROUP BY trial"""
    ),
)
def marker_availability(spark, root):
    df = telemetry(spark, root).withColumn("det", F.col("phase") != "error")
    out = windows.missing_runs(df, EVENT_SERIES, "t", "det")
    return out.withColumn("longest_missing_s", q("longest_missing_s"))


@query(
    "stable_gate",
    with_telemetry(
        f"""
, i AS (SELECT *, abs(signal - 30) <= 25 AS ok FROM ev),
c AS (SELECT *, CASE WHEN ok = lag(ok) OVER {_W} THEN NULL ELSE t END AS b FROM i),
r AS (SELECT *, max(b) OVER {_W} AS since FROM c)
SELECT trial, frame, round(CASE WHEN ok THEN t - since ELSE 0 END, 6) AS stable_s,
       ok AND t <> since AND t - since >= 7200 AS gate_open FROM r"""
    ),
)
def stable_gate(spark, root):
    df = gates.stable_gate(
        telemetry(spark, root), EVENT_SERIES, "t", "signal", target=30.0, tolerance=25.0, required_s=7200.0
    )
    return df.select("trial", "frame", q("stable_s").alias("stable_s"), "gate_open")


@query(
    "hold_gate",
    with_telemetry(
        f"""
, i AS (SELECT *, abs(signal - 30) <= 25 AS ok FROM ev),
c AS (SELECT *, CASE WHEN ok = lag(ok) OVER {_W} THEN NULL ELSE t END AS b FROM i),
r AS (SELECT *, max(b) OVER {_W} AS since FROM c)
SELECT trial, frame, ok OR t - since <= 21600 AS hold_ok FROM r"""
    ),
)
def hold_gate(spark, root):
    df = gates.hold_gate(
        telemetry(spark, root), EVENT_SERIES, "t", "signal", target=30.0, tolerance=25.0, max_gap_s=21600.0
    )
    return df.select("trial", "frame", "hold_ok")


@query(
    "contact_hysteresis",
    with_telemetry(
        f"""
, m AS (SELECT *, CASE WHEN signal <= 20 THEN true WHEN signal >= 40 THEN false END AS v FROM ev)
SELECT trial, frame, coalesce(last_value(v IGNORE NULLS) OVER {_W}, false) AS active FROM m"""
    ),
)
def contact_hysteresis(spark, root):
    df = gates.hysteresis(telemetry(spark, root), EVENT_SERIES, "signal", "active", enter=20.0, leave=40.0)
    return df.select("trial", "frame", "active")


@query(
    "cycle_count",
    with_telemetry(
        f"""
, m AS (SELECT *, CASE WHEN signal >= 40 THEN 'open' WHEN signal <= 20 THEN 'closed' END AS mark FROM ev),
k AS (SELECT * FROM m WHERE mark IS NOT NULL),
f AS (SELECT trial, min(t_us) AS first_open FROM k WHERE mark = 'open' GROUP BY trial),
l AS (SELECT k.*, lag(mark) OVER (PARTITION BY trial ORDER BY t_us, frame) AS was FROM k JOIN f USING (trial)
      WHERE t_us >= first_open)
SELECT ev.trial, count(CASE WHEN l.mark = 'open' AND l.was = 'closed' THEN 1 END) AS cycles
FROM ev LEFT JOIN l ON l.trial = ev.trial AND l.frame = ev.frame GROUP BY ev.trial"""
    ),
)
def cycle_count(spark, root):
    df = gates.cycle_count(telemetry(spark, root), EVENT_SERIES, "signal", close=20.0, reopen=40.0)
    return df.groupBy("trial").agg(F.max("cycles").alias("cycles"))


@query(
    "stream_gap_runs",
    with_telemetry(
        f"""
, g AS (SELECT *, signal < 40 AS gap FROM ev),
c AS (SELECT *, CASE WHEN gap = lag(gap) OVER {_W} THEN 0 ELSE 1 END AS s FROM g),
r AS (SELECT *, sum(s) OVER {_W} AS run FROM c)
SELECT trial, min(t_us) AS "begin", max(t_us) AS "end", count(*) AS reads, count(*) >= 6 AS gave_up
FROM r WHERE gap GROUP BY trial, run"""
    ),
)
def stream_gap_runs(spark, root):
    return gates.stream_gap_runs(
        telemetry(spark, root), EVENT_SERIES, "t_us", F.col("signal") < 40, limit=6
    )


@query(
    "first_last_values",
    with_telemetry(
        """
SELECT trial, arg_min(signal, (t_us, frame)) AS first_value, arg_max(signal, (t_us, frame)) AS last_value,
       round(arg_max(signal, (t_us, frame)) - arg_min(signal, (t_us, frame)), 6) AS drift FROM ev GROUP BY trial"""
    ),
)
def first_last_values(spark, root):
    at = F.struct("t_us", "frame")
    out = telemetry(spark, root).groupBy("trial").agg(
        F.min_by("signal", at).alias("first_value"), F.max_by("signal", at).alias("last_value")
    )
    return out.withColumn("drift", q(F.col("last_value") - F.col("first_value")))


@query(
    "step_direction",
    with_telemetry(
        f"""
, p AS (SELECT trial, frame, counter, lag(counter) OVER {_W} AS was FROM ev)
SELECT trial, frame, CASE WHEN was IS NULL AND counter = 0 THEN 'baseline' WHEN was IS NULL THEN 'start'
  WHEN counter > was THEN 'up' WHEN counter < was THEN 'down' ELSE 'hold' END AS direction FROM p"""
    ),
)
def step_direction(spark, root):
    from emberframe.functions import protocol
    from emberframe.operators.ordered import previous, scan

    df = scan(telemetry(spark, root), EVENT_SERIES, {"was": previous(F.col("counter"))})
    direction = protocol.step_direction(F.col("was"), F.col("counter"))
    return df.select("trial", "frame", direction.alias("direction"))


@query(
    "first_k_valid",
    with_telemetry(
        f"""
, b AS (SELECT trial, phase, min(t_us) AS t_us, count(*) >= 12 AS ok FROM ev GROUP BY ALL),
c AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY trial ORDER BY t_us, phase) AS n FROM b)
SELECT trial, phase, t_us FROM c WHERE ok AND n <= 3"""
    ),
)
def first_k_valid(spark, root):
    blocks = telemetry(spark, root).groupBy("trial", "phase").agg(
        F.min("t_us").alias("t_us"), (F.count(F.lit(1)) >= 12).alias("ok")
    )
    kept = windows.first_k_valid(blocks, Series(("trial",), ("t_us", "phase")), F.col("ok"), 3)
    return kept.select("trial", "phase", "t_us")


@query(
    "nearest_row",
    with_telemetry(
        """
SELECT trial, arg_min(frame, (abs(t_us - 1296000000000), frame)) AS frame,
       arg_min(signal, (abs(t_us - 1296000000000), frame)) AS signal FROM ev GROUP BY trial"""
    ),
)
def nearest_row(spark, root):
    df = telemetry(spark, root).select("trial", "frame", "t_us", "signal")
    near = windows.nearest_row(df, ["trial"], F.abs(F.col("t_us") - 1_296_000_000_000), ["frame"])
    return near.select("trial", "frame", "signal")


@query(
    "metric_percentiles",
    with_telemetry(
        """
SELECT phase, count(*) AS count, round(quantile_cont(signal, 0.5), 6) AS p50,
  round(quantile_cont(signal, 0.95), 6) AS p95, round(quantile_cont(signal, 0.99), 6) AS p99,
  max(signal) AS "max", min(signal) AS "min", round(avg(signal), 6) AS mean,
  round(stddev_pop(signal), 6) AS stdev FROM ev GROUP BY phase"""
    ),
)
def metric_percentiles(spark, root):
    from emberframe.operators.statistics import metric_summary

    out = metric_summary(telemetry(spark, root), ["phase"], "signal")
    numbers = ("p50", "p95", "p99", "mean", "stdev")
    return out.select("phase", "count", "max", "min", *[q(n).alias(n) for n in numbers])


@query(
    "split_quantiles",
    with_telemetry(
        """
SELECT trial, round(quantile_cont(signal, 0.05), 6) AS p5, round(median(signal), 6) AS p50,
       round(quantile_cont(signal, 0.95), 6) AS p95 FROM ev GROUP BY trial"""
    ),
)
def split_quantiles(spark, root):
    """The many-task quantile form, forced, on whole tables."""
    out = exact_quantiles(
        telemetry(spark, root), ["trial"], "signal", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, split=True
    )
    return out.select("trial", *[q(n).alias(n) for n in ("p5", "p50", "p95")])


@query(
    "split_window_columns",
    with_telemetry(
        f"""
SELECT trial, frame, row_number() OVER {_W} AS row, lag(signal) OVER {_W} AS before,
       lead(signal) OVER {_W} AS after, CAST(sum(counter) OVER {_W} AS BIGINT) AS total FROM ev"""
    ),
)
def split_window_columns(spark, root):
    """The chunked form of the order-dependent columns, forced, on whole tables."""
    from emberframe.operators.ordered import following, previous, row_index, running_sum, scan

    df = telemetry(spark, root)
    out = scan(
        df, EVENT_SERIES,
        {
            "row": row_index(),
            "before": previous(F.col("signal")),
            "after": following(F.col("signal")),
            "total": running_sum(F.col("counter")),
        },
        rows_per_chunk=2000,
    )
    return out.select("trial", "frame", "row", "before", "after", "total")
