"""Paired null/press inference over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import q, telemetry, with_telemetry
from emberframe.catalog.registry import query
from emberframe.operators import paired

_FIELDS = ("primary_signal_count", "uv_displacement_px", "depth_change_m")


def _curves(spark, root):
    """Clicks are null trials and views press trials; a bin is half a second of a 15-day scale."""
    rows = telemetry(spark, root).filter(F.col("phase").isin("click", "view"))
    condition = F.when(F.col("phase") == "click", "null").otherwise("press")
    values = F.array(
        F.struct(F.lit(_FIELDS[0]).alias("field"), (F.col("signal") + F.when(F.col("phase") == "view", F.col("t") / 60000).otherwise(0)).alias("value")),
        F.struct(F.lit(_FIELDS[1]).alias("field"), F.col("counter").cast("double").alias("value")),
        F.struct(F.lit(_FIELDS[2]).alias("field"), (F.col("frame") % 97).cast("double").alias("value")),
    )
    return rows.select(
        F.lit(0).alias("session"), (F.col("trial") % 6).alias("block"), condition.alias("condition"),
        (F.col("t") / 172800 + 5).alias("time_s"), F.explode(values).alias("_f"),
    ).select("session", "block", "condition", "time_s", "_f.*")


_CURVES = """,
cv AS (SELECT trial % 6 AS block, CASE phase WHEN 'click' THEN 'null' ELSE 'press' END AS condition, t / 172800 + 5 AS time_s, frame, counter,
    signal + CASE WHEN phase = 'view' THEN t / 60000 ELSE 0 END AS signal FROM ev WHERE phase IN ('click', 'view')),
lc AS (SELECT block, condition, time_s, 'primary_signal_count' AS field, signal AS value FROM cv UNION ALL
  SELECT block, condition, time_s, 'uv_displacement_px', CAST(counter AS DOUBLE) FROM cv UNION ALL
  SELECT block, condition, time_s, 'depth_change_m', CAST(frame % 97 AS DOUBLE) FROM cv),
bn AS (SELECT field, block, condition, CAST(floor((time_s - 5) / 0.5) AS INTEGER) AS bin, median(value) AS m FROM lc WHERE time_s >= 5 AND time_s < 20 GROUP BY ALL),
df AS (SELECT field, block, bin, max(CASE WHEN condition = 'press' THEN m END) - max(CASE WHEN condition = 'null' THEN m END) AS d FROM bn GROUP BY ALL),
ok AS (SELECT field FROM df WHERE d IS NOT NULL GROUP BY field HAVING count(*) = 180 AND count(DISTINCT bin) = 30)"""


def _differences(spark, root):
    binned = paired.measured_bins(
        _curves(spark, root), ["session", "block", "condition", "field"], "time_s", "value",
        start=5.0, width=0.5, bins=30,
    )
    return paired.paired_differences(binned, ["session", "field"], "block")


@query(
    "paired_diff",
    with_telemetry(_CURVES + "\nSELECT field, block, bin, round(d, 6) AS difference FROM df"),
)
def paired_diff(spark, root):
    return _differences(spark, root).select("field", "block", "bin", q("difference").alias("difference"))


@query(
    "paired_t",
    with_telemetry(
        _CURVES
        + """
SELECT field, bin, CAST(count(d) AS INTEGER) AS pairs, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(d)))
  WHEN avg(d) > 0 THEN 'inf'::DOUBLE WHEN avg(d) < 0 THEN '-inf'::DOUBLE ELSE 0 END, 6) AS t FROM df WHERE d IS NOT NULL GROUP BY field, bin HAVING count(d) > 1"""
    ),
)
def paired_t(spark, root):
    known = _differences(spark, root).filter(F.col("difference").isNotNull())
    out = paired.paired_t(known, ["session", "field"], "block").filter(F.col("pairs") > 1)
    return out.select("field", "bin", "pairs", q("t").alias("t"))


_CLUSTERS = (
    _CURVES
    + """,
pm AS (SELECT CAST(p AS INTEGER) AS perm FROM (SELECT unnest(range(64)) AS p)),
fl AS (SELECT field, bin, perm, d * CASE WHEN (perm >> CAST(block AS INTEGER)) & 1 = 1 THEN 1 ELSE -1 END AS d FROM df JOIN ok USING (field), pm),
tt AS (SELECT field, perm, bin, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(6)) WHEN avg(d) > 0 THEN 'inf'::DOUBLE
   WHEN avg(d) < 0 THEN '-inf'::DOUBLE ELSE 0 END AS t FROM fl GROUP BY ALL),
ac AS (SELECT *, bin - row_number() OVER (PARTITION BY field, perm, t > 0 ORDER BY bin) AS isl, t > 0 AS up FROM tt WHERE abs(t) > 2.5706),
cl AS (SELECT field, perm, up, min(bin) AS start_bin, max(bin) AS end_bin, sum(abs(t)) AS mass FROM ac GROUP BY field, perm, up, isl),
mx AS (SELECT o.field, pm.perm, coalesce(max(mass), 0) AS m FROM ok o CROSS JOIN pm LEFT JOIN cl ON cl.field = o.field AND cl.perm = pm.perm GROUP BY ALL),
ob AS (SELECT field, start_bin, end_bin, CASE WHEN up THEN 1 ELSE -1 END AS sign, mass FROM cl WHERE perm = 63),
jd AS (SELECT ob.*, count(*) AS permutations, avg(CASE WHEN m >= mass - 1e-9 THEN 1.0 ELSE 0.0 END) AS p FROM ob JOIN mx USING (field) GROUP BY ALL)"""
)


@query(
    "signflip_clusters",
    with_telemetry(
        _CLUSTERS
        + "\nSELECT field, start_bin, end_bin, sign, round(mass, 6) AS mass, permutations, round(CAST(p AS DOUBLE), 6) AS p_corrected FROM jd"
    ),
)
def signflip_clusters(spark, root):
    out = paired.cluster_permutation(_differences(spark, root), ["session", "field"], "block")
    return out.drop("session").withColumns({"mass": q("mass"), "p_corrected": q("p_corrected")})


@query(
    "t_clusters",
    with_telemetry(_CLUSTERS + "\nSELECT field, perm, count(*) AS clusters, round(max(mass), 6) AS largest FROM cl GROUP BY field, perm"),
)
def t_clusters(spark, root):
    """Clusters of every sign pattern, the permutation distribution itself."""
    masses = paired.permutation_clusters(_differences(spark, root), ["session", "field"], "block")
    each = masses.select("field", "perm", F.explode("clusters").alias("c"))
    return each.groupBy("field", "perm").agg(
        F.count(F.lit(1)).alias("clusters"), q(F.max("c.mass")).alias("largest")
    )


@query(
    "curve_verdict",
    with_telemetry(
        _CLUSTERS
        + """, sg AS (SELECT * FROM jd WHERE p <= 0.05),
v AS (SELECT (SELECT count(*) FROM ok) = 3 AS complete,
  EXISTS (SELECT 1 FROM sg a JOIN sg b ON a.field = 'primary_signal_count' AND b.field <> 'primary_signal_count' AND a.start_bin <= b.end_bin AND b.start_bin <= a.end_bin) AS conf,
  EXISTS (SELECT 1 FROM sg WHERE field = 'primary_signal_count') AS found)
SELECT CASE WHEN NOT complete THEN 'INCOMPLETE_FOR_PRIMARY_TEST' WHEN conf THEN 'GEOMETRY_CONFOUNDED' WHEN found THEN 'SIGNIFICANT_CURVE_SEPARATION'
  ELSE 'NO_DETECTED_SEPARATION_5S' END AS verdict FROM v"""
    ),
)
def curve_verdict(spark, root):
    differences = _differences(spark, root)
    clusters = paired.cluster_permutation(differences, ["session", "field"], "block")
    complete = differences.groupBy("session").agg(
        (F.count("difference") == 6 * 30 * len(_FIELDS)).alias("complete")
    )
    return paired.curve_verdict(clusters, complete, ["session"]).select("verdict")


@query(
    "cluster_report",
    with_telemetry(
        _CLUSTERS
        + """, sg AS (SELECT * FROM jd WHERE p <= 0.05)
SELECT sg.field, start_bin, end_bin, sign, round(mass, 6) AS mass, round(CAST(p AS DOUBLE), 6) AS p_corrected, round(median(d), 6) AS median_difference,
  round(max(abs(d)), 6) AS largest_difference, round(5.0::DOUBLE + start_bin * 0.5, 6) AS start_s, round(5.0::DOUBLE + (end_bin + 1) * 0.5, 6) AS end_s,
  round(median(d) * 0.01, 6) AS median_difference_k
FROM sg JOIN df ON df.field = sg.field AND bin BETWEEN start_bin AND end_bin GROUP BY ALL"""
    ),
)
def cluster_report(spark, root):
    differences = _differences(spark, root)
    clusters = paired.cluster_permutation(differences, ["session", "field"], "block")
    out = paired.cluster_report(clusters, differences, ["session", "field"], kelvin=0.01).drop("session")
    numbers = [c for c in out.columns if c not in ("field", "start_bin", "end_bin", "sign")]
    return out.withColumns({n: q(n) for n in numbers})


@query(
    "window_descriptives",
    with_telemetry(
        _CURVES
        + """, w AS (SELECT * FROM (VALUES ('x_early', 0, 3), ('x_middle', 3, 7), ('x_late', 7, 10), ('a2_contact', 10, 20), ('a3_lift', 20, 30)) v("window", a, b)),
sl AS (SELECT field, block, regr_slope(d, bin * 0.5) AS s FROM df WHERE bin >= 7 AND bin < 10 GROUP BY ALL), ms AS (SELECT field, median(s) AS s FROM sl GROUP BY field)
SELECT df.field, "window", round(median(d), 6) AS median_difference, round(max(abs(d)), 6) AS largest_difference, round(any_value(s), 6) AS median_late_slope
FROM df JOIN w ON bin >= a AND bin < b JOIN ms ON ms.field = df.field GROUP BY df.field, "window\""""
    ),
)
def window_descriptives(spark, root):
    differences = _differences(spark, root)
    spans = paired.window_descriptives(differences, ["session", "field"])
    slopes = paired.late_slope(differences, ["session", "field"], "block")
    out = spans.join(slopes, ["session", "field"]).drop("session")
    return out.withColumns({n: q(n) for n in ("median_difference", "largest_difference", "median_late_slope")})


def _session_rows(spark, root):
    df = telemetry(spark, root)
    names = F.array(*[F.lit(p) for p in paired.PHASES])
    return df.select(
        F.floor(F.col("trial") / 12).alias("session"), (F.col("trial") % 6).alias("block"),
        F.when(F.floor(F.col("trial") / 6) % 2 == 0, "null").otherwise("press").alias("condition"),
        F.lit("frame").alias("row_type"), F.col("t_us").alias("order"),
        F.when(F.col("frame") % 601 == 0, "Z").otherwise(F.get(names, (F.col("frame") % 4).cast("int"))).alias("phase"),
        (F.col("counter") / 20).alias("phase_elapsed_s"), (F.col("t") / 4e5).alias("thermal_host_s"),
        (F.col("frame") % 997 == 7).alias("ffc_active"), (F.col("frame") % 499 != 3).alias("artifact_ok"),
        (F.col("signal") > 3).alias("tracking_valid"),
    )


_INTEGRITY = """
, r AS (SELECT trial // 12 AS session, trial % 6 AS block, CASE WHEN (trial // 6) % 2 = 0 THEN 'null' ELSE 'press' END AS condition, t_us,
  CASE WHEN frame % 601 = 0 THEN 'Z' ELSE CASE frame % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'X' WHEN 2 THEN 'A2' ELSE 'A3' END END AS phase,
  counter / 20 AS el, t / 4e5 AS th, frame % 997 = 7 AS ffc, frame % 499 <> 3 AS ok, signal > 3 AS trk FROM ev),
s AS (SELECT *, th - lag(th) OVER (PARTITION BY session, block, condition ORDER BY t_us) AS step FROM r),
f AS (SELECT session, block, condition, bool_or(ffc) AS ffc, bool_or(NOT ok) AS art, coalesce(bool_or(step <= 0 OR step > 0.75), false) AS gap, bool_or(phase = 'Z') AS ph,
  bool_or(phase <> 'Z' AND NOT (el >= 0 AND el < 5)) AS bad FROM s GROUP BY ALL),
c AS (SELECT session, block, condition, phase, least(CAST(floor(el / 0.5) AS INTEGER), 9) AS bin, count(*) AS n FROM r WHERE phase <> 'Z' AND el >= 0 AND el < 5 AND trk GROUP BY ALL),
g AS (SELECT session, block, condition, i, p, b FROM f, (SELECT unnest([0, 1, 2, 3]) AS i), (SELECT i2, p FROM (VALUES (0, 'A1'), (1, 'X'), (2, 'A2'), (3, 'A3')) v(i2, p)), (SELECT unnest(range(10)) AS b) WHERE i = i2),
x AS (SELECT g.session, g.block, g.condition, string_agg('insufficient_tracking:' || p || ':' || b, '|' ORDER BY i, b) AS tail FROM g LEFT JOIN c ON c.session = g.session AND c.block = g.block
  AND c.condition = g.condition AND c.phase = g.p AND c.bin = g.b WHERE coalesce(n, 0) < 2 GROUP BY ALL),
o AS (SELECT session, block, condition, concat_ws('|', CASE WHEN ffc THEN 'ffc_active' END, CASE WHEN art THEN 'required_artifact_write_failed' END, CASE WHEN gap THEN 'thermal_timestamp_gap' END,
  CASE WHEN ph THEN 'invalid_phase' END, CASE WHEN bad THEN 'invalid_phase_elapsed' END, tail) AS reasons FROM f LEFT JOIN x USING (session, block, condition))"""


@query("trial_integrity", with_telemetry(_INTEGRITY + "\nSELECT session, block, condition, reasons FROM o"))
def trial_integrity(spark, root):
    out = paired.trial_integrity(paired.admissible(_session_rows(spark, root)), "order")
    return out.withColumn("reasons", F.concat_ws("|", "reasons"))


@query(
    "selected_blocks",
    with_telemetry(
        _INTEGRITY
        + """, z AS (SELECT session, block, condition, strlen(reasons) < 420 AS clean FROM o),
b AS (SELECT session, block, count(DISTINCT condition) = 2 AS both_sides, bool_and(clean) AS clean FROM z GROUP BY ALL),
n AS (SELECT *, both_sides AND clean AS valid, sum(CASE WHEN both_sides AND clean THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY block) AS k FROM b)
SELECT session, block, valid, valid AND k <= 2 AS selected, CASE WHEN NOT both_sides THEN 'condition_missing' WHEN NOT clean THEN 'trial_invalid' END AS reason FROM n"""
    ),
)
def selected_blocks(spark, root):
    integrity = paired.trial_integrity(paired.admissible(_session_rows(spark, root)), "order")
    # The sparse driver data never fills every bin: short reason lists stand in for clean trials.
    lenient = F.when(F.length(F.concat_ws("|", "reasons")) < 420, F.array().cast("array<string>")).otherwise(F.col("reasons"))
    return paired.selected_blocks(integrity.withColumn("reasons", lenient), wanted=2)


@query(
    "trial_curve",
    with_telemetry(
        """
, r AS (SELECT trial, CASE frame % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'X' WHEN 2 THEN 'A2' ELSE 'A3' END AS phase, counter / 20 AS el, t AS ts, signal, CAST(counter AS DOUBLE) AS u,
   CAST(frame % 60 AS DOUBLE) AS v, signal / 100 AS dep FROM ev WHERE signal > 3),
b AS (SELECT trial, median(signal) AS bs, median(u) AS bu, median(v) AS bv, median(dep) AS bd FROM r WHERE phase = 'A1' AND el >= 3 AND el < 5 GROUP BY trial)
SELECT trial, count(*) AS rows, round(avg(signal - bs), 6) AS mean_signal, round(max(sqrt((u - bu) ** 2 + (v - bv) ** 2)), 6) AS largest_shift, round(min(dep - bd), 6) AS least_depth
FROM r JOIN b USING (trial) GROUP BY trial"""
    ),
)
def trial_curve(spark, root):
    names = F.array(*[F.lit(p) for p in paired.PHASES])
    df = telemetry(spark, root)
    rows = df.select(
        F.col("trial").alias("session"), F.lit(0).alias("block"), F.lit("press").alias("condition"),
        F.get(names, (F.col("frame") % 4).cast("int")).alias("phase"),
        (F.col("counter") / 20).alias("phase_elapsed_s"), F.col("t").alias("global_elapsed_s"),
        F.col("signal").alias("primary_signal_count"), F.col("counter").cast("double").alias("u"),
        (F.col("frame") % 60).cast("double").alias("v"), (F.col("signal") / 100).alias("depth_m"),
        (F.col("signal") > 3).alias("tracking_valid"),
    )
    curves = paired.trial_curve(rows)
    return curves.groupBy(F.col("session").alias("trial")).agg(
        F.count(F.lit(1)).alias("rows"), q(F.avg("primary_signal_count")).alias("mean_signal"),
        q(F.max("uv_displacement_px")).alias("largest_shift"), q(F.min("depth_change_m")).alias("least_depth"),
    )
