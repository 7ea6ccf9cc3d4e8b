"""Frame features over ``embeddings`` as 8x8 frames, and cells over ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import frames, q, table, with_frames
from emberframe.catalog.registry import query
from emberframe.functions import arrays
from emberframe.functions.numbers import trimmed_mean
from emberframe.operators import pixels, windows
from emberframe.operators.ordered import Series
from emberframe.operators.statistics import nearest_rank

_BASE = """,
bf AS (SELECT trial, frame FROM (SELECT DISTINCT trial, frame FROM px)
       QUALIFY row_number() OVER (PARTITION BY trial ORDER BY frame) <= 20),
bp AS (SELECT trial, y, x, avg(v) AS m, stddev_pop(v) AS s FROM px JOIN bf USING (trial, frame) GROUP BY ALL),
nz AS (SELECT trial, avg(s) AS noise FROM bp GROUP BY trial),
d AS (SELECT px.*, v - m AS d, noise FROM px JOIN bp USING (trial, y, x) JOIN nz USING (trial))"""


def _deltas(spark, root):
    stack = frames(spark, root)
    return pixels.with_delta(stack, pixels.baseline(pixels.first_frames(stack, 20)))


@query(
    "baseline_noise",
    with_frames(_BASE + "\nSELECT trial, round(noise, 6) AS noise, (SELECT round(sum(m), 4) FROM bp WHERE bp.trial = nz.trial) AS level FROM nz"),
)
def baseline_noise(spark, root):
    base = pixels.baseline(pixels.first_frames(frames(spark, root), 20))
    return base.select("trial", q("noise").alias("noise"), q(arrays.total(F.col("baseline")), 4).alias("level"))


@query(
    "hot_mask_features",
    with_frames(
        _BASE
        + """
SELECT trial, frame, CAST(count(CASE WHEN d > greatest(noise * 3, 1) THEN 1 END) AS INTEGER) AS area_px,
  round(coalesce(avg(CASE WHEN d > greatest(noise * 3, 1) THEN d END), 0), 6) AS mean_delta,
  round(coalesce(max(CASE WHEN d > greatest(noise * 3, 1) THEN d END), 0), 6) AS max_delta FROM d GROUP BY trial, frame"""
    ),
)
def hot_mask_features(spark, root):
    out = pixels.hot_mask_features(_deltas(spark, root))
    return out.withColumns({n: q(n) for n in ("mean_delta", "max_delta")})


@query(
    "hot_mask_rows",
    with_frames(
        _BASE
        + """
SELECT trial, frame, string_agg(CASE WHEN d > greatest(noise, 1) THEN '1' ELSE '0' END, '' ORDER BY y, x) AS mask
FROM d GROUP BY trial, frame"""
    ),
)
def hot_mask_rows(spark, root):
    out = pixels.hot_mask(_deltas(spark, root), sigma=1.0)
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda m: m.cast("string")), ""))


_PROFILE = (
    "roi_mean", "roi_std", "delta_mean", "delta_std", "l1_delta", "l2_delta",
    "delta_p90", "delta_p95", "delta_p99", "frame_p2", "frame_p98",
)


@query(
    "classifier_features",
    with_frames(
        _BASE
        + """, f AS (
SELECT trial, frame, avg(v) AS roi_mean, stddev_pop(v) AS roi_std, avg(d) AS delta_mean, stddev_pop(d) AS delta_std,
  CAST(count(CASE WHEN d >= greatest(noise * 3, 1) THEN 1 END) AS INTEGER) AS pos_area,
  CAST(count(CASE WHEN d <= -greatest(noise * 3, 1) THEN 1 END) AS INTEGER) AS neg_area,
  sum(abs(d)) AS l1_delta, sqrt(sum(d * d)) AS l2_delta, quantile_cont(d, 0.9) AS delta_p90,
  quantile_cont(d, 0.95) AS delta_p95, quantile_cont(d, 0.99) AS delta_p99,
  quantile_cont(v, 0.02) AS frame_p2, quantile_cont(v, 0.98) AS frame_p98,
  string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x) AS content FROM d GROUP BY trial, frame)
SELECT trial, frame, """
        + ", ".join(f"round({n}, 9) AS {n}" for n in _PROFILE)
        + """, pos_area, neg_area,
  coalesce(content = lag(content) OVER w, false) AS frozen_frame_flag,
  coalesce(abs(frame_p98 - lag(frame_p98) OVER w) >= 8, false) AS agc_jump_flag
FROM f WINDOW w AS (PARTITION BY trial ORDER BY frame)"""
    ),
)
def classifier_features(spark, root):
    profile = pixels.frame_profile(_deltas(spark, root))
    flagged = windows.frozen_and_jump(profile, Series(("trial",), ("frame",)), "content", "frame_p98")
    return flagged.select(
        "trial", "frame", *[q(n, 9).alias(n) for n in _PROFILE],
        "pos_area", "neg_area", "frozen_frame_flag", "agc_jump_flag",
    )


def _delta_sql() -> str:
    areas = []
    for k in (1, 2, 3):
        areas.append(f"CAST(count(CASE WHEN d > noise * {k} THEN 1 END) AS INTEGER) AS ir_positive_area_{k}sigma_px")
        areas.append(f"CAST(count(CASE WHEN d < -noise * {k} THEN 1 END) AS INTEGER) AS ir_negative_area_{k}sigma_px")
    return with_frames(
        f"""{_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY trial, frame ORDER BY d DESC) AS rk FROM d)
SELECT trial, frame, round(avg(d), 8) AS ir_roi_mean_delta, round(median(d), 8) AS ir_roi_median_delta,
  round(stddev_pop(d), 8) AS ir_roi_std_delta, round(sum(CASE WHEN d > 0 THEN d ELSE 0 END), 8) AS ir_sum_positive_delta,
  round(sum(CASE WHEN d < 0 THEN -d ELSE 0 END), 8) AS ir_sum_negative_delta, round(sum(abs(d)), 8) AS ir_l1_delta,
  round(sqrt(sum(d * d)), 8) AS ir_l2_delta, round(quantile_cont(d, 0.9), 8) AS ir_p90_delta,
  round(quantile_cont(d, 0.95), 8) AS ir_p95_delta, round(quantile_cont(d, 0.99), 8) AS ir_p99_delta,
  round(avg(CASE WHEN rk <= 1 THEN d END), 8) AS ir_top_1pct_mean_delta,
  round(quantile_cont(d, 0.99), 8) AS ir_robust_max_delta, {', '.join(areas)}
FROM r GROUP BY trial, frame"""
    )


@query("delta_features", _delta_sql())
def delta_features(spark, root):
    out = pixels.delta_intensity(_deltas(spark, root))
    whole = [c for c in out.columns if c.endswith("_px") or c in ("trial", "frame")]
    return out.select(*whole, *[q(c, 8).alias(c) for c in out.columns if c not in whole])


REGIONS = {
    "foam_center": (2, 2, 3, 3), "left_contact": (0, 2, 2, 4), "right_contact": (6, 2, 2, 4),
    "background": (0, 6, 8, 2), "room_reference": (0, 0, 3, 2), "warm_reference": (5, 0, 3, 2),
}


def _region_sql() -> str:
    med = ", ".join(
        f"median(CASE WHEN x >= {x} AND x < {x + w} AND y >= {y} AND y < {y + h} THEN v END) AS {n}_median"
        for n, (x, y, w, h) in REGIONS.items()
    )
    norm = ", ".join(
        f"""CASE WHEN abs(warm_reference_median - room_reference_median) >= 1e-6 THEN
        round(({n}_median - room_reference_median) / (warm_reference_median - room_reference_median), 6)
        ELSE 'nan'::DOUBLE END AS {n}_norm"""
        for n in pixels.SIGNAL_REGIONS
    )
    return with_frames(
        f""", m AS (SELECT trial, frame, {med} FROM px GROUP BY trial, frame)
SELECT *, warm_reference_median - room_reference_median AS reference_span, {norm} FROM m"""
    )


@query("region_medians", _region_sql())
def region_medians(spark, root):
    out = pixels.reference_normalised(pixels.region_medians(frames(spark, root), REGIONS))
    norms = {f"{n}_norm": q(f"{n}_norm") for n in pixels.SIGNAL_REGIONS}
    return out.drop("height", "width").withColumns(norms)


_CENTRE = ", c AS (SELECT trial, frame, (frame % 13) / 2.0 + 0.5 AS u, (frame % 9) / 2.0 + 1.0 AS w FROM px GROUP BY ALL)"


@query(
    "patch_mean",
    with_frames(
        _CENTRE
        + """, p AS (SELECT px.*, CAST(floor(u + 0.5) AS INTEGER) AS hu, CAST(floor(w + 0.5) AS INTEGER) AS hv,
    CAST(round_even(u, 0) AS INTEGER) AS eu, CAST(round_even(w, 0) AS INTEGER) AS ev,
    CAST(floor(u) AS INTEGER) AS cu, CAST(floor(w) AS INTEGER) AS cv FROM px JOIN c USING (trial, frame))
SELECT trial, frame,
  round(CASE WHEN count(CASE WHEN abs(x - hu) <= 1 AND abs(y - hv) <= 1 THEN 1 END) = 9 THEN
    avg(CASE WHEN abs(x - hu) <= 1 AND abs(y - hv) <= 1 THEN v END) END, 6) AS strict_mean,
  round(CASE WHEN count(CASE WHEN abs(x - eu) <= 1 AND abs(y - ev) <= 1 THEN 1 END) = 9 THEN
    avg(CASE WHEN abs(x - eu) <= 1 AND abs(y - ev) <= 1 THEN v END) END, 6) AS even_mean,
  round(avg(CASE WHEN abs(x - cu) <= 1 AND abs(y - cv) <= 1 THEN v END), 6) AS clipped_mean,
  round(stddev_pop(CASE WHEN abs(x - cu) <= 1 AND abs(y - cv) <= 1 THEN v END), 6) AS clipped_std
FROM p GROUP BY trial, frame"""
    ),
)
def patch_mean(spark, root):
    u = (F.col("frame") % 13) / 2.0 + 0.5
    v = (F.col("frame") % 9) / 2.0 + 1.0
    out = pixels.patch_means(frames(spark, root), u, v, 3)
    names = ("strict_mean", "even_mean", "clipped_mean", "clipped_std")
    return out.select("trial", "frame", *[q(n).alias(n) for n in names])


@query(
    "finger_features",
    with_frames(
        """, g AS (SELECT *, frame % 7 + 0.5 AS tu, frame % 8 AS tv, (frame % 6) + 0.5 AS du, frame % 5 + 1.25 AS dv,
    3 + frame % 2 AS ru, 3 + frame % 3 AS rv FROM px),
h AS (SELECT *, CAST(floor(tu + 0.5) AS INT) AS tx, tv AS ty, CAST(floor(du + 0.5) AS INT) AS dx,
    CAST(floor(dv + 0.5) AS INT) AS dy FROM g),
a AS (SELECT trial, frame, max(CASE WHEN x = tx AND y = ty THEN v END) AS tip,
  CASE WHEN count(CASE WHEN abs(x - dx) <= 1 AND abs(y - dy) <= 1 THEN 1 END) = 9 THEN avg(CASE WHEN abs(x - dx) <= 1 AND abs(y - dy) <= 1 THEN v END) END AS d3,
  CASE WHEN count(CASE WHEN abs(x - dx) <= 2 AND abs(y - dy) <= 2 THEN 1 END) = 25 THEN avg(CASE WHEN abs(x - dx) <= 2 AND abs(y - dy) <= 2 THEN v END) END AS d5,
  CASE WHEN count(CASE WHEN abs(x - ru) <= 2 AND abs(y - rv) <= 2 THEN 1 END) = 25 THEN avg(CASE WHEN abs(x - ru) <= 2 AND abs(y - rv) <= 2 THEN v END) END AS r5
  FROM h GROUP BY trial, frame)
SELECT trial, frame, tip AS tip_raw_count, round(d3, 6) AS distal_3x3_mean_count, round(d5, 6) AS distal_5x5_mean_count,
  round(r5, 6) AS reference_5x5_mean_count, round(d3 - r5, 6) AS primary_signal_count,
  CASE WHEN tip IS NULL THEN 'tip_out_of_bounds' WHEN d3 IS NULL THEN 'distal_3x3_out_of_bounds'
       WHEN d5 IS NULL THEN 'distal_5x5_out_of_bounds' WHEN r5 IS NULL THEN 'reference_5x5_out_of_bounds' END AS reason FROM a"""
    ),
)
def finger_features(spark, root):
    point = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    frame = F.col("frame")
    out = pixels.finger_features(
        frames(spark, root),
        point(frame % 7 + 0.5, frame % 8), point(frame % 6 + 0.5, frame % 5 + 1.25),
        point(3 + frame % 2, 3 + frame % 3),
    )
    means = [c for c in out.columns if c.endswith("mean_count") or c == "primary_signal_count"]
    return out.select("trial", "frame", "tip_raw_count", "reason", *[q(c).alias(c) for c in means])


@query(
    "contrast_and_warm_centroid",
    with_frames(
        """, s AS (SELECT trial, frame, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS span,
    greatest(quantile_cont(v, 0.9), 1.0) AS thr FROM px GROUP BY trial, frame),
w AS (SELECT trial, frame, count(CASE WHEN v > thr THEN 1 END) AS n, avg(CASE WHEN v > thr THEN x END) AS u,
    avg(CASE WHEN v > thr THEN y END) AS vv, any_value(span) AS span FROM px JOIN s USING (trial, frame) GROUP BY trial, frame)
SELECT trial, frame, round(span, 6) AS frame_range, span < 380 AS low_contrast, CAST(n AS INTEGER) AS area_px,
  round(CASE WHEN n >= 4 AND span >= 380 THEN u END, 6) AS u, round(CASE WHEN n >= 4 AND span >= 380 THEN vv END, 6) AS v FROM w"""
    ),
)
def contrast_and_warm_centroid(spark, root):
    stack = frames(spark, root)
    gate = pixels.contrast_gate(stack, 380.0).select("trial", "frame", "frame_range", "low_contrast")
    warm = pixels.warm_centroid(stack, percentile=0.9, min_range=380.0)
    return gate.join(warm, ["trial", "frame"]).withColumns({n: q(n) for n in ("frame_range", "u", "v")})


@query(
    "touch_onset",
    with_frames(
        """, t AS (SELECT trial, y, x, median(v) AS m FROM px WHERE frame % 3 = 0 GROUP BY ALL),
m AS (SELECT trial, frame, avg(abs(v - m)) AS motion, frame % 3 = 0 AS quiet FROM px JOIN t USING (trial, y, x) GROUP BY ALL),
l AS (SELECT trial, greatest(avg(motion) + 6 * stddev_pop(motion), 2.0) AS thr, max(motion) AS top FROM m WHERE quiet GROUP BY trial)
SELECT trial, round(thr, 6) AS motion_threshold, round(top, 6) AS baseline_motion_max,
  min(CASE WHEN NOT quiet AND motion > thr - 60 THEN frame END) AS onset,
  count(CASE WHEN NOT quiet THEN 1 END) AS pressure_frames FROM m JOIN l USING (trial) GROUP BY trial, thr, top"""
    ),
)
def touch_onset(spark, root):
    motion = pixels.touch_motion(frames(spark, root), F.col("frame") % 3 == 0)
    pressed = ~F.col("is_baseline")
    above = pressed & (F.col("motion") > F.col("motion_threshold") - 60)
    return motion.groupBy("trial").agg(
        q(F.max("motion_threshold")).alias("motion_threshold"),
        q(F.max("baseline_motion_max")).alias("baseline_motion_max"),
        F.min(F.when(above, F.col("frame"))).alias("onset"),
        F.count(F.when(pressed, 1)).alias("pressure_frames"),
    )


@query(
    "trimmed_mean",
    with_frames(
        """, r AS (SELECT trial, frame, v, row_number() OVER (PARTITION BY trial, frame ORDER BY v) AS rn FROM px)
SELECT trial, frame, round(avg(CASE WHEN rn > 12 AND rn <= 52 THEN v END), 6) AS trimmed FROM r GROUP BY trial, frame"""
    ),
)
def trimmed_mean_query(spark, root):
    return frames(spark, root).select("trial", "frame", q(trimmed_mean(F.col("pixels"))).alias("trimmed"))


@query(
    "pixel_nearest_rank",
    with_frames(
        """, r AS (SELECT trial, v, row_number() OVER (PARTITION BY trial ORDER BY v) AS rn,
    count(*) OVER (PARTITION BY trial) AS n FROM px)
SELECT trial, any_value(n) AS rows, max(CASE WHEN rn = round_even((n - 1) * 0.005, 0) + 1 THEN v END) AS p005,
  max(CASE WHEN rn = round_even((n - 1) * 0.5, 0) + 1 THEN v END) AS p50,
  max(CASE WHEN rn = round_even((n - 1) * 0.995, 0) + 1 THEN v END) AS p995 FROM r GROUP BY trial"""
    ),
)
def pixel_nearest_rank(spark, root):
    rows = pixels.explode_pixels(frames(spark, root), "trial")
    return nearest_rank(rows, ["trial"], "v", {"p005": 0.005, "p50": 0.5, "p995": 0.995})


@query(
    "fixed_display_range",
    with_frames(
        """, s AS (SELECT trial, v + 3000 AS v FROM px),
r AS (SELECT trial, v, row_number() OVER (PARTITION BY trial ORDER BY v) AS rn, count(*) OVER (PARTITION BY trial) AS n FROM s),
a AS (SELECT trial, max(CASE WHEN rn = round_even((n - 1) * 0.005, 0) + 1 THEN v END) AS lo,
  max(CASE WHEN rn = round_even((n - 1) * 0.995, 0) + 1 THEN v END) AS hi FROM r GROUP BY trial),
b AS (SELECT *, CAST(ceil(greatest(hi - lo, 256) * 0.1) AS INTEGER) AS pad FROM a)
SELECT trial, lo AS source_p005, hi AS source_p995, greatest(0, (lo - pad) // 16 * 16) AS raw_low,
  least(65535, (hi + pad + 15) // 16 * 16) AS raw_high FROM b"""
    ),
)
def fixed_display_range(spark, root):
    from emberframe.operators.repeatability import suggest_fixed_range

    stack = frames(spark, root).withColumn("pixels", F.transform("pixels", lambda v: v + 3000))
    return suggest_fixed_range(stack, ["trial"]).drop("rows")


@query(
    "display_scaling",
    with_frames(
        """, s AS (SELECT trial, frame, round(quantile_cont(v, 0.01), 6) AS lo, round(quantile_cont(v, 0.99), 6) AS hi FROM px GROUP BY trial, frame),
n AS (SELECT px.*, least(greatest((v - lo) / (hi - lo), 0), 1) AS share, lo, hi FROM px JOIN s USING (trial, frame))
SELECT trial, frame, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi,
  CAST(sum(CAST(floor(share * 255) AS INTEGER)) AS BIGINT) AS truncated_sum,
  CAST(sum(CAST(round_even(share * 255, 0) AS INTEGER)) AS BIGINT) AS rounded_sum FROM n GROUP BY trial, frame"""
    ),
)
def display_scaling(spark, root):
    stack = frames(spark, root).withColumn("_s", F.array_sort("pixels"))
    stack = stack.withColumns({"lo": q(arrays.quantile(F.col("_s"), 0.01)), "hi": q(arrays.quantile(F.col("_s"), 0.99))})

    def summed(rounded):
        bounds = F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"))
        bytes_ = arrays.against(
            F.col("pixels"), bounds,
            lambda v, b: arrays.scaled_byte(v.cast("double"), b["lo"], b["hi"], rounded=rounded),
        )
        return arrays.total(bytes_).cast("long")

    return stack.select(
        "trial", "frame", "lo", "hi",
        summed(False).alias("truncated_sum"), summed(True).alias("rounded_sum"),
    )


@query(
    "palette_nearest",
    """
WITH p AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS idx, n_nationkey * 10 % 256 AS r,
   n_nationkey * 37 % 256 AS g, n_nationkey * 91 % 256 AS b FROM nation),
c AS (SELECT vec_id, CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 1000) AS INTEGER) % 256 AS r,
   CAST(floor(abs(CAST(embedding[2] AS DOUBLE)) * 1000) AS INTEGER) % 256 AS g,
   CAST(floor(abs(CAST(embedding[3] AS DOUBLE)) * 1000) AS INTEGER) % 256 AS b FROM embeddings)
SELECT vec_id, c.r, c.g, c.b, arg_min(p.idx, ((p.r - c.r) ** 2 + (p.g - c.g) ** 2 + (p.b - c.b) ** 2, p.idx)) AS palette_index,
  24 - arg_min(p.idx, ((p.r - c.r) ** 2 + (p.g - c.g) ** 2 + (p.b - c.b) ** 2, p.idx)) AS inverted_index,
  (any_value(c.b) * 3735 + any_value(c.g) * 19235 + any_value(c.r) * 9798 + 16384) // 32768 AS gray
FROM c, p GROUP BY vec_id, c.r, c.g, c.b""",
)
def palette_nearest(spark, root):
    key = F.col("n_nationkey")
    palette = table(spark, root, "nation").select(
        key.alias("idx"), (key * 10 % 256).alias("r"), (key * 37 % 256).alias("g"), (key * 91 % 256).alias("b")
    )
    channel = lambda i: (F.floor(F.abs(F.get("embedding", i).cast("double")) * 1000) % 256).cast("int")
    rows = table(spark, root, "embeddings").select(
        "vec_id", *[channel(i).alias(n) for i, n in enumerate("rgb")]
    )
    near = pixels.nearest_palette(rows, palette)
    flipped = pixels.nearest_palette(rows, palette, invert=True).withColumnRenamed("palette_index", "inverted_index")
    out = rows.join(near, ["r", "g", "b"]).join(flipped, ["r", "g", "b"])
    return out.withColumn("gray", arrays.gray(F.col("b"), F.col("g"), F.col("r")))


@query(
    "zbuffer_nearest",
    """
SELECT l_returnflag AS map, l_partkey % 160 AS u, l_suppkey % 120 AS v, min(l_extendedprice) AS z,
  arg_min(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber, l_quantity)) AS source_y,
  arg_min(l_linenumber, (l_extendedprice, l_orderkey, l_linenumber, l_quantity)) AS source_x,
  arg_min(l_quantity, (l_extendedprice, l_orderkey, l_linenumber, l_quantity)) AS raw_depth, count(*) AS candidates
FROM lineitem WHERE l_quantity > 1 GROUP BY ALL""",
)
def zbuffer_nearest(spark, root):
    return pixels.zbuffer(_samples(spark, root).filter(~F.col("rejected")).drop("rejected"), ["map"])


def _samples(spark, root):
    return table(spark, root, "lineitem").select(
        F.col("l_returnflag").alias("map"),
        (F.col("l_partkey") % 160).alias("u"),
        (F.col("l_suppkey") % 120).alias("v"),
        F.col("l_extendedprice").alias("z"),
        F.col("l_orderkey").alias("source_y"),
        F.col("l_linenumber").alias("source_x"),
        F.col("l_quantity").alias("raw_depth"),
        (F.col("l_quantity") <= 1).alias("rejected"),
    )


@query(
    "zbuffer_counts",
    """
SELECT l_returnflag AS map, count(*) AS input_count, count(CASE WHEN l_quantity <= 1 THEN 1 END) AS rejected_count,
  count(DISTINCT CASE WHEN l_quantity > 1 THEN (l_partkey % 160, l_suppkey % 120) END) AS winner_count,
  count(CASE WHEN l_quantity > 1 THEN 1 END) AS accepted_count,
  count(CASE WHEN l_quantity > 1 THEN 1 END)
    - count(DISTINCT CASE WHEN l_quantity > 1 THEN (l_partkey % 160, l_suppkey % 120) END) AS collision_count,
  'ok' AS status FROM lineitem GROUP BY l_returnflag""",
)
def zbuffer_counts(spark, root):
    samples = _samples(spark, root)
    winners = pixels.zbuffer(samples.filter(~F.col("rejected")), ["map"])
    return pixels.zbuffer_counts(samples, winners, ["map"], F.col("rejected"))


_MASK = ", m AS (SELECT trial, frame, y, x, CASE WHEN v > 60 THEN 1 ELSE 0 END AS m FROM px)"


@query(
    "mask_summary",
    with_frames(
        _MASK
        + """
SELECT trial, frame, CAST(sum(m) AS INTEGER) AS pixels_in_mask, round(avg(CASE WHEN m = 1 THEN x END), 6) AS centre_x,
  round(avg(CASE WHEN m = 1 THEN y END), 6) AS centre_y,
  coalesce(bool_or(m = 1 AND (x IN (0, 7) OR y IN (0, 7))), false) AS touches_boundary,
  round(count(CASE WHEN m = 1 AND x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN 1 END) / nullif(sum(m), 0), 6) AS interior_share
FROM m GROUP BY trial, frame"""
    ),
)
def mask_summary(spark, root):
    mask = F.transform("pixels", lambda v: F.when(v > 60, 1).otherwise(0))
    out = pixels.mask_summary(frames(spark, root), mask, support=2)
    return out.withColumns({n: q(n) for n in ("centre_x", "centre_y", "interior_share")})


@query(
    "mask_morphology",
    with_frames(
        _MASK
        + """, k AS (SELECT a.trial, a.frame, a.y, a.x, sum(b.m) AS n FROM m a JOIN m b ON a.trial = b.trial AND a.frame = b.frame
   AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)
SELECT trial, frame, string_agg(CASE WHEN n = 9 THEN '1' ELSE '0' END, '' ORDER BY y, x) AS eroded,
  string_agg(CASE WHEN n > 0 THEN '1' ELSE '0' END, '' ORDER BY y, x) AS dilated FROM k GROUP BY trial, frame"""
    ),
)
def mask_morphology(spark, root):
    stack = frames(spark, root).withColumn(
        "mask", F.transform("pixels", lambda v: F.when(v > 60, 1).otherwise(0))
    )
    text = lambda a: F.array_join(F.transform(a, lambda m: m.cast("string")), "")
    shape = (F.col("mask"), F.col("width"), F.col("height"), 1)
    return stack.select(
        "trial", "frame",
        text(pixels.morphology(*shape, dilate=False)).alias("eroded"),
        text(pixels.morphology(*shape, dilate=True)).alias("dilated"),
    )


@query(
    "hand_axis",
    with_frames(
        _MASK
        + """, h AS (SELECT * FROM m WHERE m = 1), e AS (SELECT trial, frame, quantile_cont(x, 0.3) AS edge FROM h GROUP BY trial, frame),
a AS (SELECT trial, frame, median(CASE WHEN x <= edge THEN x END) AS tx, median(CASE WHEN x <= edge THEN y END) AS ty,
  median(x) AS cx, median(y) AS cy FROM h JOIN e USING (trial, frame) GROUP BY trial, frame),
f AS (SELECT DISTINCT trial, frame FROM px)
SELECT trial, frame, tx AS tip_x, ty AS tip_y, cx AS centre_x, cy AS centre_y,
  round(CASE WHEN sqrt((cx - tx) ** 2 + (cy - ty) ** 2) > 0 THEN (cx - tx) / sqrt((cx - tx) ** 2 + (cy - ty) ** 2) END, 6) AS axis_x,
  round(CASE WHEN sqrt((cx - tx) ** 2 + (cy - ty) ** 2) > 0 THEN (cy - ty) / sqrt((cx - tx) ** 2 + (cy - ty) ** 2) END, 6) AS axis_y
FROM f LEFT JOIN a USING (trial, frame)"""
    ),
)
def hand_axis(spark, root):
    mask = F.transform("pixels", lambda v: F.when(v > 60, 1).otherwise(0))
    out = pixels.hand_axis(frames(spark, root), mask, tip_share=0.3)
    return out.withColumns({n: q(n) for n in ("axis_x", "axis_y")})


@query(
    "edge_padded_crop",
    with_frames(
        """, c AS (SELECT DISTINCT trial, frame, frame % 8 AS cx, frame % 5 AS cy FROM px),
o AS (SELECT trial, frame, dy, dx, least(greatest(cy + dy, 0), 7) AS y, least(greatest(cx + dx, 0), 7) AS x
  FROM c, (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx))
SELECT trial, frame, string_agg(CAST(v AS VARCHAR), ',' ORDER BY dy, dx) AS crop, count(*) AS cells
FROM o JOIN px USING (trial, frame, y, x) GROUP BY trial, frame"""
    ),
)
def edge_padded_crop(spark, root):
    cut = arrays.edge_padded_patch(
        F.col("pixels"), F.col("width"), F.col("height"),
        (F.col("frame") % 8).cast("int"), (F.col("frame") % 5).cast("int"), 3,
    )
    stack = frames(spark, root).withColumn("cut", cut)
    return stack.select(
        "trial", "frame", F.array_join(F.transform("cut", lambda v: v.cast("string")), ",").alias("crop"),
        F.size("cut").cast("long").alias("cells"),
    )


@query(
    "patch_overlap_and_depth",
    with_frames(
        """, c AS (SELECT DISTINCT trial, frame, frame % 8 AS ax, frame % 7 AS ay, (frame + 2) % 8 AS bx, (frame + 3) % 7 AS cy FROM px),
d AS (SELECT trial, frame, median(CASE WHEN abs(x - ax) <= 2 AND abs(y - ay) <= 2 AND v > 0 THEN v END) AS depth FROM px JOIN c USING (trial, frame) GROUP BY ALL)
SELECT trial, frame, least(ax + 1, bx + 1, 7) >= greatest(ax - 1, bx - 1, 0) AND least(ay + 1, cy + 1, 7) >= greatest(ay - 1, cy - 1, 0) AS overlap,
  depth FROM c JOIN d USING (trial, frame)"""
    ),
)
def patch_overlap_and_depth(spark, root):
    frame = F.col("frame")
    stack = frames(spark, root)
    ax, ay, bx, by = frame % 8, frame % 7, (frame + 2) % 8, (frame + 3) % 7
    return stack.select(
        "trial", "frame",
        pixels.patches_overlap(ax, ay, bx, by, F.col("width"), F.col("height")).alias("overlap"),
        pixels.dark_marker_depth(stack, ax, ay).alias("depth"),
    )


@query(
    "roi_crop",
    with_frames(
        """, k AS (SELECT * FROM px WHERE x >= 2 AND x < 6 AND y >= 1 AND y < 6)
SELECT trial, frame, count(*) AS cells, round(avg(v), 6) AS mean, string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x) AS crop
FROM k GROUP BY trial, frame"""
    ),
)
def roi_crop(spark, root):
    cut = pixels.crop_frames(frames(spark, root), 2, 1, 4, 5)
    return cut.select(
        "trial", "frame", F.size("pixels").cast("long").alias("cells"),
        q(arrays.mean(F.col("pixels"))).alias("mean"),
        F.array_join(F.transform("pixels", lambda v: v.cast("string")), ",").alias("crop"),
    )


@query(
    "raw_count_lookup",
    with_frames(
        """, w AS (SELECT label AS trial, vec_id AS frame, vec_id % 8 AS u, vec_id % 6 AS v FROM embeddings)
SELECT w.trial, w.frame, w.u, w.v, px.v AS raw_count FROM w JOIN px ON px.trial = w.trial AND px.frame = w.frame AND px.x = w.u AND px.y = w.v"""
    ),
)
def raw_count_lookup(spark, root):
    stack = frames(spark, root)
    winners = stack.select("trial", "frame", (F.col("frame") % 8).alias("u"), (F.col("frame") % 6).alias("v"))
    return pixels.raw_count_at(winners, stack)
