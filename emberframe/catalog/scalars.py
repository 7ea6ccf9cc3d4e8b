"""Scalar expressions over the driver tables: parsing, clocks, labels, geometry, cameras."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import q, table, telemetry, with_telemetry
from emberframe.catalog.registry import query
from emberframe.functions import arrays, geometry, numbers, protocol, text
from emberframe.operators import association, pixels
from emberframe.plans import protocols

_TEXTS = ("", "nan", "inf", "abc", " 12.5 ", None)


@query(
    "number_parsing",
    """
WITH s AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'inf' WHEN 3 THEN 'abc' WHEN 4 THEN ' 12.5 ' WHEN 5 THEN NULL ELSE CAST(event_id % 50 AS VARCHAR) || '.25' END AS raw FROM events)
SELECT event_id, CASE WHEN isfinite(TRY_CAST(trim(raw) AS DOUBLE)) THEN TRY_CAST(trim(raw) AS DOUBLE) END AS lenient,
  CASE WHEN raw IS NULL THEN 'missing' WHEN trim(raw) = '' THEN 'blank' WHEN TRY_CAST(trim(raw) AS DOUBLE) IS NULL THEN 'invalid' END AS problem FROM s""",
)
def number_parsing(spark, root):
    events = table(spark, root, "events").select("event_id")
    pick = F.get(F.array(*[F.lit(t) for t in _TEXTS]), (F.col("event_id") % 8).cast("int"))
    plain = F.concat((F.col("event_id") % 50).cast("string"), F.lit(".25"))
    raw = F.when(F.col("event_id") % 8 >= len(_TEXTS), plain).otherwise(pick)
    rows = events.withColumn("raw", raw)
    return rows.select(
        "event_id", numbers.lenient_number(F.col("raw")).alias("lenient"),
        numbers.number_error(F.col("raw")).alias("problem"),
    )


@query(
    "first_bad_number",
    """
WITH s AS (SELECT user_id, event_id, CASE event_id % 40 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE '1' END AS raw FROM events),
e AS (SELECT *, CASE WHEN raw IS NULL THEN 'missing' WHEN raw = '' THEN 'blank' WHEN raw = 'x' THEN 'invalid' END AS problem FROM s)
SELECT user_id, count(problem) AS bad_rows, arg_min(CASE WHEN problem IS NOT NULL THEN problem END, CASE WHEN problem IS NOT NULL THEN event_id END) AS first_problem FROM e GROUP BY user_id""",
)
def first_bad_number(spark, root):
    rows = table(spark, root, "events").select("user_id", "event_id").withColumn(
        "raw",
        F.when(F.col("event_id") % 40 == 0, "").when(F.col("event_id") % 40 == 1, "x")
        .when(F.col("event_id") % 40 != 2, "1"),
    )
    rows = rows.withColumn("problem", numbers.number_error(F.col("raw")))
    return rows.groupBy("user_id").agg(
        F.count("problem").alias("bad_rows"),
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("event_id"))).alias("first_problem"),
    )


@query(
    "flags_and_truth",
    """
WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' True ' WHEN 1 THEN 'YES' WHEN 2 THEN '1' WHEN 3 THEN 'true' WHEN 4 THEN '0' ELSE NULL END AS raw FROM events)
SELECT event_id, coalesce(lower(trim(raw)) IN ('1', 'true', 'yes'), false) AS truth, coalesce(raw IN ('true', '1'), false) AS persisted FROM s""",
)
def flags_and_truth(spark, root):
    words = F.array(*[F.lit(w) for w in (" True ", "YES", "1", "true", "0", None)])
    rows = table(spark, root, "events").select("event_id").withColumn(
        "raw", F.get(words, (F.col("event_id") % 6).cast("int"))
    )
    return rows.select(
        "event_id", numbers.truthy(F.col("raw")).alias("truth"), numbers.persisted_flag(F.col("raw")).alias("persisted")
    )


@query(
    "phase_clock",
    with_telemetry(
        """
, s AS (SELECT frame, counter / 4.0 AS el FROM ev)
SELECT frame, CASE WHEN el < 20 THEN list_extract(['A1', 'X', 'A2', 'A3'], CAST(floor(el / 5) AS INTEGER) + 1) END AS phase,
  CAST(CASE WHEN el < 20 THEN el - floor(el / 5) * 5 END AS DOUBLE) AS within, CAST(CASE WHEN el < 20 THEN el END AS DOUBLE) AS whole,
  list_extract(['LIGHT_A', 'HARD', 'LIGHT_B'], CAST(floor(el / 8) AS INTEGER) + 1) AS round_phase,
  CAST(CASE WHEN el >= 5 AND el < 20 THEN floor((el - 5) / 0.5) END AS INTEGER) AS bin FROM s"""
    ),
)
def phase_clock(spark, root):
    el = F.col("counter") / 4.0
    rows = telemetry(spark, root).select("frame", el.alias("el"))
    el = F.col("el")
    phase, within = protocol.phase_at(el), protocol.phase_elapsed(el)
    return rows.select(
        "frame", phase.alias("phase"), within.alias("within"),
        protocol.global_elapsed(phase, within).alias("whole"),
        protocol.phase_at(el, protocol.ROUND_PHASES, 8.0).alias("round_phase"),
        numbers.half_open_bin(el, 5.0, 0.5, 20.0).alias("bin"),
    )


@query(
    "force_labels",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 >= 0.7 THEN 'hard' WHEN l_quantity / 50 <= 0.5 THEN 'not_hard' ELSE 'ambiguous' END AS label,
  round(100.0 * (50 - l_quantity) / 50, 6) AS compression_pct, round(l_quantity / 100.0 * l_extendedprice, 4) AS target_force,
  round(least(greatest(l_quantity / 40, 0), 1), 6) AS progress, round(10 + 30 * least(greatest(l_quantity / 40, 0), 1), 6) AS goal FROM lineitem""",
)
def force_labels(spark, root):
    share = F.col("l_quantity") / 50
    done = protocol.progress(F.col("l_quantity"), F.lit(40.0))
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", protocol.force_label(share).alias("label"),
        q(protocol.compression_percent(F.col("l_quantity"), F.lit(50.0))).alias("compression_pct"),
        q(protocol.target_force(F.col("l_quantity"), F.col("l_extendedprice")), 4).alias("target_force"),
        q(done).alias("progress"), q(protocol.ramp(F.lit(10.0), F.lit(40.0), done)).alias("goal"),
    )


@query(
    "marker_geometry",
    """
SELECT l_orderkey, l_linenumber, round(sqrt((l_quantity - l_linenumber) ** 2 + (l_discount - l_tax) ** 2), 6) AS distance,
  round((l_linenumber + l_quantity) / 2, 6) AS mid_x, round((l_tax + l_discount) / 2, 6) AS mid_y,
  round(degrees(atan2(l_discount - l_tax, l_quantity - l_linenumber)), 6) AS angle,
  round(l_linenumber * (160 / 640), 6) AS px, round(l_tax * (120 / 480), 6) AS py FROM lineitem""",
)
def marker_geometry(spark, root):
    at = (F.col("l_linenumber"), F.col("l_tax"), F.col("l_quantity"), F.col("l_discount"))
    middle = geometry.marker_midpoint(*at)
    moved = geometry.rescaled_point(F.col("l_linenumber"), F.col("l_tax"), (480, 640), (120, 160))
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", q(geometry.marker_distance(*at)).alias("distance"),
        q(middle["x"]).alias("mid_x"), q(middle["y"]).alias("mid_y"), q(geometry.marker_angle(*at)).alias("angle"),
        q(moved["x"]).alias("px"), q(moved["y"]).alias("py"),
    )


_LM = """
WITH l AS (SELECT vec_id, CAST(embedding[9] AS DOUBLE) AS tx, CAST(embedding[10] AS DOUBLE) AS ty, CAST(embedding[17] AS DOUBLE) AS ix, CAST(embedding[18] AS DOUBLE) AS iy,
  CAST(embedding[11] AS DOUBLE) AS mx, CAST(embedding[12] AS DOUBLE) AS my, CAST(embedding[35] AS DOUBLE) AS px, CAST(embedding[36] AS DOUBLE) AS py,
  CAST(embedding[47] AS DOUBLE) AS td, CAST(embedding[51] AS DOUBLE) AS id FROM embeddings),
a AS (SELECT vec_id, abs(tx) * 4 AS tx, abs(ty) AS ty, abs(ix) AS ix, abs(iy) AS iy, abs(mx) AS mx, abs(my) AS my, abs(px) AS px, abs(py) AS py, td, id FROM l),
d AS (SELECT *, sqrt(((mx - px) * 640) ** 2 + ((my - py) * 480) ** 2) AS palm, tx <= 1 AND ty <= 1 AND ix <= 1 AND iy <= 1 AND mx <= 1 AND my <= 1 AND px <= 1 AND py <= 1 AS inside FROM a)"""


def _landmarks(spark, root):
    value = lambda i: F.get("embedding", i).cast("double")
    xy = F.array(
        *[
            F.struct((F.abs(value(2 * i)) * (4 if i == 4 else 1)).alias("x"), F.abs(value(2 * i + 1)).alias("y"))
            for i in range(21)
        ]
    )
    depths = F.array(*[value(42 + i) for i in range(21)])
    return table(spark, root, "embeddings").select("vec_id", xy.alias("xy"), depths.alias("depths"))


@query(
    "pinch_geometry",
    _LM
    + """
SELECT vec_id, round(CASE WHEN inside AND palm > 0 THEN sqrt(((tx - ix) * 640) ** 2 + ((ty - iy) * 480) ** 2) / palm END, 6) AS pinch_distance_2d_norm,
  round(CASE WHEN td > 0 AND id > 0 THEN abs(td - id) END, 6) AS pinch_depth_delta_m,
  CASE WHEN NOT inside THEN 'REQUIRED_XY_OUT_OF_BOUNDS' WHEN palm <= 0 THEN 'DEGENERATE_PALM_SCALE' WHEN td <= 0 AND id <= 0 THEN 'INVALID_BOTH_TIP_DEPTHS'
    WHEN td <= 0 THEN 'INVALID_THUMB_TIP_DEPTH' WHEN id <= 0 THEN 'INVALID_INDEX_TIP_DEPTH' ELSE 'OK' END AS reason FROM d""",
)
def pinch_geometry(spark, root):
    rows = _landmarks(spark, root).withColumn("g", geometry.pinch_geometry(F.col("xy"), F.col("depths"), 640, 480))
    return rows.select(
        "vec_id", q("g.pinch_distance_2d_norm").alias("pinch_distance_2d_norm"),
        q("g.pinch_depth_delta_m").alias("pinch_depth_delta_m"), F.col("g.reason").alias("reason"),
    )


@query(
    "hand_covariates",
    """
WITH l AS (SELECT vec_id, CAST(embedding[i] AS DOUBLE) AS a, CAST(embedding[i + 1] AS DOUBLE) AS b, i FROM embeddings, (SELECT unnest(range(1, 42, 2)) AS i)),
g AS (SELECT vec_id, abs(a) AS x, abs(b) AS y, i, abs(a) * CASE WHEN i = 9 THEN 4 ELSE 1 END AS xx FROM l),
p AS (SELECT vec_id, least(greatest(((xx - 0.1) * 0.2 + (y - 0.2) * 0.1) / 0.05, 0), 1) AS s, xx, y, i FROM g),
m AS (SELECT vec_id, min(sqrt((xx - (0.1 + s * 0.2)) ** 2 + (y - (0.2 + s * 0.1)) ** 2)) AS gap,
  sqrt((max(CASE WHEN i = 9 THEN xx END) - max(CASE WHEN i = 17 THEN xx END)) ** 2 + (max(CASE WHEN i = 9 THEN y END) - max(CASE WHEN i = 17 THEN y END)) ** 2) AS pinch FROM p GROUP BY vec_id),
d AS (SELECT vec_id, median(v) AS depth FROM (SELECT vec_id, CAST(embedding[43 + j] AS DOUBLE) AS v FROM embeddings, (SELECT unnest([0, 1, 2, 5, 9, 13, 17]) AS j)) WHERE v >= 0.02 AND v <= 0.3 GROUP BY vec_id),
t AS (SELECT vec_id, CAST(embedding[47] AS DOUBLE) AS td FROM embeddings)
SELECT m.vec_id, round(gap, 6) AS gap, round(pinch, 6) AS pinch, round(least(greatest((pinch - 0.05) / 0.2 * 100, 0), 100), 6) AS opening,
  round(coalesce(depth, CASE WHEN td >= 0.02 AND td <= 0.3 THEN td END), 6) AS depth FROM m JOIN t USING (vec_id) LEFT JOIN d ON d.vec_id = m.vec_id""",
)
def hand_covariates(spark, root):
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    flat = F.transform("xy", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("z")))
    rows = _landmarks(spark, root).withColumn("pinch", geometry.pinch_distance(flat))
    return rows.select(
        "vec_id", q(geometry.point_segment_gap(F.col("xy"), point(0.1, 0.2), point(0.3, 0.3))).alias("gap"),
        q("pinch").alias("pinch"), q(geometry.opening_percent(F.col("pinch"), 0.05, 0.25)).alias("opening"),
        q(geometry.palm_depth(F.col("depths"), 0.02, 0.3)).alias("depth"),
    )


@query(
    "finger_points",
    """
WITH l AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d,
  CAST(embedding[5] AS DOUBLE) AS e, CAST(embedding[6] AS DOUBLE) AS f, CAST(embedding[7] AS DOUBLE) AS g, CAST(embedding[8] AS DOUBLE) AS h FROM embeddings)
SELECT vec_id, round(a + (c - a) / 3, 6) AS distal_u, round(b + (d - b) / 3, 6) AS distal_v, round((e + g) / 2, 6) AS reference_u, round((f + h) / 2, 6) AS reference_v,
  round(a + 0.25 * (c - a), 6) AS inward_25_x, round(b + 0.5 * (d - b), 6) AS inward_50_y, round(0.5 * (a + e), 6) AS centre_u,
  (h < b OR (h = b AND g < a)) AS flipped FROM l""",
)
def finger_points(spark, root):
    value = lambda i: F.get("embedding", i).cast("double")
    uv = lambda i: F.struct(value(2 * i).alias("u"), value(2 * i + 1).alias("v"))
    xy = lambda i: F.struct(value(2 * i).alias("x"), value(2 * i + 1).alias("y"))
    tip = lambda name, i: F.struct(F.lit(name).alias("label"), F.array(value(2 * i), value(2 * i + 1)).alias("thermal_uv"))
    rows = table(spark, root, "embeddings").withColumns(
        {
            "c": geometry.finger_centres(uv(0), uv(1), uv(2), uv(3)),
            "w": geometry.inward_points(xy(0), xy(1)),
            "m": geometry.pinch_centre(F.array(tip("index_tip", 2), tip("thumb_tip", 0))),
            "k": F.array(*[xy(i) for i in range(4)]),
        }
    )
    corners = geometry.canonical_corners(F.col("k"))
    return rows.select(
        "vec_id", q("c.distal.u").alias("distal_u"), q("c.distal.v").alias("distal_v"),
        q("c.reference.u").alias("reference_u"), q("c.reference.v").alias("reference_v"),
        q(F.col("w")[0]["x"]).alias("inward_25_x"), q(F.col("w")[1]["y"]).alias("inward_50_y"),
        q(F.get("m", 0)).alias("centre_u"), (corners[0] != F.col("k")[0]).alias("flipped"),
    )


@query(
    "similarity_registration",
    """
WITH s AS (SELECT l_orderkey, l_linenumber, 10.0::DOUBLE AS blx, 20.0::DOUBLE AS bly, 60.0::DOUBLE AS brx, 25.0::DOUBLE AS bry, l_linenumber + 10 AS lx, 20 + l_tax * 10 AS ly,
   l_linenumber + 10 + l_quantity AS rx, 20 + l_discount * 30 AS ry FROM lineitem),
t AS (SELECT *, sqrt((rx - lx) ** 2 + (ry - ly) ** 2) / sqrt((brx - blx) ** 2 + (bry - bly) ** 2) AS k, atan2(ry - ly, rx - lx) - atan2(bry - bly, brx - blx) AS a FROM s),
u AS (SELECT *, lx - k * (cos(a) * blx - sin(a) * bly) AS tx, ly - k * (sin(a) * blx + cos(a) * bly) AS ty FROM t),
r AS (SELECT *, least(greatest(CAST(round_even(24 * k, 0) AS INTEGER), 1), 160) AS w, least(greatest(CAST(round_even(18 * k, 0) AS INTEGER), 1), 120) AS h,
  round_even(k * (cos(a) * 33 - sin(a) * 47) + tx, 0) AS x0, round_even(k * (sin(a) * 33 + cos(a) * 47) + ty, 0) AS y0 FROM u)
SELECT l_orderkey, l_linenumber, rx - lx AS quantity, round(k, 6) AS scale, round(degrees(a), 6) AS angle_deg, round(tx, 5) AS tx, round(ty, 5) AS ty,
  CAST(least(greatest(x0, 0), 160 - w) AS INTEGER) AS x, CAST(least(greatest(y0, 0), 120 - h) AS INTEGER) AS y, w AS width, h AS height FROM r""",
)
def similarity_registration(spark, root):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    line, tax, disc, qty = (F.col(c) for c in ("l_linenumber", "l_tax", "l_discount", "l_quantity"))
    rows = table(spark, root, "lineitem").withColumn(
        "t",
        geometry.similarity(
            point(F.lit(10.0), F.lit(20.0)), point(F.lit(60.0), F.lit(25.0)),
            point(line + 10, 20 + tax * 10), point(line + 10 + qty, 20 + disc * 30),
        ),
    )
    rows = rows.withColumn("r", geometry.move_region(F.col("t"), geometry.region(33, 47, 24, 18), 160, 120))
    return rows.select(
        "l_orderkey", "l_linenumber", ((line + 10 + qty) - (line + 10)).alias("quantity"),
        q("t.scale").alias("scale"), q("t.angle_deg").alias("angle_deg"), q("t.tx", 5).alias("tx"), q("t.ty", 5).alias("ty"),
        *[F.col(f"r.{c}").alias(c) for c in ("x", "y", "width", "height")],
    )


@query(
    "region_checks",
    """
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) * 3 AS x, CAST(l_discount * 1000 AS INTEGER) AS y, CAST(l_tax * 400 AS INTEGER) + 8 AS w, l_linenumber * 5 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, x, concat_ws('|', CASE WHEN x + w > 160 OR y + h > 120 THEN 'foam_bbox lies outside thermal frame' END,
  CASE WHEN y + h > 105 THEN 'foam_bbox overlaps thermal overlay band' END, CASE WHEN NOT (x <= 70 AND y <= 50 AND x + w >= 90 AND y + h >= 62) THEN 'foam_center must lie inside foam_bbox' END,
  CASE WHEN w < 24 THEN 'foam_bbox is narrower than 24 thermal pixels' END,
  CASE WHEN NOT (x + w / 2 BETWEEN 75 AND 85 AND y + h / 2 BETWEEN 55 AND 65) THEN 'foam_bbox center is outside the required x=80+/-5, y=60+/-5 placement' END,
  CASE WHEN w < 15 OR h < 15 THEN 'background must be at least 15x15 thermal pixels' END) AS issues,
  round(sqrt(greatest(100 - (x + w), x - 120, 0) ** 2 + greatest(10 - (y + h), y - 40, 0) ** 2), 6) AS gap, x || ',' || y || ',' || w || ',' || h AS text FROM s""",
)
def region_checks(spark, root):
    box = geometry.region(
        F.col("l_quantity").cast("int") * 3, F.rint(F.col("l_discount") * 1000).cast("int"),
        F.rint(F.col("l_tax") * 400).cast("int") + 8, F.col("l_linenumber") * 5,
    )
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b"))
    b = F.col("b")
    background = geometry.region(F.lit(0), F.lit(0), b["width"], b["height"])
    big = geometry.region(0, 0, 12, 12)
    regions = {
        "foam_bbox": b, "foam_center": geometry.region(70, 50, 20, 12), "left_contact": big, "right_contact": big,
        "background": background, "room_reference": big, "warm_reference": big,
    }
    issues = pixels.region_issues(regions, 160, 120, preflight=True)
    shown = text.format_region(b["x"], b["y"], b["width"], b["height"])
    return rows.select(
        "l_orderkey", "l_linenumber", b["x"].alias("x"), F.concat_ws("|", issues).alias("issues"),
        q(geometry.rectangle_gap(b, geometry.region(100, 10, 20, 30))).alias("gap"), shown.alias("text"),
    )


@query(
    "region_text_round_trip",
    """
WITH s AS (SELECT l_orderkey, l_linenumber, l_shipdate, CASE l_linenumber % 4 WHEN 0 THEN '1,2,3' WHEN 1 THEN l_suppkey || ', ' || l_partkey || ',' || l_linenumber || ',5' WHEN 2 THEN '-1,2,3,4' ELSE '1,x,3,4' END AS t FROM lineitem),
p AS (SELECT *, string_split(t, ',') AS a FROM s), c AS (SELECT *, TRY_CAST(trim(a[1]) AS INTEGER) AS x, TRY_CAST(trim(a[2]) AS INTEGER) AS y, TRY_CAST(trim(a[3]) AS INTEGER) AS w, TRY_CAST(trim(a[4]) AS INTEGER) AS h FROM p)
SELECT l_orderkey, l_linenumber, CASE WHEN len(a) = 4 AND x >= 0 AND y >= 0 AND w > 0 AND h > 0 THEN x + y * 7 + w * 11 + h * 13 END AS code FROM c""",
)
def region_text_round_trip(spark, root):
    kind = F.col("l_linenumber") % 4
    good = F.concat_ws(
        ",", "l_suppkey", F.concat(F.lit(" "), F.col("l_partkey").cast("string")), F.col("l_linenumber").cast("string"), F.lit("5")
    )
    shown = F.when(kind == 0, "1,2,3").when(kind == 1, good).when(kind == 2, "-1,2,3,4").otherwise("1,x,3,4")
    rows = table(spark, root, "lineitem").withColumn("r", text.parse_region(shown))
    code = F.col("r.x") + F.col("r.y") * 7 + F.col("r.width") * 11 + F.col("r.height") * 13
    return rows.select("l_orderkey", "l_linenumber", code.alias("code"))


@query(
    "label_strings",
    with_telemetry(
        """
, r AS (SELECT phase, trial % 4 AS rep, corr(counter, signal) AS c FROM ev GROUP BY ALL),
s AS (SELECT phase, string_agg('rep' || rep || ':' || format('{:.3f}', c), ';' ORDER BY rep) AS labels, round(sum(CAST(format('{:.3f}', c) AS DOUBLE)), 6) AS total FROM r GROUP BY phase)
SELECT phase, labels, total FROM s"""
    ),
)
def label_strings(spark, root):
    each = telemetry(spark, root).groupBy("phase", (F.col("trial") % 4).alias("rep")).agg(
        numbers.guarded_correlation(F.col("counter"), F.col("signal")).alias("c")
    )
    label = F.concat(F.lit("rep"), F.col("rep").cast("string"))
    rows = each.groupBy("phase").agg(text.labelled_values(label, F.col("c")).alias("labels"))
    parsed = text.parse_labelled_values(F.col("labels"))
    return rows.withColumn("total", q(F.aggregate(parsed, F.lit(0.0), lambda acc, p: acc + p["value"])))


@query(
    "pressure_roi",
    """
WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 1 THEN l_quantity * 3 END AS tx, l_discount * 900 AS ty, CASE WHEN l_linenumber % 3 <> 1 THEN l_quantity * 2 + 10 END AS ix, l_tax * 1000 AS iy FROM lineitem),
k AS (SELECT *, tx IS NOT NULL AS th, ix IS NOT NULL AS ih, coalesce(tx >= 120 OR ty >= 60, false) AND tx IS NOT NULL AS bt, coalesce(ix >= 120 OR iy >= 60, false) AND ix IS NOT NULL AS bi FROM s),
m AS (SELECT *, CASE WHEN bt OR bi THEN 'projection_out_of_fov' WHEN th AND ih THEN 'tips' WHEN NOT th AND NOT ih THEN 'missing_tip_depth' ELSE 'single_tip' END AS mode FROM k),
b AS (SELECT *, CASE mode WHEN 'tips' THEN floor(least(tx, ix) - 5) WHEN 'single_tip' THEN floor(coalesce(tx, ix) - 5) END AS x0, CASE mode WHEN 'tips' THEN floor(least(ty, iy) - 5) WHEN 'single_tip' THEN floor(CASE WHEN th THEN ty ELSE iy END - 5) END AS y0,
  CASE mode WHEN 'tips' THEN ceil(greatest(tx, ix) + 6) WHEN 'single_tip' THEN ceil(coalesce(tx, ix) + 6) END AS x1, CASE mode WHEN 'tips' THEN ceil(greatest(ty, iy) + 6) WHEN 'single_tip' THEN ceil(CASE WHEN th THEN ty ELSE iy END + 6) END AS y1 FROM m),
c AS (SELECT *, greatest(x0, 0) AS cx0, greatest(y0, 0) AS cy0, least(x1, 120) AS cx1, least(y1, 60) AS cy1 FROM b)
SELECT l_orderkey, l_linenumber, ty, mode, CAST(CASE WHEN x0 IS NOT NULL AND cx1 > cx0 AND cy1 > cy0 THEN cx0 END AS INTEGER) AS x, CAST(CASE WHEN x0 IS NOT NULL AND cx1 > cx0 AND cy1 > cy0 THEN cy1 - cy0 END AS INTEGER) AS height,
  round(coalesce(CASE WHEN x0 IS NOT NULL AND cx1 > cx0 AND cy1 > cy0 THEN (cx1 - cx0) * (cy1 - cy0) / ((x1 - x0) * (y1 - y0)) * CASE mode WHEN 'single_tip' THEN 0.5 ELSE 1 END END, 0), 6) AS quality FROM c""",
)
def pressure_roi(spark, root):
    def tip(x, y):
        seen = (x >= 0) & (x < 120) & (y >= 0) & (y < 60)
        return F.when(x.isNotNull(), F.struct(x.alias("x"), y.alias("y"), seen.alias("valid")))

    tx = F.when(F.col("l_linenumber") % 4 != 1, F.col("l_quantity") * 3)
    ix = F.when(F.col("l_linenumber") % 3 != 1, F.col("l_quantity") * 2 + 10)
    rows = table(spark, root, "lineitem").withColumn(
        "s",
        geometry.pressure_roi(
            tip(tx, F.col("l_discount") * 900), tip(ix, F.col("l_tax") * 1000), F.lit(True), 120, 60
        ),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 900).alias("ty"), F.col("s.mode").alias("mode"),
        F.col("s.roi.x").alias("x"), F.col("s.roi.height").alias("height"), q("s.quality").alias("quality"),
    )


_CAMERAS = {
    "depth": geometry.Camera(640, 480, 600.0, 610.0, 320.0, 240.0),
    "thermal": geometry.Camera(160, 120, 150.0, 151.0, 80.0, 60.0, (0.1, -0.05, 0.001, -0.002, 0.01)),
    "to_color": geometry.Rigid(((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), (0.01, 0.0, 0.0)),
    "thermal_to_color": geometry.Rigid(((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), (0.02, -0.01, 0.03)),
}


@query(
    "depth_to_thermal",
    """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 700 AS x, l_suppkey % 500 AS y, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity * 20 END AS raw FROM lineitem),
p AS (SELECT *, raw * 0.001 AS m FROM s), c AS (SELECT *, (x - 320) / 600 * m + 0.01 AS cx, (y - 240) / 610 * m AS cy, m AS cz FROM p),
t AS (SELECT *, cy + 0.01 AS tx, -(cx - 0.02) AS ty, cz - 0.03 AS tz FROM c),
n AS (SELECT *, CASE WHEN tz <> 0 THEN tx / tz END AS nx, CASE WHEN tz <> 0 THEN ty / tz END AS ny FROM t),
d AS (SELECT *, nx * nx + ny * ny AS r2 FROM n), f AS (SELECT *, 1 + r2 * (0.1 + r2 * (-0.05 + r2 * 0.01)) AS k FROM d),
u AS (SELECT *, (nx * k + 2 * 0.001 * nx * ny + -0.002 * (r2 + 2 * nx * nx)) * 150 + 80 AS u, (ny * k + 2 * -0.002 * nx * ny + 0.001 * (r2 + 2 * ny * ny)) * 151 + 60 AS v FROM f),
z AS (SELECT *, CASE WHEN NOT (x >= 0 AND x < 640 AND y >= 0 AND y < 480) THEN 'source_depth_out_of_bounds' WHEN NOT raw > 0 THEN 'depth_invalid' WHEN NOT (cz > 0 AND tz > 0) THEN 'nonpositive_or_nonfinite_geometry'
  WHEN NOT coalesce(u >= 0 AND u < 160 AND v >= 0 AND v < 120, false) THEN 'thermal_out_of_fov' ELSE 'ok' END AS status FROM u)
SELECT l_orderkey, l_linenumber, x, status, round(CASE WHEN status = 'ok' THEN u END, 4) AS u, round(CASE WHEN status = 'ok' THEN v END, 4) AS v, round(CASE WHEN status = 'ok' THEN tz END, 6) AS z FROM z""",
)
def depth_to_thermal(spark, root):
    raw = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity") * 20)
    rows = table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 700).alias("x"),
        (F.col("l_suppkey") % 500).alias("y"), raw.alias("raw_depth"),
    )
    out = association.depth_to_thermal(
        rows, 0.001, _CAMERAS["depth"], _CAMERAS["to_color"], _CAMERAS["thermal_to_color"], _CAMERAS["thermal"]
    )
    return out.select(
        "l_orderkey", "l_linenumber", "x", "status", q("u", 4).alias("u"), q("v", 4).alias("v"), q("z").alias("z")
    )


@query(
    "color_depth_association",
    """
WITH t AS (SELECT vec_id, label, CAST(CASE WHEN nx = 1 THEN 63 ELSE floor(nx * 64) END AS INTEGER) AS cx, CAST(CASE WHEN ny = 1 THEN 47 ELSE floor(ny * 48) END AS INTEGER) AS cy, nx <= 1 AND ny <= 1 AS inside FROM (
   SELECT vec_id, label + CASE WHEN vec_id % 50 = 7 THEN 1000 WHEN vec_id % 50 = 8 THEN 100 WHEN vec_id % 50 = 9 THEN 200 WHEN vec_id % 50 = 10 THEN 300 ELSE 0 END AS label, abs(CAST(embedding[1] AS DOUBLE)) * 4 AS nx, abs(CAST(embedding[2] AS DOUBLE)) * 4 AS ny FROM embeddings)),
a AS (SELECT l_orderkey % 10 AS label, l_partkey % 64 AS x, l_suppkey % 48 AS y, min(l_quantity * 20) AS raw FROM lineitem WHERE l_linenumber <= 2 AND (l_orderkey % 10 > 2 OR l_partkey % 64 > 40 AND l_partkey % 7 = 0) GROUP BY ALL),
d AS (SELECT label, x, y, raw FROM a UNION ALL SELECT label + 100, x, y, 0 FROM a WHERE x < 5 UNION ALL SELECT label + 200, x, y, -raw FROM a WHERE x < 5 UNION ALL SELECT label + 300, x - 400, y, raw FROM a WHERE x < 5
   UNION ALL SELECT label, x + 64, y, raw FROM a WHERE x < 4),
p AS (SELECT *, raw * 0.001 AS m, (x - 32) / 60 * (raw * 0.001) + 0.002 AS px, (y - 24) / 60 * (raw * 0.001) AS py FROM d),
w AS (SELECT *, px / m * 61 + 32 AS u, py / m * 61 + 24 AS v FROM p WHERE raw > 0),
i AS (SELECT * FROM w WHERE u >= 0 AND u < 64 AND v >= 0 AND v < 48),
f AS (SELECT label, max(raw) AS deepest FROM d GROUP BY label), g AS (SELECT DISTINCT label FROM i),
b AS (SELECT t.vec_id, min(sqrt((u - cx) ** 2 + (v - cy) ** 2)) AS err, arg_min({'x': x, 'raw': raw, 'm': m}, (sqrt((u - cx) ** 2 + (v - cy) ** 2), x, y, raw)) AS o FROM t JOIN i ON i.label = t.label WHERE inside GROUP BY t.vec_id)
SELECT t.vec_id, round(err, 6) AS match_error_px, o.raw AS raw_depth, CASE WHEN NOT inside THEN 'normalized_color_out_of_bounds' WHEN f.label IS NULL THEN 'color_to_depth_buffer_missing' WHEN deepest <= 0 THEN 'color_to_depth_zero_depth'
  WHEN g.label IS NULL THEN 'color_to_depth_no_match' WHEN o.x NOT BETWEEN 0 AND 63 THEN 'color_to_depth_out_of_bounds'
  WHEN NOT o.m BETWEEN 0.2 AND 0.9 THEN 'color_to_depth_depth_out_of_range' WHEN err > 0.75 THEN 'color_to_depth_match_error_exceeded' END AS reason
FROM t LEFT JOIN b USING (vec_id) LEFT JOIN f ON f.label = t.label LEFT JOIN g ON g.label = t.label""",
)
def color_depth_association(spark, root):
    """Colour pixels against sparse depth frames; some frames lack depth rows, depth or points in the image."""
    value = lambda i: F.abs(F.get("embedding", i).cast("double")) * 4
    pixel = geometry.normalized_pixel(value(0), value(1), 64, 48)
    at = F.col("vec_id") % 50
    other = F.when(at == 7, 1000).when(at == 8, 100).when(at == 9, 200).when(at == 10, 300).otherwise(0)
    targets = table(spark, root, "embeddings").select(
        (F.col("label") + other).alias("label"), F.col("vec_id").alias("target"), pixel["x"].alias("cx"), pixel["y"].alias("cy"), pixel["reason"].alias("reason")
    )
    label, x = F.col("l_orderkey") % 10, F.col("l_partkey") % 64
    some = (F.col("l_linenumber") <= 2) & ((label > 2) | ((x > 40) & (F.col("l_partkey") % 7 == 0)))
    depth = table(spark, root, "lineitem").where(some).groupBy(label.alias("label"), x.alias("x"), (F.col("l_suppkey") % 48).alias("y")).agg(
        F.min(F.col("l_quantity") * 20).alias("raw_depth")
    )
    left = depth.where("x < 5")
    depth = (
        depth.union(left.selectExpr("label + 100", "x", "y", "raw_depth * 0")).union(left.selectExpr("label + 200", "x", "y", "-raw_depth"))
        .union(left.selectExpr("label + 300", "x - 400", "y", "raw_depth")).union(depth.where("x < 4").selectExpr("label", "x + 64", "y", "raw_depth"))
    )
    still = geometry.Rigid(((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), (0.002, 0.0, 0.0))
    out = association.associate_depth(
        targets, depth, ["label"], 0.001, geometry.Camera(64, 48, 60.0, 60.0, 32.0, 24.0),
        geometry.Camera(64, 48, 61.0, 61.0, 32.0, 24.0), still,
    )
    return out.select(
        F.col("target").alias("vec_id"), q("match_error_px").alias("match_error_px"), "raw_depth", "reason"
    )


@query(
    "sensor_timing",
    with_telemetry(
        """
, s AS (SELECT frame, t + 1 AS now, t AS a, t + counter / 100 AS b FROM ev)
SELECT frame, round(now - a, 6) AS camera_age_s, round(now - b, 6) AS thermal_age_s, round(greatest(now - a, now - b), 6) AS worst_age_s, round(abs(a - b), 6) AS skew_s,
  abs(a - b) > 0.15 + greatest(abs(a), abs(b), 0.15) * 2.220446049250313e-16 AS skewed FROM s"""
    ),
)
def sensor_timing(spark, root):
    rows = telemetry(spark, root).select("frame", (F.col("t") + 1).alias("now"), F.col("t").alias("a"), (F.col("t") + F.col("counter") / 100).alias("b"))
    fields = geometry.source_fields(F.col("now"), F.col("a"), F.col("b"))
    late = numbers.limit_exceeded(F.greatest("a", "b"), F.least("a", "b"), 0.15)
    return rows.select("frame", *[q(c).alias(n) for n, c in fields.items()], late.alias("skewed"))


@query(
    "count_scales",
    """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_linenumber <= 4 THEN l_partkey * CASE WHEN l_returnflag = 'A' THEN 0.01 WHEN l_returnflag = 'R' THEN 0.1 END - 273.15 END, 6) AS celsius,
  CAST(least(255, greatest(0, (l_partkey - 100) * 255 // 900)) AS INTEGER) AS palette, round_even(l_quantity * l_discount * l_tax, 2) AS feature FROM lineitem""",
)
def count_scales(spark, root):
    resolution = F.when(F.col("l_returnflag") == "A", 0.01).when(F.col("l_returnflag") == "R", 0.1)
    rows = table(spark, root, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        q(arrays.counts_to_celsius(F.col("l_partkey"), F.col("l_linenumber") <= 4, resolution)).alias("celsius"),
        arrays.palette_index(F.col("l_partkey"), F.lit(100), F.lit(1000)).alias("palette"),
        F.bround(F.col("l_quantity") * F.col("l_discount") * F.col("l_tax"), 2).alias("feature"),
    )


@query(
    "session_scale",
    """
SELECT o_custkey, CASE WHEN bool_and(o_orderstatus <> 'P' AND o_totalprice < 400000) THEN 0.01::DOUBLE END AS temperature_scale_k FROM orders GROUP BY o_custkey""",
)
def session_scale(spark, root):
    usable = (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") < 400000)
    return table(spark, root, "orders").groupBy("o_custkey").agg(
        F.when(F.bool_and(usable), 0.01).alias("temperature_scale_k")
    )


@query(
    "gated_metrics",
    with_telemetry(
        """
SELECT frame, signal, counter FROM ev WHERE phase <> 'error' AND frame % 11 <> 0 AND frame % 13 <> 0 AND counter <> 50"""
    ),
)
def gated_metrics(spark, root):
    from emberframe.operators.gates import usable_metrics

    rows = telemetry(spark, root).withColumns(
        {
            "hand_detected": F.col("phase") != "error", "frozen_frame_flag": F.col("frame") % 11 == 0,
            "agc_jump_flag": F.col("frame") % 13 == 0,
            "pinch_norm": F.when(F.col("counter") != 50, F.col("counter").cast("double")),
        }
    )
    return usable_metrics(rows, ["pinch_norm", "signal", "t"]).select("frame", "signal", "counter")


@query(
    "plan_completeness",
    with_telemetry(
        """
, n AS (SELECT trial, counter % 3 + 1 AS recording, ['steady_state', 'hysteresis', 'release_pulses', 'start_drift', 'middle_drift', 'end_drift'][counter % 6 + 1] AS block, frame % 21 AS step_index, count(*) AS k FROM ev GROUP BY ALL),
p AS (SELECT r AS recording, b AS block, i AS step_index FROM range(1, 4) x(r),
  (SELECT 'steady_state' AS b, unnest(range(20)) AS i UNION ALL SELECT 'hysteresis', unnest(range(8)) UNION ALL SELECT 'release_pulses', unnest(range(12))
   UNION ALL VALUES ('start_drift', 0), ('middle_drift', 0), ('end_drift', 0)) y),
g AS (SELECT t.trial, p.* FROM (SELECT DISTINCT trial FROM ev) t, p)
SELECT g.trial, CAST(g.recording AS INTEGER) AS recording, g.block, CAST(g.step_index AS INTEGER) AS step_index, coalesce(k, 0) AS completions
FROM g LEFT JOIN n ON n.trial = g.trial AND n.recording = g.recording AND n.block = g.block AND n.step_index = g.step_index"""
    ),
)
def plan_completeness(spark, root):
    """How often each of the 129 steps of all recordings was completed."""
    blocks = F.array(*[F.lit(b) for b in ("steady_state", "hysteresis", "release_pulses", "start_drift", "middle_drift", "end_drift")])
    events = telemetry(spark, root).select(
        "trial", (F.col("counter") % 3 + 1).alias("recording"), F.get(blocks, F.col("counter") % 6).alias("block"), (F.col("frame") % 21).cast("int").alias("step_index")
    )
    return protocols.plan_completeness(events, protocols.recording_plan(spark), ["trial"], ["recording", "block", "step_index"])


@query(
    "realized_blocks",
    with_telemetry(
        """
, b AS (SELECT trial, counter % 10 AS block, count(*) >= 7 AS valid FROM ev GROUP BY ALL),
c AS (SELECT *, coalesce(sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY trial ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT trial, block, valid FROM c WHERE block < 6 OR (block < 8 AND before < 3)"""
    ),
)
def realized_blocks(spark, root):
    blocks = telemetry(spark, root).groupBy("trial", (F.col("counter") % 10).alias("block")).agg(
        (F.count(F.lit(1)) >= 7).alias("valid")
    )
    return protocols.realized_blocks(blocks, ["trial"], wanted=3).select("trial", "block", "valid")


_TIPS = """
tip AS (SELECT vec_id // 3 AS frame, vec_id % 3 AS tip, CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 16) AS BIGINT) AS x, CAST(floor(abs(CAST(embedding[2] AS DOUBLE)) * 16) AS BIGINT) AS y,
   CAST(floor(abs(CAST(embedding[3] AS DOUBLE)) * 12) AS BIGINT) AS u, CAST(floor(abs(CAST(embedding[4] AS DOUBLE)) * 12) AS BIGINT) AS v, CAST(embedding[5] AS DOUBLE) AS z,
   CAST(embedding[6] AS DOUBLE) > -0.15 AS seen, vec_id FROM embeddings WHERE vec_id % 3 < 2 OR CAST(embedding[7] AS DOUBLE) > 0.12)"""


def _tips(spark, root):
    """Fingertips of a frame: depth pixel, thermal cell, distance, and whether the thermal camera sees it; some frames have a third."""
    value = lambda i: F.get("embedding", i).cast("double")
    cell = lambda i, n: F.floor(F.abs(value(i)) * n)
    rows = table(spark, root, "embeddings").where((F.col("vec_id") % 3 < 2) | (value(6) > 0.12))
    return rows.select(
        F.floor(F.col("vec_id") / 3).alias("frame"), (F.col("vec_id") % 3).alias("tip"), cell(0, 16).alias("x"), cell(1, 16).alias("y"),
        cell(2, 12).alias("u"), cell(3, 12).alias("v"), value(4).alias("z"), (value(5) > -0.15).alias("seen"), "vec_id",
    )


@query(
    "tip_pair_identity",
    f"""
WITH {_TIPS.strip()},
c AS (SELECT frame, u, v, arg_min(x * 100 + y, (z, vec_id)) AS source FROM tip WHERE seen GROUP BY ALL),
w AS (SELECT frame, count(*) AS winners, count(DISTINCT source) AS sources, list(source) AS held FROM c GROUP BY frame),
f AS (SELECT frame, count(*) AS n, count(*) FILTER (NOT seen) AS lost, list(x * 100 + y) FILTER (tip < 2) AS tips FROM tip GROUP BY frame)
SELECT frame, CASE WHEN n - lost > coalesce(winners, 0) THEN 'fingertip_thermal_collision' WHEN n <> 2 OR lost <> 0 OR winners <> 2 THEN 'fingertip_sparse_pair_incomplete'
  WHEN sources <> 2 OR len(list_filter(held, lambda s: NOT list_contains(tips, s))) > 0 THEN 'fingertip_sparse_identity_mismatch' END AS issue
FROM f LEFT JOIN w USING (frame)""",
)
def tip_pair_identity(spark, root):
    """Whether both fingertips hold their own thermal cell; the nearest tip wins a cell."""
    tips = _tips(spark, root)
    nearest = tips.where("seen").groupBy("frame", "u", "v").agg(F.min_by(F.struct("x", "y"), F.struct("z", "vec_id")).alias("source"))
    winners = nearest.groupBy("frame").agg(F.collect_list(F.struct("u", "v", "source")).alias("winners"))
    counts = tips.groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("seen"), 1)).alias("lost"), F.collect_list(F.when(F.col("tip") < 2, F.struct("x", "y"))).alias("tips")
    )
    none = F.array().cast(winners.schema["winners"].dataType)
    joined = counts.join(winners, "frame", "left").withColumn("winners", F.coalesce("winners", none))
    return joined.select("frame", association.tip_pair_issue(F.col("winners"), F.col("tips"), F.col("n"), F.col("lost")).alias("issue"))


@query(
    "frame_rows",
    f"""
WITH {_TIPS.strip()},
m AS (SELECT frame, min(CASE WHEN NOT seen THEN tip * 1000 + CASE WHEN z < 0 THEN 1 ELSE 2 END END) AS bad, count(*) AS tips, min(z) AS near, max(z) - min(z) AS spread FROM tip GROUP BY frame)
SELECT frame, CASE WHEN tips < 2 THEN 'tips_missing' WHEN bad IS NOT NULL THEN 'tip' || bad // 1000 || ':' || CASE WHEN bad % 1000 = 1 THEN 'behind' ELSE 'out_of_fov' END
   WHEN near < -0.25 THEN 'too_near' END AS tracking_reason,
  tips >= 2 AND bad IS NULL AND near >= -0.25 AS tracking_valid, CASE WHEN tips >= 2 AND bad IS NULL AND near >= -0.25 THEN round(spread, 6) END AS spread FROM m""",
)
def frame_rows(spark, root):
    """Every frame with its first failed check; blocked frames keep their row and lose their features."""
    mark = F.struct(
        "tip", F.concat(F.lit("tip"), "tip").alias("label"), F.when(F.col("seen"), "ok").otherwise("blocked").alias("status"),
        F.when(F.col("z") < 0, "behind").otherwise("out_of_fov").alias("reason"),
    )
    features = _tips(spark, root).groupBy("frame").agg(
        F.sort_array(F.collect_list(mark)).alias("marks"), F.min("z").alias("near"), q(F.max("z") - F.min("z")).alias("spread")
    )
    bad = association.landmark_reason(F.col("marks"))
    checks = [(F.size("marks") < 2, F.lit("tips_missing")), (bad.isNotNull(), bad), (F.col("near") < -0.25, F.lit("too_near"))]
    return association.frame_row(features, checks, ["spread"]).select("frame", "tracking_reason", "tracking_valid", "spread")
