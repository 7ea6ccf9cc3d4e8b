"""Connected parts, blobs, markers, principal scores and tracking on embedding frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import frames, frames_of, q, with_frames
from emberframe.catalog.registry import query
from emberframe.operators import components, pixels, tracking
from emberframe.operators.settle import settle
from emberframe.streaming import run, timed, watches


def _mask():
    return F.transform("pixels", lambda v: v > 60)


# Label spreading over neighbours until nothing changes, as a recursive query.
def _parts_sql(near: str) -> str:
    return with_frames(
        f""", m AS (SELECT trial, frame, y, x, y * 8 + x AS pos FROM px WHERE v > 60),
e AS (SELECT a.frame, a.pos AS a, b.pos AS b FROM m a JOIN m b ON a.frame = b.frame AND {near})
, r AS (SELECT frame, pos, list_min(reach) AS root FROM (
   SELECT frame, pos, list(other) AS reach FROM walk GROUP BY frame, pos))
SELECT m.trial, m.frame, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy
FROM m JOIN r ON r.frame = m.frame AND r.pos = m.pos GROUP BY m.trial, m.frame, root"""
    ).replace("WITH px", "WITH RECURSIVE px").replace(
        "\n, r AS (", ",\nwalk AS (SELECT frame, pos, pos AS other FROM m UNION SELECT w.frame, w.pos, e.b FROM walk w JOIN e ON e.frame = w.frame AND e.a = w.other),\nr AS ("
    )


def _part_rows(spark, root, diagonal):
    parts = components.components(frames(spark, root), _mask(), diagonal=diagonal)
    return parts.select(
        "trial", "frame", "area", "x0", "y0", "x1", "y1", q("cx").alias("cx"), q("cy").alias("cy")
    )


@query("components_8", _parts_sql("abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1"))
def components_8(spark, root):
    return _part_rows(spark, root, True)


@query("components_4", _parts_sql("abs(a.x - b.x) + abs(a.y - b.y) <= 1"))
def components_4(spark, root):
    return _part_rows(spark, root, False)


_NEAR8 = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1"
_NEAR4 = "abs(a.x - b.x) + abs(a.y - b.y) <= 1"


def _labelled(mask: str, near: str, name: str = "") -> str:
    """Parts p (frame, root, area, box) of the pixels that ``mask`` selects (frame, x, y), by recursive spreading."""
    n = name
    return f"""m{n} AS MATERIALIZED ({mask}),
e{n} AS (SELECT a.frame, a.y * 8 + a.x AS a, b.y * 8 + b.x AS b FROM m{n} a JOIN m{n} b ON a.frame = b.frame AND {near}),
walk{n} AS (SELECT frame, y * 8 + x AS pos, y * 8 + x AS other FROM m{n} UNION SELECT w.frame, w.pos, e.b FROM walk{n} w JOIN e{n} e ON e.frame = w.frame AND e.a = w.other),
r{n} AS (SELECT frame, pos, min(other) AS root FROM walk{n} GROUP BY frame, pos),
p{n} AS (SELECT frame, root, count(*) AS area, min(pos % 8) AS x0, min(pos // 8) AS y0, max(pos % 8) AS x1, max(pos // 8) AS y1 FROM r{n} GROUP BY frame, root)"""


def _recursive(body: str) -> str:
    return with_frames(body).replace("WITH px", "WITH RECURSIVE px", 1)


@query(
    "hottest_blob",
    _recursive(
        ", lv AS (SELECT frame, quantile_cont(v, 0.25) + 180 AS level FROM px GROUP BY frame),\n"
        + _labelled("SELECT px.frame, x, y FROM px JOIN lv USING (frame) WHERE v >= level", _NEAR4)
        + """,
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY area DESC, root) AS k FROM p) WHERE k = 1),
c AS (SELECT f.trial, f.frame, area, greatest(0, x0 - 1) AS rx, greatest(0, y0 - 1) AS ry, least(8, x1 + 2) - greatest(0, x0 - 1) AS rw, least(8, y1 + 2) - greatest(0, y0 - 1) AS rh,
      (x1 - x0 + 3) * (y1 - y0 + 3) AS wanted FROM (SELECT DISTINCT trial, frame FROM px) f LEFT JOIN b USING (frame)),
d AS (SELECT *, CASE WHEN area IS NULL THEN 'blob_no_hotspot' WHEN area < 2 THEN 'blob_too_small' WHEN area > 20 THEN 'blob_too_large' ELSE 'blob' END AS mode FROM c)
SELECT trial, frame, mode, CASE WHEN mode = 'blob' THEN CAST(rx AS INTEGER) END AS x, CASE WHEN mode = 'blob' THEN CAST(rw AS INTEGER) END AS width,
  CASE WHEN mode = 'blob' THEN round(rw * rh / wanted * (area / (rw * rh)), 6) ELSE 0.0::DOUBLE END AS quality FROM d"""
    ),
)
def hottest_blob(spark, root):
    out = components.hottest_blob(frames(spark, root), min_delta=180.0, min_area=2, max_area=20, pad=1)
    return out.select("trial", "frame", "mode", F.col("roi.x").alias("x"), F.col("roi.width").alias("width"), q("quality").alias("quality"))


@query(
    "dark_shape",
    _recursive(
        ", "
        + _labelled("SELECT frame, x, y FROM px WHERE v < -60", _NEAR8)
        + """,
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY area DESC, root) AS k, count(*) OVER (PARTITION BY frame) AS n FROM p WHERE area > 3) WHERE k = 1)
SELECT trial, frame, coalesce(area, 0)::DOUBLE AS shape_area_px, coalesce(x1 - x0 + 1, 0)::DOUBLE AS shape_width_px, coalesce(y1 - y0 + 1, 0)::DOUBLE AS shape_height_px,
  coalesce((x1 - x0 + 1) * (y1 - y0 + 1), 0)::DOUBLE AS shape_bbox_area_px, coalesce(n, 0)::DOUBLE AS shape_components
FROM (SELECT DISTINCT trial, frame FROM px) f LEFT JOIN b USING (frame)"""
    ),
)
def dark_shape(spark, root):
    return components.dark_shape(frames(spark, root), limit=-60, min_area=3)


@query(
    "motion_proxy",
    _recursive(
        ", t AS MATERIALIZED (SELECT trial, y, x, median(v) AS v FROM px GROUP BY ALL),\n"
        + _labelled("SELECT trial AS frame, x, y FROM t WHERE v < -10", _NEAR8, "o")
        + ",\nd AS MATERIALIZED (SELECT px.trial, frame, x, y, abs(px.v - t.v) AS v FROM px JOIN t USING (trial, x, y)),\n"
        + _labelled("SELECT frame, x, y FROM d WHERE v > 120", _NEAR8, "h")
        + """,
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY area DESC, root) AS k FROM po WHERE area >= 3) WHERE k = 1),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY area DESC, root) AS k FROM ph WHERE area >= 3) WHERE k = 1),
j AS (SELECT f.trial, f.frame, o.x0 AS ox0, o.y0 AS oy0, o.x1 AS ox1, o.y1 AS oy1, h.x0 AS hx0, h.y0 AS hy0, h.x1 AS hx1, h.y1 AS hy1
      FROM (SELECT DISTINCT trial, frame FROM px) f LEFT JOIN o ON o.frame = f.trial LEFT JOIN h ON h.frame = f.frame),
s AS (SELECT j.*, greatest(ox0 - hx1 - 1, hx0 - ox1 - 1, 0) AS gx, greatest(oy0 - hy1 - 1, hy0 - oy1 - 1, 0) AS gy,
      (SELECT count(*) FROM d WHERE d.frame = j.frame AND v > 120 AND x BETWEEN ox0 AND ox1 AND y BETWEEN oy0 AND oy1)::DOUBLE AS hits FROM j),
q AS (SELECT *, CASE WHEN ox0 IS NULL THEN 0.0 WHEN hx0 IS NULL THEN sqrt(128.0) ELSE sqrt(gx * gx + gy * gy) END AS dist, CASE WHEN ox0 IS NULL OR hx0 IS NULL THEN 0.0 ELSE hits END AS overlap FROM s)
SELECT trial, frame, round(dist::DOUBLE, 6) AS distance_px, overlap::DOUBLE AS overlap_px, CASE WHEN ox0 IS NULL THEN 0.0::DOUBLE ELSE round((overlap - dist)::DOUBLE, 6) END AS pressure_proxy FROM q"""
    ),
)
def motion_proxy(spark, root):
    stack = frames(spark, root)
    out = components.motion_against_template(stack, components.templates_of(stack), threshold=120.0, dark_limit=-10)
    return out.select("trial", "frame", q("distance_px").alias("distance_px"), "overlap_px", q("pressure_proxy").alias("pressure_proxy"))


@query("dark_markers")
def dark_markers(spark, root):
    stack = frames(spark, root)
    return components.marker_pair(
        stack, (0, 0, 4, 8), (4, 0, 4, 8), max_gray=-20, min_area=2, max_area=20, white_surround=False
    )


@query("white_ring_markers")
def white_ring_markers(spark, root):
    stack = frames(spark, root).withColumn("pixels", F.transform("pixels", lambda v: v + 150))
    return components.dark_marker(stack, (0, 0, 8, 8), max_gray=90, min_area=1)


@query("warm_finger")
def warm_finger(spark, root):
    return components.warm_finger(
        frames(spark, root), offset=40.0, min_area=4, min_centre_x=1.0, min_x=0, distal_inset=1.0, reference_inset=2.0
    )


@query("pca_scores")
def pca_scores(spark, root):
    stack = frames(spark, root)
    deltas = pixels.with_delta(stack, pixels.baseline(pixels.first_frames(stack, 20)))
    out = pixels.pca_scores(deltas, (1, 1, 6, 6))
    return out.select("trial", "frame", *[q(c, 4).alias(c) for c in out.columns[2:]])


@query("hand_hull")
def hand_hull(spark, root):
    value = lambda v: F.abs(v.cast("double"))
    stack = spark.read.parquet(f"{root}/embeddings.parquet")
    xs = F.transform(F.filter("embedding", lambda _, i: (i < 42) & (i % 2 == 0)), value)
    ys = F.transform(F.filter("embedding", lambda _, i: (i < 42) & (i % 2 == 1)), value)
    shape = components.hull(xs, ys)
    return stack.select("vec_id", shape.alias("h")).select("vec_id", *[q(f"h.{c}").alias(c) for c in ("area", "cx", "cy")])


@query("template_tracking")
def template_tracking(spark, root):
    """Each trial's first frame is the anchor; two halves of the frame stand for the regions."""
    stack = frames(spark, root)
    first = pixels.first_frames(stack, 1)
    left = F.array(*[F.lit(y * 8 + x) for y in range(1, 7) for x in range(0, 4)])
    right = F.array(*[F.lit(y * 8 + x) for y in range(1, 7) for x in range(4, 8)])
    anchors = first.drop("frame").withColumns({"distal": left, "proximal": right})
    out = tracking.track_template(stack, anchors)
    return out.select(
        "trial", "frame", "shift_u", "shift_v", q("template_score").alias("template_score"),
        F.concat_ws("|", "tracking_reasons").alias("reasons"), "primary_signal_count",
    )


def _trial_anchors(stack):
    first = components.hand_component(pixels.first_frames(stack, 1), offset=40.0, min_area=4, min_centre_x=0.0)
    inner = F.filter("positions", lambda p: (p % 8 > 0) & (p % 8 < 7) & (p > 7) & (p < 56))
    return first.select(
        "trial", "positions", inner.alias("distal"), inner.alias("proximal"), F.lit(12.0).alias("finger_width_px"),
        F.lit(None).cast("int").alias("desk_u"), F.lit(None).cast("int").alias("desk_v"), F.lit(None).cast("string").alias("reason"),
    )


_SEGMENT = {"offset": 40.0, "min_area": 4, "min_centre_x": 0.0}
_TRACKED = ("trial", "frame", "shift_u", "shift_v", "tracking_reason", "distal_count")


@query("mask_tracking")
def mask_tracking(spark, root):
    """Warm-mask shifts against each trial's first frame, walked over the whole trial."""
    stack = frames(spark, root)
    return tracking.track_trials(stack, _trial_anchors(stack), **_SEGMENT).select(*_TRACKED)


@query("stream_mask_tracking")
def stream_mask_tracking(spark, root):
    """The same as a stream of frames, one a second; each trial's tracker state is kept by the stream."""
    stack = frames(spark, root)
    anchors = settle(_trial_anchors(stack))
    live = frames_of(run.open_table(spark, f"{root}/embeddings.parquet")).withColumn("ts", F.timestamp_seconds(F.col("frame") + 1))
    hands = tracking.hands_beside_anchors(live, anchors, "ts", **_SEGMENT)
    walked = run.run_available(timed.timed_stream(hands, ["trial"], "ts", watches.TrackWatch(), order=("frame",)), spark)
    return tracking.tracked_counts(walked.drop("at_us"), stack, anchors).select(*_TRACKED)
