"""Colour pixels matched to depth pixels, and frame rows with their first failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.geometry import Camera, Rigid
from emberframe.functions.numbers import first_reason, is_finite
from emberframe.operators.keys import join_same
from emberframe.operators.settle import settle

# Fixed values of the association gates.
DEPTH_MIN_M = 0.20
DEPTH_MAX_M = 0.90
MAX_MATCH_ERROR_PX = 0.75


def depth_to_thermal(
    pixels: DataFrame, scale: float, depth: Camera, depth_to_color: Rigid,
    thermal_to_color: Rigid, thermal: Camera,
) -> DataFrame:
    """Depth pixels (x, y, raw_depth) to thermal pixels (u, v, z) with a status.

    Every stage is its own projection, so a value that the next one uses several
    times is computed once.
    """
    metres = F.col("raw_depth") * F.lit(scale)
    color = depth_to_color.apply(depth.deproject(F.col("x"), F.col("y"), F.col("depth_m")))
    staged = pixels.withColumn("depth_m", metres).withColumns(
        {f"_c{i}": c.cast("double") for i, c in enumerate(color)}
    )
    point = thermal_to_color.undo(tuple(F.col(f"_c{i}") for i in range(3)))
    staged = staged.withColumns({f"_t{i}": c for i, c in enumerate(point)})
    plain = Camera(thermal.width, thermal.height, 1.0, 1.0, 0.0, 0.0)
    nx, ny = plain.project(*[F.col(f"_t{i}") for i in range(3)])
    staged = staged.withColumns({"_nx": nx, "_ny": ny})
    u, v = thermal.project(F.col("_nx"), F.col("_ny"), F.lit(1.0))
    staged = staged.withColumns({"_u": u, "_v": v})
    inside = (F.col("x") >= 0) & (F.col("x") < depth.width) & (F.col("y") >= 0) & (F.col("y") < depth.height)
    solid = (F.col("_c2") > 0) & (F.col("_t2") > 0)
    for i in range(3):
        solid = solid & is_finite(F.col(f"_c{i}")) & is_finite(F.col(f"_t{i}"))
    status = F.coalesce(
        first_reason(
            (~F.coalesce(inside, F.lit(False)), "source_depth_out_of_bounds"),
            (~F.coalesce(F.col("raw_depth") > 0, F.lit(False)), "depth_invalid"),
            (~solid, "nonpositive_or_nonfinite_geometry"),
            (~thermal.sees(F.col("_u"), F.col("_v")), "thermal_out_of_fov"),
        ),
        F.lit("ok"),
    )
    named = staged.withColumn("status", status)
    ok = F.col("status") == "ok"
    result = {
        "u": F.when(ok, F.col("_u")), "v": F.when(ok, F.col("_v")), "z": F.when(ok, F.col("_t2")),
        "depth_m": F.when(ok, F.col("depth_m")),
    }
    scratch = [f"_{k}{i}" for k in "ct" for i in range(3)] + ["_nx", "_ny", "_u", "_v"]
    return named.withColumns(result).drop(*scratch)


def _projected(
    depth: DataFrame, keys: list[str], scale: float, depth_camera: Camera, color_camera: Camera, depth_to_color: Rigid
) -> DataFrame:
    """Depth pixels with metres and colour position; null positions where nothing lies in front of a camera."""
    metres = F.col("raw_depth") * F.lit(scale)
    point = depth_to_color.apply(depth_camera.deproject(F.col("x"), F.col("y"), metres))
    u, v = color_camera.project(*point)
    placed = depth.select(*keys, "x", "y", "raw_depth", metres.alias("depth_m"), u.alias("_u"), v.alias("_v"), point[2].alias("_z"))
    solid = is_finite(F.col("_u")) & is_finite(F.col("_v")) & (F.col("raw_depth") > 0) & (F.col("_z") > 0)
    return placed.withColumns({c: F.when(solid, F.col(c)) for c in ("_u", "_v")}).drop("_z")


def _ring(inner: int, outer: int) -> Column:
    """Cell offsets beyond ``inner`` and up to ``outer`` cells away (the larger of both axes)."""
    across = F.sequence(F.lit(-outer), F.lit(outer))
    square = F.flatten(F.transform(across, lambda i: F.transform(across, lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return F.filter(square, lambda o: F.greatest(F.abs(o["i"]), F.abs(o["j"])) > inner)


def nearest_projection(targets: DataFrame, projected: DataFrame, keys: list[str], color_camera: Camera, cell_px: int = 8) -> DataFrame:
    """(keys, target, match_error_px, depth_pixel, raw_depth, depth_m): the projected pixel nearest to each target.

    Projections are dealt into square cells of ``cell_px``, one row a cell with its projections as a list; a target
    looks through a list within the row, so the rows to group are targets times cells. A target first looks at its own cell and those
    around it; as long as something nearer could lie outside what it has seen, it looks at the next, wider
    ring. Whatever is more than r cells away is at least r cells' width away, so the search ends exactly. Only
    targets that are still open go on, and no ring reaches beyond the colour image. Ties: by pixel.
    """
    cell = lambda c: F.floor(F.col(c) / cell_px).cast("int")
    points = F.collect_list(F.struct("_u", "_v", F.struct("x", "y").alias("depth_pixel"), "raw_depth", "depth_m"))
    cells = settle(projected.groupBy(*keys, cell("_u").alias("_i"), cell("_v").alias("_j")).agg(points.alias("_points")))
    own = ("depth_pixel", "raw_depth", "depth_m")
    error = lambda p: F.hypot(p["_u"] - F.col("cx"), p["_v"] - F.col("cy"))
    in_cell = F.array_min(F.transform("_points", lambda p: F.struct(error(p).alias("match_error_px"), *[p[c].alias(c) for c in own])))
    kind = "struct<match_error_px:double,depth_pixel:struct<x:{0},y:{1}>,raw_depth:{2},depth_m:{3}>".format(
        *[projected.schema[c].dataType.simpleString() for c in ("x", "y", "raw_depth", "depth_m")]
    )
    # a target becomes many rows, so small tables too are spread over all cores
    cores = targets.sparkSession.sparkContext.defaultParallelism
    open_ = settle(targets.select(*keys, "target", "cx", "cy", F.lit(None).cast(kind).alias("_b")))
    done, inner, outer = [], -1, 1
    furthest = -(-max(color_camera.width, color_camera.height) // cell_px)
    while True:
        looking = open_.repartition(cores, *keys, "target").select(*keys, "target", "cx", "cy", F.explode(_ring(inner, outer)).alias("_o")).select(
            *keys, "target", "cx", "cy", (cell("cx") + F.col("_o.i")).alias("_i"), (cell("cy") + F.col("_o.j")).alias("_j")
        )
        near = looking.join(cells, [*keys, "_i", "_j"]).select(*keys, "target", in_cell.alias("_new"))
        best = near.groupBy(*keys, "target").agg(F.min("_new").alias("_new"))
        seen = join_same(open_, best, [*keys, "target"], "left")
        nearer = F.when(F.col("_b").isNull() | (F.col("_new") < F.col("_b")), F.coalesce("_new", "_b")).otherwise(F.col("_b"))
        seen = settle(seen.select(*keys, "target", "cx", "cy", nearer.alias("_b")))
        # strictly nearer than the bound: an equal one outside could have the smaller pixel
        ended = F.coalesce(F.col("_b.match_error_px") < outer * cell_px, F.lit(False)) if outer < furthest else F.lit(True)
        done.append(seen.where(ended))
        open_ = seen.where(~ended)
        if outer >= furthest or open_.limit(1).count() == 0:
            break
        inner, outer = outer, min(2 * outer + 1, furthest)
    result = done[0]
    for part in done[1:]:
        result = result.union(part)
    return result.where(F.col("_b").isNotNull()).select(*keys, "target", "_b.*")


def associate_depth(
    targets: DataFrame, depth: DataFrame, keys: list[str], scale: float,
    depth_camera: Camera, color_camera: Camera, depth_to_color: Rigid,
) -> DataFrame:
    """Depth pixel whose forward projection lands nearest to each colour pixel, and why a target is blocked.

    ``targets`` has (target, cx, cy, reason): unique per keys, its colour pixel and what normalisation found
    wrong. ``depth`` has one row per depth pixel (x, y, raw_depth). All depth pixels that land in the colour
    image are candidates. The first failed gate is the reason: the colour pixel, a frame without depth rows,
    without any depth, without a point in front of the cameras, or without one in the image; then the match:
    outside the depth image, depth out of range, too far off.
    """
    projected = settle(_projected(depth, keys, scale, depth_camera, color_camera, depth_to_color))
    lands = F.coalesce(color_camera.sees(F.col("_u"), F.col("_v")), F.lit(False))
    frames = projected.groupBy(*keys).agg(
        F.lit(True).alias("_any"), F.max(F.col("raw_depth") > 0).alias("_deep"), F.max(F.col("_u").isNotNull()).alias("_solid"), F.max(lands).alias("_lands")
    )
    best = nearest_projection(targets.filter(F.col("reason").isNull()), projected.where(lands), keys, color_camera)
    joined = join_same(join_same(targets, best, [*keys, "target"], "left"), frames, keys, "left")
    pixel = F.col("depth_pixel")
    outside = ~(pixel["x"].between(0, depth_camera.width - 1) & pixel["y"].between(0, depth_camera.height - 1))
    missing = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = F.coalesce(
        F.col("reason"),
        first_reason(
            (missing("_any"), "color_to_depth_buffer_missing"),
            (missing("_deep"), "color_to_depth_zero_depth"),
            (missing("_solid"), "color_to_depth_forward_geometry_invalid"),
            (missing("_lands"), "color_to_depth_no_match"),
            (outside, "color_to_depth_out_of_bounds"),
            (~F.col("depth_m").between(DEPTH_MIN_M, DEPTH_MAX_M), "color_to_depth_depth_out_of_range"),
            (F.col("match_error_px") > MAX_MATCH_ERROR_PX, "color_to_depth_match_error_exceeded"),
        ),
    )
    return joined.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "ok").otherwise("blocked")
    ).drop("_any", "_deep", "_solid", "_lands")


def tip_pair_issue(winners: Column, sources: Column, input_count: Column, rejected: Column) -> Column:
    """Why two fingertips do not both hold their own thermal pixel.

    ``winners`` is an array of (u, v, source) per map, ``sources`` the two depth
    pixels the tips came from.
    """
    cells = F.array_distinct(F.transform(winners, lambda w: F.struct(w["u"], w["v"])))
    from_tips = F.array_distinct(F.transform(winners, lambda w: w["source"]))
    collided = input_count - rejected > F.size(winners)
    same = (F.size(from_tips) == 2) & (F.size(F.array_except(from_tips, sources)) == 0)
    return first_reason(
        (collided, "fingertip_thermal_collision"),
        ((input_count != 2) | (rejected != 0) | (F.size(winners) != 2), "fingertip_sparse_pair_incomplete"),
        (~same, "fingertip_sparse_identity_mismatch"),
        (F.size(cells) != 2, "fingertip_thermal_collision"),
    )


def frame_row(features: DataFrame, checks: list[tuple[Column, str]], blocked: list[str]) -> DataFrame:
    """Keep every frame: the first failed check becomes its reason and blanks its features."""
    reason = first_reason(*checks)
    named = features.withColumn("tracking_reason", reason)
    valid = F.col("tracking_reason").isNull()
    return named.withColumns({c: F.when(valid, F.col(c)) for c in blocked}).withColumn("tracking_valid", valid)


def landmark_reason(landmarks: Column) -> Column:
    """``label:reason`` of the first landmark, in list order, that is not ok."""
    bad = F.filter(landmarks, lambda m: m["status"] != "ok")
    return F.get(F.transform(bad, lambda m: F.concat_ws(":", m["label"], m["reason"])), 0)
