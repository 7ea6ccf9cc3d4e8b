"""Marker, landmark, region and camera geometry as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberframe.functions.numbers import first_reason, half_even, is_finite

# Landmark numbers of the 21-point hand model.
THUMB_TIP, INDEX_MCP, INDEX_TIP, PINKY_MCP = 4, 5, 8, 17
PALM_LANDMARKS = (0, 1, 2, 5, 9, 13, 17)


def _scalar(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


# --- markers ----------------------------------------------------------------

def marker_distance(lx: Column, ly: Column, rx: Column, ry: Column) -> Column:
    return F.hypot(rx - lx, ry - ly)


def marker_midpoint(lx: Column, ly: Column, rx: Column, ry: Column) -> Column:
    return F.struct(((lx + rx) / 2).alias("x"), ((ly + ry) / 2).alias("y"))


def marker_angle(lx: Column, ly: Column, rx: Column, ry: Column) -> Column:
    return F.degrees(F.atan2(ry - ly, rx - lx))


def rescaled_point(x: Column, y: Column, source: tuple[int, int], target: tuple[int, int]) -> Column:
    """Point moved between frame sizes, given as (height, width)."""
    return F.struct(
        (x * (target[1] / source[1])).alias("x"), (y * (target[0] / source[0])).alias("y")
    )


def rescaled_area(area: Column, source: tuple[int, int], target: tuple[int, int]) -> Column:
    return area * ((target[1] / source[1]) * (target[0] / source[0]))


def similarity(
    base_left: Column, base_right: Column, left: Column, right: Column
) -> Column:
    """Scale, angle and shift that move one marker pair onto another; null without distance."""
    bdx, bdy = base_right["x"] - base_left["x"], base_right["y"] - base_left["y"]
    dx, dy = right["x"] - left["x"], right["y"] - left["y"]
    base, now = F.hypot(bdx, bdy), F.hypot(dx, dy)
    scale = F.try_divide(now, base)
    turn = F.atan2(dy, dx) - F.atan2(bdy, bdx)
    tx = left["x"] - scale * (F.cos(turn) * base_left["x"] - F.sin(turn) * base_left["y"])
    ty = left["y"] - scale * (F.sin(turn) * base_left["x"] + F.cos(turn) * base_left["y"])
    made = F.struct(
        scale.alias("scale"), F.degrees(turn).alias("angle_deg"), tx.alias("tx"), ty.alias("ty")
    )
    return F.when((base > 1e-6) & (now > 1e-6), made)


def move_point(transform: Column, x: Column, y: Column) -> Column:
    angle = F.radians(transform["angle_deg"])
    c, s, k = F.cos(angle), F.sin(angle), transform["scale"]
    return F.struct(
        (k * (c * x - s * y) + transform["tx"]).alias("x"),
        (k * (s * x + c * y) + transform["ty"]).alias("y"),
    )


def region(x, y, width, height) -> Column:
    cast = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("int")
    return F.struct(
        cast(x).alias("x"), cast(y).alias("y"), cast(width).alias("width"), cast(height).alias("height")
    )


def move_region(transform: Column, box: Column, frame_width: int, frame_height: int) -> Column:
    """Region carried by a similarity: corner moved, size scaled, kept inside the frame."""
    w = F.least(F.greatest(half_even(box["width"] * transform["scale"]), F.lit(1)), F.lit(frame_width))
    h = F.least(F.greatest(half_even(box["height"] * transform["scale"]), F.lit(1)), F.lit(frame_height))
    corner = move_point(transform, box["x"], box["y"])
    x = F.least(F.greatest(half_even(corner["x"]), F.lit(0)), F.lit(frame_width) - w)
    y = F.least(F.greatest(half_even(corner["y"]), F.lit(0)), F.lit(frame_height) - h)
    return region(x, y, w, h)


ATTACHED_REGIONS = ("foam_bbox", "foam_center", "left_contact", "right_contact")


def tracked_regions(
    transform: Column, regions: dict[str, Column], frame_width: int, frame_height: int
) -> dict[str, Column]:
    """Move the regions fixed to the object; scene references stay."""
    return {
        name: move_region(transform, box, frame_width, frame_height) if name in ATTACHED_REGIONS else box
        for name, box in regions.items()
    }


def registered_regions(
    transform: Column, regions: dict[str, Column], issues, frame_width: int, frame_height: int
) -> dict[str, Column]:
    """Moved regions where the registration holds, the frozen ones elsewhere, plus ``valid``.

    ``issues`` turns a region set into its array of sampling problems.
    """
    moved = tracked_regions(transform, regions, frame_width, frame_height)
    valid = transform.isNotNull() & (F.size(issues(moved)) == 0)
    valid = F.coalesce(valid, F.lit(False))
    return {n: F.when(valid, moved[n]).otherwise(regions[n]) for n in regions} | {"valid": valid}


def rectangle_gap(a: Column, b: Column) -> Column:
    """Distance between two axis-aligned boxes; zero when they touch or overlap."""
    zero = F.lit(0)
    dx = F.greatest(b["x"] - (a["x"] + a["width"]), a["x"] - (b["x"] + b["width"]), zero)
    dy = F.greatest(b["y"] - (a["y"] + a["height"]), a["y"] - (b["y"] + b["height"]), zero)
    return F.hypot(dx, dy)


def clipped_region(x0: Column, y0: Column, x1: Column, y1: Column, width, height) -> Column:
    """Whole-pixel box clipped to the frame with the share of its area that is left."""
    width = width if isinstance(width, Column) else F.lit(width)
    height = height if isinstance(height, Column) else F.lit(height)
    rx0, ry0 = F.floor(x0), F.floor(y0)
    rx1, ry1 = F.ceil(x1), F.ceil(y1)
    zero = F.lit(0).cast("long")
    wanted = F.greatest(zero, rx1 - rx0) * F.greatest(zero, ry1 - ry0)
    ix0, iy0 = F.greatest(zero, rx0), F.greatest(zero, ry0)
    ix1, iy1 = F.least(width, rx1), F.least(height, ry1)
    some = (ix1 > ix0) & (iy1 > iy0)
    kept = F.try_divide((ix1 - ix0) * (iy1 - iy0), wanted)
    return F.struct(
        F.when(some, region(ix0, iy0, ix1 - ix0, iy1 - iy0)).alias("roi"),
        F.when(some, F.coalesce(kept, F.lit(0.0))).otherwise(F.lit(0.0)).alias("retained"),
    )


# --- hand landmarks -----------------------------------------------------------

def pinch_geometry(image_xy: Column, depth_m: Column, width: int, height: int) -> Column:
    """Thumb-index distance over palm width, and the depth difference of the tips.

    Landmarks are arrays of structs (x, y) and of depths. The image reason comes
    before the depth reason.
    """
    at = lambda i: F.get(image_xy, i)
    needed = [at(i) for i in (THUMB_TIP, INDEX_TIP, INDEX_MCP, PINKY_MCP)]
    finite = F.lit(True)
    inside = F.lit(True)
    for p in needed:
        finite = finite & is_finite(p["x"]) & is_finite(p["y"])
        inside = inside & p["x"].between(0.0, 1.0) & p["y"].between(0.0, 1.0)
    span = lambda a, b: F.hypot((a["x"] - b["x"]) * width, (a["y"] - b["y"]) * height)
    palm = span(at(INDEX_MCP), at(PINKY_MCP))
    usable = finite & inside
    distance = F.when(usable & (palm > 0), F.try_divide(span(at(THUMB_TIP), at(INDEX_TIP)), palm))
    thumb, index = F.get(depth_m, THUMB_TIP), F.get(depth_m, INDEX_TIP)
    thumb_ok = F.coalesce(is_finite(thumb) & (thumb > 0), F.lit(False))
    index_ok = F.coalesce(is_finite(index) & (index > 0), F.lit(False))
    gap = F.when(thumb_ok & index_ok, F.abs(thumb - index))
    reason = F.coalesce(
        first_reason(
            (~finite, "NONFINITE_REQUIRED_XY"),
            (~inside, "REQUIRED_XY_OUT_OF_BOUNDS"),
            (~F.coalesce(palm > 0, F.lit(False)), "DEGENERATE_PALM_SCALE"),
            (~is_finite(distance), "NONFINITE_DERIVED_FEATURE"),
            (~thumb_ok & ~index_ok, "INVALID_BOTH_TIP_DEPTHS"),
            (~thumb_ok, "INVALID_THUMB_TIP_DEPTH"),
            (~index_ok, "INVALID_INDEX_TIP_DEPTH"),
            (~is_finite(gap), "NONFINITE_DERIVED_FEATURE"),
        ),
        F.lit("OK"),
    )
    return F.struct(
        distance.alias("pinch_distance_2d_norm"), gap.alias("pinch_depth_delta_m"),
        (reason == "OK").alias("valid"), reason.alias("reason"),
    )


def pinch_distance(points: Column) -> Column:
    """3-D distance between thumb and index tip."""
    a, b = F.get(points, THUMB_TIP), F.get(points, INDEX_TIP)
    return F.sqrt(sum(F.pow(a[k] - b[k], 2) for k in "xyz"))


def opening_percent(pinch: Column, closed: float, opened: float) -> Column:
    """Pinch distance as 0..100 opening between two fixed distances."""
    share = (pinch - F.lit(closed)) / F.lit(opened - closed) * 100.0
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0))


def pinch_centre(tips: Column, field_name: str = "thermal_uv") -> Column:
    """Midpoint of the two labelled tips; null unless both are there and finite."""
    of = lambda name: F.get(F.filter(tips, lambda t: t["label"] == name), 0)[field_name]
    a, b = of("thumb_tip"), of("index_tip")
    good = is_finite(F.get(a, 0)) & is_finite(F.get(a, 1)) & is_finite(F.get(b, 0)) & is_finite(F.get(b, 1))
    middle = F.array(*[(F.get(a, i) + F.get(b, i)) * 0.5 for i in range(2)])
    return F.when(good, middle)


def palm_depth(depths: Column, low: float | None, high: float | None) -> Column:
    """Median palm depth in range, else the thumb tip's; only the thumb without limits."""
    thumb = F.get(depths, THUMB_TIP)
    thumb = F.when(is_finite(thumb), thumb)
    if low is None and high is None:
        return thumb
    fits = lambda d: F.coalesce(
        is_finite(d)
        & (d >= low if low is not None else F.lit(True))
        & (d <= high if high is not None else F.lit(True)),
        F.lit(False),
    )
    palm = F.filter(F.array(*[F.get(depths, i) for i in PALM_LANDMARKS]), fits)
    ordered, n = F.array_sort(palm), F.size(palm)
    middle = (
        F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))
    ) / 2
    return F.when(n > 0, middle).when(fits(thumb), thumb)


def finger_centres(tip: Column, dip: Column, pip: Column, mcp: Column) -> Column:
    """Tip, a point a third of the way to the next joint, and a mid-finger reference."""
    mix = lambda a, b, s: F.struct(*[(a[k] + (b[k] - a[k]) * s).alias(k) for k in "uv"])
    return F.struct(
        tip.alias("tip"), mix(tip, dip, 1.0 / 3.0).alias("distal"), mix(pip, mcp, 0.5).alias("reference")
    )


def inward_points(tip: Column, previous: Column, shares: tuple[float, ...] = (0.25, 0.5)) -> Column:
    """Points between the tip and the joint before it."""
    return F.array(
        *[
            F.struct(
                F.lit(s).alias("share"), (tip["x"] + s * (previous["x"] - tip["x"])).alias("x"),
                (tip["y"] + s * (previous["y"] - tip["y"])).alias("y"),
            )
            for s in shares
        ]
    )


def point_segment_gap(points: Column, start: Column, end: Column) -> Column:
    """Smallest distance of the points to a segment (a point when it has no length)."""
    dx, dy = end["x"] - start["x"], end["y"] - start["y"]
    length = dx * dx + dy * dy

    def gap(p: Column) -> Column:
        along = F.try_divide((p["x"] - start["x"]) * dx + (p["y"] - start["y"]) * dy, length)
        share = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.hypot(p["x"] - (start["x"] + share * dx), p["y"] - (start["y"] + share * dy))

    return F.array_min(F.transform(points, gap))


def canonical_corners(corners: Column) -> Column:
    """Reverse a corner list whose last corner is above, or left of, its first."""
    first, last = F.get(corners, 0), F.get(corners, F.size(corners) - 1)
    flip = (last["y"] < first["y"]) | ((last["y"] == first["y"]) & (last["x"] < first["x"]))
    return F.when((F.size(corners) >= 2) & flip, F.reverse(corners)).otherwise(corners)


def pressure_roi(
    thumb: Column, index: Column, landmarks_valid: Column, width: int, height: int, *,
    tip_radius: int = 5, corridor_pad: int = 5,
) -> Column:
    """Region, quality and mode from projected tips.

    A tip is a struct (x, y, valid), null without depth. Both tips span a padded
    corridor; one gives a box at half quality; an invalid projection stops.
    """
    outside = F.coalesce(~thumb["valid"], F.lit(False)) | F.coalesce(~index["valid"], F.lit(False))
    both = thumb.isNotNull() & index.isNotNull()
    one = F.coalesce(thumb, index)
    pad, r = corridor_pad, tip_radius
    corridor = clipped_region(
        F.least(thumb["x"], index["x"]) - pad, F.least(thumb["y"], index["y"]) - pad,
        F.greatest(thumb["x"], index["x"]) + pad + 1, F.greatest(thumb["y"], index["y"]) + pad + 1,
        width, height,
    )
    box = clipped_region(one["x"] - r, one["y"] - r, one["x"] + r + 1, one["y"] + r + 1, width, height)
    mode = F.coalesce(
        first_reason(
            (~F.coalesce(landmarks_valid, F.lit(False)), "missing_oak_metadata"),
            (outside, "projection_out_of_fov"),
            (both, "tips"),
            (one.isNull(), "missing_tip_depth"),
        ),
        F.lit("single_tip"),
    )
    roi = F.when(mode == "tips", corridor["roi"]).when(mode == "single_tip", box["roi"])
    quality = F.when(mode == "tips", corridor["retained"]).when(mode == "single_tip", box["retained"] * 0.5)
    return F.struct(roi.alias("roi"), F.coalesce(quality, F.lit(0.0)).alias("quality"), mode.alias("mode"))


# --- cameras -----------------------------------------------------------------

@dataclass(frozen=True)
class Camera:
    """Pinhole intrinsics with the five-term radial-tangential distortion (k1 k2 p1 p2 k3)."""

    width: int
    height: int
    fx: float
    fy: float
    ppx: float
    ppy: float
    coeffs: tuple[float, ...] = field(default=(0.0, 0.0, 0.0, 0.0, 0.0))

    def deproject(self, x: Column, y: Column, depth: Column) -> tuple[Column, Column, Column]:
        """Pixel and depth to a point; distortion is undone by ten fixed-point steps."""
        nx, ny = (x - self.ppx) / self.fx, (y - self.ppy) / self.fy
        if any(self.coeffs):
            k1, k2, p1, p2, k3 = self.coeffs
            start = F.struct(nx.cast("double").alias("x"), ny.cast("double").alias("y"))

            def step(acc: Column, _: Column) -> Column:
                px, py = acc["x"], acc["y"]
                r2 = px * px + py * py
                shrink = 1.0 / (1.0 + ((k3 * r2 + k2) * r2 + k1) * r2)
                dx = 2 * p1 * px * py + p2 * (r2 + 2 * px * px)
                dy = 2 * p2 * px * py + p1 * (r2 + 2 * py * py)
                return F.struct(((nx - dx) * shrink).alias("x"), ((ny - dy) * shrink).alias("y"))

            undone = F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, step)
            nx, ny = undone["x"], undone["y"]
        return nx * depth, ny * depth, depth

    def project(self, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        """Point to pixel. Give columns, not long expressions: each is used many times."""
        nx, ny = F.try_divide(x, z), F.try_divide(y, z)
        if not any(self.coeffs):
            return nx * self.fx + self.ppx, ny * self.fy + self.ppy
        k1, k2, p1, p2, k3 = self.coeffs
        r2 = nx * nx + ny * ny
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        dx = nx * radial + 2 * p1 * nx * ny + p2 * (r2 + 2 * nx * nx)
        dy = ny * radial + 2 * p2 * nx * ny + p1 * (r2 + 2 * ny * ny)
        return dx * self.fx + self.ppx, dy * self.fy + self.ppy

    def sees(self, u: Column, v: Column) -> Column:
        inside = is_finite(u) & is_finite(v) & (u >= 0) & (u < self.width) & (v >= 0) & (v < self.height)
        return F.coalesce(inside, F.lit(False))


@dataclass(frozen=True)
class Rigid:
    """Rotation (row-major) and translation: ``apply`` is R x + T, ``undo`` its inverse."""

    rotation: tuple[tuple[float, ...], ...]
    translation: tuple[float, ...]

    def apply(self, point) -> tuple[Column, ...]:
        return tuple(
            sum(self.rotation[i][j] * point[j] for j in range(3)) + self.translation[i] for i in range(3)
        )

    def undo(self, point) -> tuple[Column, ...]:
        moved = [point[j] - self.translation[j] for j in range(3)]
        return tuple(sum(self.rotation[j][i] * moved[j] for j in range(3)) for i in range(3))


def normalized_pixel(x: Column, y: Column, width: int, height: int) -> Column:
    """Unit coordinates to a pixel; exactly one maps to the last pixel."""
    at = lambda c, n: F.when(c == 1.0, F.lit(n - 1)).otherwise(F.floor(c * n).cast("int"))
    finite = is_finite(x) & is_finite(y)
    inside = x.between(0.0, 1.0) & y.between(0.0, 1.0)
    reason = first_reason(
        (~finite, "normalized_color_nonfinite"), (~inside, "normalized_color_out_of_bounds")
    )
    return F.struct(
        F.when(reason.isNull(), at(x, width)).alias("x"),
        F.when(reason.isNull(), at(y, height)).alias("y"),
        reason.alias("reason"),
    )


def source_fields(now: Column, camera_at: Column, thermal_at: Column) -> dict[str, Column]:
    """Read-completion ages of both sensors, the worse one, and their skew."""
    return {
        "camera_age_s": now - camera_at,
        "thermal_age_s": now - thermal_at,
        "worst_age_s": F.greatest(now - camera_at, now - thermal_at),
        "skew_s": F.abs(camera_at - thermal_at),
    }
