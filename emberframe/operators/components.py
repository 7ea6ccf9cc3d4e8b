"""Connected regions of frame masks and what is decided from them.

The labelling runs in Python, on Arrow batches of whole frames, and gives each
frame its parts as structs with size, box, centre and pixels. Choices among them are
expressions over that array, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.functions import arrays
from emberframe.functions.geometry import clipped_region, rectangle_gap, region
from emberframe.functions.numbers import first_reason
from emberframe.operators.pixels import median_image

FRAME = ["trial", "frame"]


class Runs:
    """Horizontal runs of mask pixels of many frames, joined to connected parts.

    Frames lie below each other with an empty row between them. A run meets the runs of the next row that
    overlap it (by one pixel more for diagonal neighbours); runs that meet take the smallest number among
    them, by pointer jumping over runs, not pixels. Parts are numbered from 0 in raster order.
    """

    def __init__(self, mask: np.ndarray, sizes: np.ndarray, widths: np.ndarray, diagonal: bool):
        offsets = np.cumsum(sizes) - sizes
        heights = sizes // np.maximum(widths, 1)
        self.frame = np.repeat(np.arange(len(sizes)), sizes)
        self.pos = np.arange(len(mask)) - offsets[self.frame]
        across = widths[self.frame]
        x, row = self.pos % across, self.pos // across + (np.cumsum(heights + 1) - heights)[self.frame]
        before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        starts = mask & ((x == 0) | ~before)
        ends = mask & ((x == across - 1) | ~after)
        self.mask, self.run_of = mask, np.cumsum(starts) - 1
        first = np.flatnonzero(starts)
        self.run_frame, self.a, self.b, self.row = self.frame[first], x[first], x[ends], row[first]
        self.y = self.pos[first] // across[first]
        self.root = self._joined(1 if diagonal else 0, int(widths.max(initial=0)) + 3)

    def _joined(self, reach: int, stride: int) -> np.ndarray:
        key = lambda row, x: row * stride + x + 1
        low = np.searchsorted(key(self.row, self.b), key(self.row + 1, self.a - reach))
        high = np.searchsorted(key(self.row, self.a), key(self.row + 1, self.b + reach), side="right")
        n = np.maximum(high - low, 0)
        i = np.repeat(np.arange(len(low)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        root = np.arange(len(low))
        while True:
            p, q = root[i], root[j]
            if np.array_equal(p, q):
                return root
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(root, root[root]):
                root = root[root]

    def labels(self) -> np.ndarray:
        """Part of each pixel, numbered from 1 over all frames; 0 outside the mask."""
        _, part = np.unique(self.root, return_inverse=True)
        return np.where(self.mask, part[self.run_of] + 1 if len(part) else 0, 0)


def label_mask(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Number the connected parts of a 2-D mask from 1 in raster order."""
    runs = Runs(mask.ravel(), np.array([mask.size]), np.array([mask.shape[1]]), diagonal)
    return runs.labels().reshape(mask.shape).astype(np.int32)


PART = T.StructType(
    [T.StructField("label", T.IntegerType()), T.StructField("area", T.LongType())]
    + [T.StructField(n, T.IntegerType()) for n in ("x0", "y0", "x1", "y1")]
    + [T.StructField(n, T.DoubleType()) for n in ("cx", "cy")]
    + [T.StructField("positions", T.ArrayType(T.IntegerType()))]
)
#: Pixels that are labelled together.
BLOCK = 1 << 20


def _listed(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _parts(mask: np.ndarray, sizes: np.ndarray, widths: np.ndarray, diagonal: bool) -> pa.ListArray:
    """For each frame the list of its parts."""
    runs = Runs(mask, sizes, widths, diagonal)
    roots, part = np.unique(runs.root, return_inverse=True)
    n, long = len(roots), runs.b - runs.a + 1
    area = np.bincount(part, long, n).astype(np.int64)
    frame = runs.run_frame[roots]
    per_frame = np.bincount(frame, minlength=len(sizes))
    label = np.arange(n) - (np.cumsum(per_frame) - per_frame)[frame] + 1

    def least(values):
        out = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(out, part, values)
        return out.astype(np.int32)

    edges = [least(runs.a), least(runs.y), -least(-runs.b), -least(-runs.y)]
    cx = np.bincount(part, long * (runs.a + runs.b) / 2.0, n) / area
    cy = np.bincount(part, long * runs.y, n) / area
    inside = np.flatnonzero(mask)
    order = inside[np.argsort(part[runs.run_of[inside]], kind="stable")] if n else inside
    positions = _listed(pa.array(runs.pos[order].astype(np.int32)), area)
    columns = [pa.array(label.astype(np.int32)), pa.array(area), *map(pa.array, edges), pa.array(cx), pa.array(cy), positions]
    return _listed(pa.StructArray.from_arrays(columns, [f.name for f in PART.fields]), per_frame)


def _labeller(diagonal: bool):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for masks, widths in batches:
            sizes = pc.fill_null(pc.list_value_length(masks), 0).to_numpy().astype(np.int64)
            flat = pc.fill_null(masks.flatten().cast(pa.bool_()), False).to_numpy(zero_copy_only=False)
            across = np.maximum(pc.fill_null(widths, 1).to_numpy().astype(np.int64), 1)
            ends = np.cumsum(sizes)
            out, at = [], 0
            while at < len(sizes) or not out:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right"))) if len(sizes) else 0
                begin = ends[at - 1] if at else 0
                out.append(_parts(flat[begin : ends[stop - 1]] if stop else flat, sizes[at:stop], across[at:stop], diagonal))
                at = stop
            yield pa.concat_arrays(out)

    return F.arrow_udf(run, T.ArrayType(PART))


def component_parts(mask: Column, width: Column, *, diagonal: bool = True) -> Column:
    """Connected parts of a frame's mask as structs: label in raster order, area, box, centre, pixel positions.

    8-connected, or 4 without ``diagonal``. A null mask has no parts.
    """
    return _labeller(diagonal)(mask, width)


def components(frames: DataFrame, mask: Column, *, diagonal: bool = True) -> DataFrame:
    """One row per connected part; a frame's parts come from its own row, without a shuffle."""
    parts = component_parts(mask, F.col("width"), diagonal=diagonal)
    return frames.select(*FRAME, "width", "height", F.explode(parts).alias("_p")).select(*FRAME, "width", "height", "_p.*")


def with_largest(
    frames: DataFrame, mask: Column, keep: Callable[[Column], Column] | None = None, *, diagonal: bool = True
) -> DataFrame:
    """``frames`` with ``_best``, the largest part that ``keep`` admits (first label on ties, null without one), and ``_parts``, their number."""
    found = frames.withColumn("_all", component_parts(mask, F.col("width"), diagonal=diagonal))
    if keep is not None:
        found = found.withColumn("_all", F.filter("_all", keep))
    rank = F.transform("_all", lambda p: F.struct(p["area"].alias("area"), (-p["label"]).alias("label"), p.alias("part")))
    return found.withColumns({"_best": F.array_max(rank)["part"], "_parts": F.size("_all").cast("long")}).drop("_all")


def _bounding(part: str) -> Column:
    p = F.col(part)
    return F.when(p.isNotNull(), region(p["x0"], p["y0"], p["x1"] - p["x0"] + 1, p["y1"] - p["y0"] + 1))


def hottest_blob(
    frames: DataFrame, *, background: float = 0.25, min_delta: float = 100.0, min_area: int = 4,
    max_area: int = 900, pad: int = 2,
) -> DataFrame:
    """Region around the largest hot part (4-connected), its quality and mode."""
    level = arrays.quantile(F.array_sort("pixels"), background) + min_delta
    mask = arrays.against(F.col("pixels"), level, lambda v, t: v >= t)
    joined = with_largest(frames, mask, diagonal=False).select(*FRAME, "width", "height", "_best.*")
    clip = clipped_region(
        F.col("x0") - pad, F.col("y0") - pad, F.col("x1") + pad + 1, F.col("y1") + pad + 1,
        F.col("width"), F.col("height"),
    )
    placed = joined.withColumn("_clip", clip)
    mode = F.coalesce(
        first_reason(
            (F.col("area").isNull(), "blob_no_hotspot"),
            (F.col("area") < min_area, "blob_too_small"),
            (F.col("area") > max_area, "blob_too_large"),
        ),
        F.lit("blob"),
    )
    roi = F.col("_clip.roi")
    fill = F.try_divide(F.col("area").cast("double"), (roi["width"] * roi["height"]).cast("double"))
    ok = F.col("mode") == "blob"
    return placed.withColumn("mode", mode).select(
        *FRAME, "mode", F.when(ok, roi).alias("roi"),
        F.when(ok, F.col("_clip.retained") * fill).otherwise(F.lit(0.0)).alias("quality"),
    )


def dark_shape(frames: DataFrame, *, limit: int = 55, min_area: int = 20) -> DataFrame:
    """Size of the largest dark part of more than ``min_area`` pixels, zeros without one."""
    mask = F.transform("pixels", lambda v: v < limit)
    found = with_largest(frames, mask, lambda p: p["area"] > min_area)
    joined = found.select(*FRAME, "_best.*", F.when(F.col("_best").isNotNull(), F.col("_parts")).alias("parts"))
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return joined.select(
        *FRAME, zero(F.col("area")).alias("shape_area_px"), zero(w).alias("shape_width_px"),
        zero(h).alias("shape_height_px"), zero(w * h).alias("shape_bbox_area_px"),
        zero(F.col("parts")).alias("shape_components"),
    )


def _least_area(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(3), F.floor(width * height * 0.002))


def motion_against_template(
    frames: DataFrame, templates: DataFrame, *, threshold: float = 25.0, dark_limit: int = 55
) -> DataFrame:
    """Moving region beside the dark object of the resting template.

    ``pressure_proxy`` is the moving pixels over the object minus the gap between
    the two boxes; without motion it is minus the frame diagonal.
    """
    object_mask = F.transform("pixels", lambda v: v < dark_limit)
    rest = templates.select("trial", F.lit(0).alias("frame"), "width", "height", F.col("template").alias("pixels"))
    big = lambda p: p["area"] >= _least_area(F.col("width"), F.col("height"))
    objects = with_largest(rest, object_mask, big).select("trial", _bounding("_best").alias("object_box"))
    joined = frames.join(templates.select("trial", "template"), "trial").withColumn(
        "_diff", F.transform(arrays.difference(F.col("pixels"), F.col("template")), F.abs)
    )
    moving = F.transform("_diff", lambda d: d > threshold)
    wide = with_largest(joined, moving, big).withColumn("hand_box", _bounding("_best")).join(objects, "trial", "left")
    box = F.col("object_box")
    over = arrays.count_where(
        arrays.crop_region(F.col("_diff"), F.col("width"), box), lambda d: d > threshold
    ).cast("double")
    diagonal = F.hypot(F.col("width"), F.col("height"))
    none, still = box.isNull(), F.col("hand_box").isNull()
    distance = F.when(none, F.lit(0.0)).when(still, diagonal).otherwise(rectangle_gap(F.col("hand_box"), box))
    overlap = F.when(none | still, F.lit(0.0)).otherwise(over)
    return wide.select(
        *FRAME, "hand_box", "object_box", distance.alias("distance_px"), overlap.alias("overlap_px"),
        F.when(none, F.lit(0.0)).otherwise(overlap - distance).alias("pressure_proxy"),
    )


def templates_of(frames: DataFrame) -> DataFrame:
    """Median image per trial with its size."""
    size = frames.groupBy("trial").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return median_image(frames).join(size, "trial")


def outline_length(positions: np.ndarray, width: int) -> float:
    """Length of the outer outline through pixel centres (8-connected boundary walk)."""
    cells = {(int(p) // width, int(p) % width) for p in positions}
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    start = min(cells)
    if len(cells) == 1:
        return 0.0
    at, facing, length, first = start, 6, 0.0, None
    while True:
        for turn in range(8):
            way = (facing + 6 + turn) % 8 if first is not None else (5 + turn) % 8
            nxt = (at[0] + ring[way][0], at[1] + ring[way][1])
            if nxt in cells:
                break
        if first is None:
            first = (at, way)
        elif (at, way) == first:
            return length
        length += math.sqrt(2.0) if way % 2 else 1.0
        at, facing = nxt, way


@F.pandas_udf(T.DoubleType())
def perimeter(positions: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([outline_length(p, int(w)) for p, w in zip(positions, width)], dtype="float64")


# The 7x7 ellipse as (row offset, half width), and the white level of a ring.
_ELLIPSE = ((-3, 0), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 0))
WHITE_LEVEL = 120
MIN_WHITE_SHARE = 0.60


def white_ring_share(positions: Column, pixels: Column, width: Column, height: Column) -> Column:
    """Share of bright pixels in the ring an ellipse adds around a part; null without a ring."""
    offsets = F.array(
        *[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
            for dy, half in _ELLIPSE
            for dx in range(-half, half + 1)
        ]
    )

    def around(p: Column) -> Column:
        y, x = F.floor(p / width), p % width
        inside = lambda o: (
            (y + o["dy"] >= 0) & (y + o["dy"] < height) & (x + o["dx"] >= 0) & (x + o["dx"] < width)
        )
        return F.transform(
            F.filter(offsets, inside), lambda o: ((y + o["dy"]) * width + x + o["dx"]).cast("int")
        )

    ring = F.array_except(F.flatten(F.transform(positions, around)), positions)
    white = arrays.count_where(ring, lambda p: F.get(pixels, p) >= WHITE_LEVEL)
    return F.when(F.size(ring) > 0, F.try_divide(white, F.size(ring)))


def dark_marker(
    frames: DataFrame, box: tuple[int, int, int, int], *, max_gray: int, min_area: int,
    max_area: int | None = None, white_surround: bool = True,
) -> DataFrame:
    """Best dark dot inside a region: centre and area.

    With a white surround the score is ring whiteness times roundness over the
    root of the area; otherwise roundness minus the distance to the region centre.
    """
    x, y, w, h = box
    cut = frames.withColumns(
        {
            "pixels": arrays.crop(F.col("pixels"), F.col("width"), *[F.lit(v) for v in box]),
            "width": F.lit(w), "height": F.lit(h),
        }
    ).filter(F.col("pixels").isNotNull())
    found = cut.withColumn("_p", F.explode(component_parts(F.transform("pixels", lambda v: v <= max_gray), F.col("width"))))
    parts = found.select(*FRAME, "width", "height", "pixels", "_p.*")
    sized = F.col("area") >= min_area
    if max_area is not None:
        sized = sized & (F.col("area") <= max_area)
    kept = parts.filter(sized).withColumn("_outline", perimeter("positions", "width"))
    round_share = F.when(
        F.col("_outline") > 0, 4.0 * math.pi * F.col("area") / (F.col("_outline") * F.col("_outline"))
    ).otherwise(F.lit(0.0))
    if white_surround:
        kept = kept.withColumn(
            "_white", white_ring_share(F.col("positions"), F.col("pixels"), F.col("width"), F.col("height"))
        ).filter(F.col("_white") >= MIN_WHITE_SHARE)
        score = F.col("_white") * round_share / F.sqrt(F.col("area"))
    else:
        off = F.hypot(F.col("cx") - w / 2.0, F.col("cy") - h / 2.0) / max(1.0, math.hypot(w, h))
        score = round_share - off
    best = F.max_by(F.struct("cx", "cy", "area"), F.struct(score.alias("s"), "label"))
    return kept.groupBy(*FRAME).agg(best.alias("_m")).select(
        *FRAME, (F.col("_m.cx") + x).alias("x"), (F.col("_m.cy") + y).alias("y"), F.col("_m.area").alias("area_px")
    )


def marker_pair(frames: DataFrame, left: tuple[int, ...], right: tuple[int, ...], **limits) -> DataFrame:
    """Left and right dot per frame; frames with only one give no row."""
    side = lambda box, name: dark_marker(frames, box, **limits).select(
        *FRAME, *[F.col(c).alias(f"{name}_{c}") for c in ("x", "y", "area_px")]
    )
    return side(left, "left").join(side(right, "right"), FRAME)


# Fixed values of hand segmentation.
SEGMENT_OFFSET = 100.0
SEGMENT_MIN_AREA = 200


def hand_component(
    frames: DataFrame, *, offset: float = SEGMENT_OFFSET, min_area: int = SEGMENT_MIN_AREA,
    min_centre_x: float = 60.0, min_x: int = 0,
) -> DataFrame:
    """Largest warm part on the right side of every frame that has one."""
    return (
        with_hand(frames, offset, min_area, min_centre_x, min_x)
        .where(F.col("_best").isNotNull())
        .select(*FRAME, F.col("_parts").alias("parts"), "width", "height", "_best.*")
    )


def with_hand(frames: DataFrame, offset: float, min_area: int, min_centre_x: float, min_x: int) -> DataFrame:
    """``frames`` with ``_best``, the largest warm part on the right side; null without one."""
    level = arrays.quantile(F.array_sort("pixels"), 0.5) + offset
    warm = arrays.against(F.col("pixels"), level, lambda v, t: v >= t)
    mask = F.transform(warm, lambda m, i: m & (i % F.col("width") >= min_x))
    return with_largest(frames, mask, lambda p: (p["area"] >= min_area) & (p["cx"] > min_centre_x))


def warm_finger(
    frames: DataFrame, *, tip_share: float = 0.03, distal_inset: float = 5.0, reference_inset: float = 25.0,
    **segment,
) -> DataFrame:
    """Tip, distal and reference means of the warm hand from the thermal frame alone."""
    from emberframe.functions.numbers import half_even

    segment = {"offset": SEGMENT_OFFSET, "min_area": SEGMENT_MIN_AREA, "min_centre_x": 80.0, "min_x": 50, **segment}
    hand = with_hand(frames, **segment).select(*frames.columns, "_best.area", "_best.positions")
    width = F.col("width")
    med = lambda a: arrays.quantile(F.array_sort(a), 0.5)
    xs = F.transform("positions", lambda p: (p % width).cast("double"))
    ys = F.transform("positions", lambda p: F.floor(p / width).cast("double"))
    axis = hand.withColumns({"_xs": xs, "_ys": ys})
    edge = arrays.quantile(F.array_sort("_xs"), tip_share)
    flags = arrays.against(F.col("_xs"), edge, lambda x, e: x <= e)
    axis = axis.withColumn("_band", F.transform(arrays.positions_where(flags), lambda i: F.get("positions", i)))
    axis = axis.withColumns(
        {
            "tip_x": med(F.transform("_band", lambda p: (p % width).cast("double"))),
            "tip_y": med(F.transform("_band", lambda p: F.floor(p / width).cast("double"))),
            "_mx": med(F.col("_xs")), "_my": med(F.col("_ys")),
        }
    )
    dx, dy = F.col("_mx") - F.col("tip_x"), F.col("_my") - F.col("tip_y")
    axis = axis.withColumn("_len", F.hypot(dx, dy))
    away = lambda inset, t, d: F.col(t) + inset * F.try_divide(d, F.col("_len"))
    axis = axis.withColumns(
        {
            "distal_x": away(distal_inset, "tip_x", dx), "distal_y": away(distal_inset, "tip_y", dy),
            "reference_x": away(reference_inset, "tip_x", dx), "reference_y": away(reference_inset, "tip_y", dy),
        }
    )
    patch = lambda p, r: arrays.strict_patch(
        F.col("pixels"), F.col("width"), F.col("height"), half_even(F.col(f"{p}_x")), half_even(F.col(f"{p}_y")), r
    )
    measured = axis.withColumns(
        {
            "distal_3x3_mean_count": arrays.mean(patch("distal", 1)),
            "reference_5x5_mean_count": arrays.mean(patch("reference", 2)),
        }
    )
    reason = first_reason(
        (F.col("area").isNull(), "right_hot_hand_component_missing"),
        (~F.coalesce(F.col("_len") > 0, F.lit(False)), "right_hot_hand_axis_invalid"),
        (F.col("distal_3x3_mean_count").isNull(), "distal_3x3_out_of_bounds"),
        (F.col("reference_5x5_mean_count").isNull(), "reference_5x5_out_of_bounds"),
    )
    signal = F.col("distal_3x3_mean_count") - F.col("reference_5x5_mean_count")
    return measured.select(
        *FRAME, F.col("area").alias("component_area_px"), "tip_x", "tip_y",
        "distal_3x3_mean_count", "reference_5x5_mean_count",
        F.when(reason.isNull(), signal).alias("primary_signal_count"), reason.alias("reason"),
    )


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("area", "cx", "cy")]))
def hull(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    """Area and centroid of the convex hull of each point list."""
    rows = []
    for px, py in zip(xs, ys):
        points = sorted(set(zip(map(float, px), map(float, py))))

        def half(sequence):
            chain = []
            for p in sequence:
                while len(chain) > 1 and (
                    (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                    <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])
                ):
                    chain.pop()
                chain.append(p)
            return chain[:-1]

        ring = np.array(half(points) + half(points[::-1]) if len(points) > 2 else points)
        x, y = ring[:, 0], ring[:, 1]
        cross = x * np.roll(y, -1) - np.roll(x, -1) * y
        area = cross.sum() / 2.0
        if abs(area) < 1e-12:
            rows.append((0.0, float(np.mean(px)), float(np.mean(py))))
        else:
            cx = ((x + np.roll(x, -1)) * cross).sum() / (6.0 * area)
            cy = ((y + np.roll(y, -1)) * cross).sum() / (6.0 * area)
            rows.append((abs(area), cx, cy))
    return pd.DataFrame(rows, columns=["area", "cx", "cy"])
