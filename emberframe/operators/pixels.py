"""Frame and pixel features. Frames are rows (trial, frame, height, width, pixels).

Cross-frame statistics go pixel-wise through partial aggregation, so what is
shuffled is one row per (trial, pixel) and task, never the frames. Everything
inside one frame is computed in its own row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.functions import arrays
from emberframe.functions.numbers import all_reasons, first_reason, half_even, half_up
from emberframe.operators.ordered import Series, row_index, scan
from emberframe.operators.quantiles import exact_median

FRAME = ["trial", "frame"]
PALETTE_ENTRIES = 256


def explode_pixels(frames: DataFrame, *kept: str) -> DataFrame:
    """One row per pixel with its position, y and x."""
    out = frames.select(*kept, "width", F.posexplode("pixels").alias("pos", "v"))
    return out.withColumns(
        {"y": F.floor(F.col("pos") / F.col("width")).cast("int"), "x": F.col("pos") % F.col("width")}
    ).drop("width")


def crop_frames(frames: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Cut every frame to one region before anything looks at its pixels."""
    region = [F.lit(v) for v in (x, y, width, height)]
    cut = arrays.crop(F.col("pixels"), F.col("width"), *region)
    return frames.withColumn("pixels", cut).withColumns(
        {"width": F.lit(width), "height": F.lit(height)}
    )


def first_frames(frames: DataFrame, n: int) -> DataFrame:
    """The first ``n`` frames of every trial, the usual baseline stretch."""
    series = Series(("trial",), ("frame",))
    index = scan(frames.select("trial", "frame"), series, {"_row": row_index()})
    chosen = index.filter(F.col("_row") <= n).select("trial", "frame")
    return frames.join(chosen, FRAME, "left_semi")


def _image(rows: DataFrame, keys: list[str], value: str) -> Column:
    """Aggregate pixel rows of a trial into one array ordered by position."""
    cells = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return F.transform(cells, lambda c: c["v"])


def baseline(frames: DataFrame) -> DataFrame:
    """Per trial: mean image and noise, the mean over pixels of the per-pixel spread.

    The final collect is one frame's pixels, whatever the number of frames.
    """
    per_pixel = (
        explode_pixels(frames, "trial")
        .groupBy("trial", "pos")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"))
    )
    return per_pixel.groupBy("trial").agg(
        _image(per_pixel, ["trial"], "mean").alias("baseline"), F.avg("spread").alias("noise")
    )


def median_image(frames: DataFrame, name: str = "template", *, split: bool | None = None) -> DataFrame:
    """Per trial: per-pixel median over its frames."""
    pixels = explode_pixels(frames, "trial")
    medians = exact_median(pixels, ["trial", "pos"], "v", "v", split=split)
    return medians.groupBy("trial").agg(_image(medians, ["trial"], "v").alias(name))


def with_delta(frames: DataFrame, baselines: DataFrame) -> DataFrame:
    """Attach the trial's baseline and ``delta`` per frame.

    Frames are the large side; a trial with very many frames is split by the
    skew-join rule, the baseline row being copied to each part.
    """
    joined = frames.join(baselines, "trial")
    return joined.withColumn("delta", arrays.difference(F.col("pixels"), F.col("baseline")))


def hot_mask_features(deltas: DataFrame, *, sigma: float = 3.0) -> DataFrame:
    """Area, mean and largest delta of the pixels strictly above ``max(noise * sigma, 1)``."""
    threshold = F.greatest(F.col("noise") * sigma, F.lit(1.0))
    hot = deltas.withColumn("_hot", F.filter("delta", lambda d: d > threshold))
    return hot.select(
        "trial", "frame",
        F.size("_hot").alias("area_px"),
        F.coalesce(arrays.mean(F.col("_hot")), F.lit(0.0)).alias("mean_delta"),
        F.coalesce(F.array_max("_hot"), F.lit(0.0)).alias("max_delta"),
    )


def hot_mask(deltas: DataFrame, *, sigma: float = 3.0) -> DataFrame:
    """The mask itself as 0/1 per pixel."""
    threshold = F.greatest(F.col("noise") * sigma, F.lit(1.0))
    mask = F.transform("delta", lambda d: F.when(d > threshold, 1).otherwise(0))
    return deltas.select("trial", "frame", mask.alias("mask"))


def placed_mask(mask: Column, width: int, height: int, x: int, y: int, w: int, h: int) -> Column:
    """Put a region's mask back into a full frame of zeros."""
    positions = F.sequence(F.lit(0), F.lit(width * height - 1))

    def cell(p: Column) -> Column:
        row, column = F.floor(p / width) - y, p % width - x
        inside = (row >= 0) & (row < h) & (column >= 0) & (column < w)
        return F.when(inside, F.get(mask, (row * w + column).cast("int"))).otherwise(F.lit(0))

    return F.transform(positions, cell)


def frame_profile(deltas: DataFrame, *, sigma: float = 3.0) -> DataFrame:
    """Level, spread, areas, norms and quantiles of each frame against its baseline."""
    threshold = F.greatest(F.col("noise") * sigma, F.lit(1.0))
    ordered = deltas.withColumns(
        {"_delta": F.array_sort("delta"), "_level": F.array_sort("pixels"), "_thr": threshold}
    )
    d, thr = F.col("delta"), F.col("_thr")
    return ordered.select(
        "trial", "frame",
        arrays.mean(F.col("pixels")).alias("roi_mean"),
        arrays.deviation(F.col("pixels")).alias("roi_std"),
        arrays.mean(d).alias("delta_mean"),
        arrays.deviation(d).alias("delta_std"),
        arrays.count_where(d, lambda v: v >= thr).alias("pos_area"),
        arrays.count_where(d, lambda v: v <= -thr).alias("neg_area"),
        arrays.total(F.transform(d, F.abs)).alias("l1_delta"),
        F.sqrt(arrays.total(F.transform(d, lambda v: v * v))).alias("l2_delta"),
        *[arrays.quantile(F.col("_delta"), p / 100).alias(f"delta_p{p}") for p in (90, 95, 99)],
        arrays.quantile(F.col("_level"), 0.02).alias("frame_p2"),
        arrays.quantile(F.col("_level"), 0.98).alias("frame_p98"),
        F.sha1(F.concat_ws(",", F.transform("pixels", lambda v: v.cast("string")))).alias("content"),
    )


def delta_intensity(deltas: DataFrame) -> DataFrame:
    """Robust delta features: signed sums, norms, quantiles, top 1 % and areas per sigma."""
    ordered = deltas.withColumn("_sorted", F.array_sort("delta"))
    d, s, noise = F.col("delta"), F.col("_sorted"), F.col("noise")

    def areas_at(k: int) -> list[Column]:
        above = arrays.count_where(d, lambda v: v > noise * k)
        below = arrays.count_where(d, lambda v: v < -(noise * k))
        return [
            above.alias(f"ir_positive_area_{k}sigma_px"),
            below.alias(f"ir_negative_area_{k}sigma_px"),
        ]

    areas = [c for k in (1, 2, 3) for c in areas_at(k)]
    return ordered.select(
        "trial", "frame",
        arrays.mean(d).alias("ir_roi_mean_delta"),
        arrays.quantile(s, 0.5).alias("ir_roi_median_delta"),
        arrays.deviation(d).alias("ir_roi_std_delta"),
        arrays.total(F.filter(d, lambda v: v > 0)).alias("ir_sum_positive_delta"),
        (F.lit(0.0) - arrays.total(F.filter(d, lambda v: v < 0))).alias("ir_sum_negative_delta"),
        arrays.total(F.transform(d, F.abs)).alias("ir_l1_delta"),
        F.sqrt(arrays.total(F.transform(d, lambda v: v * v))).alias("ir_l2_delta"),
        arrays.quantile(s, 0.90).alias("ir_p90_delta"),
        arrays.quantile(s, 0.95).alias("ir_p95_delta"),
        arrays.quantile(s, 0.99).alias("ir_p99_delta"),
        arrays.top_mean(s, 0.01).alias("ir_top_1pct_mean_delta"),
        arrays.quantile(s, 0.99).alias("ir_robust_max_delta"),
        *areas,
    )


def region_medians(frames: DataFrame, regions: dict[str, tuple[int, int, int, int]]) -> DataFrame:
    """Median of every named region per frame."""
    columns = []
    for name, box in regions.items():
        cut = arrays.crop(F.col("pixels"), F.col("width"), *[F.lit(v) for v in box])
        columns.append(arrays.quantile(F.array_sort(cut), 0.5).alias(f"{name}_median"))
    kept = [c for c in frames.columns if c != "pixels"]
    return frames.select(*kept, *columns)


SIGNAL_REGIONS = ("foam_center", "left_contact", "right_contact", "background")


def reference_normalised(medians: DataFrame, names: tuple[str, ...] = SIGNAL_REGIONS) -> DataFrame:
    """Region medians between the room and the warm reference; NaN when these coincide."""
    span = F.col("warm_reference_median") - F.col("room_reference_median")
    usable = F.abs(span) >= 1e-6
    scaled = {
        f"{n}_norm": F.when(
            usable, F.try_divide(F.col(f"{n}_median") - F.col("room_reference_median"), span)
        ).otherwise(F.lit(float("nan")))
        for n in names
    }
    return medians.withColumn("reference_span", span).withColumns(scaled)


def _box(region: Column) -> tuple[Column, Column, Column, Column]:
    return region["x"], region["y"], region["x"] + region["width"], region["y"] + region["height"]


def region_issues(
    regions: dict[str, Column], width: Column | int, height: Column | int, *,
    overlay_y: int = 105, preflight: bool = False,
) -> Column:
    """What is wrong with a set of sampling regions (structs x, y, width, height)."""
    width = width if isinstance(width, Column) else F.lit(width)
    height = height if isinstance(height, Column) else F.lit(height)
    cases = []
    for name, region in regions.items():
        x, y, x1, y1 = _box(region)
        inside = (x >= 0) & (y >= 0) & (x1 <= width) & (y1 <= height)
        cases.append((~inside, f"{name} lies outside thermal frame"))
        cases.append((y1 > overlay_y, f"{name} overlaps thermal overlay band"))
    ox, oy, ox1, oy1 = _box(regions["foam_bbox"])
    ix, iy, ix1, iy1 = _box(regions["foam_center"])
    contained = (ox <= ix) & (oy <= iy) & (ox1 >= ix1) & (oy1 >= iy1)
    cases.append((~contained, "foam_center must lie inside foam_bbox"))
    if preflight:
        foam, back = regions["foam_bbox"], regions["background"]
        cx = foam["x"] + foam["width"] / 2
        cy = foam["y"] + foam["height"] / 2
        cases.append((foam["width"] < 24, "foam_bbox is narrower than 24 thermal pixels"))
        placed = cx.between(75.0, 85.0) & cy.between(55.0, 65.0)
        cases.append((~placed, "foam_bbox center is outside the required x=80+/-5, y=60+/-5 placement"))
        small = (back["width"] < 15) | (back["height"] < 15)
        cases.append((small, "background must be at least 15x15 thermal pixels"))
        for name in ("room_reference", "warm_reference"):
            small = (regions[name]["width"] < 12) | (regions[name]["height"] < 12)
            cases.append((small, f"{name} must be at least 12x12 thermal pixels"))
    return all_reasons(*cases)


def patch_means(frames: DataFrame, u: Column, v: Column, size: int) -> DataFrame:
    """Patch mean at (u, v) in the three variants.

    ``strict_mean`` rounds halves up and is null when the patch leaves the frame,
    ``even_mean`` rounds halves to even, ``clipped_mean`` and ``clipped_std`` use
    the part inside the frame.
    """
    radius = size // 2
    pixels, width, height = F.col("pixels"), F.col("width"), F.col("height")
    strict = arrays.strict_patch(pixels, width, height, half_up(u), half_up(v), radius)
    even = arrays.strict_patch(pixels, width, height, half_even(u), half_even(v), radius)
    clipped = arrays.clipped_patch(
        pixels, width, height, u.cast("int"), v.cast("int"), radius
    )
    cut = frames.withColumns({"_strict": strict, "_even": even, "_clipped": clipped})
    return cut.select(
        "trial", "frame",
        arrays.mean(F.col("_strict")).alias("strict_mean"),
        arrays.mean(F.col("_even")).alias("even_mean"),
        arrays.mean(F.col("_clipped")).alias("clipped_mean"),
        arrays.deviation(F.col("_clipped")).alias("clipped_std"),
    )


def patches_overlap(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Whether the clipped 3x3 patches around two pixels share one."""
    shared = lambda a, b, size: F.least(a + 1, b + 1, size - 1) >= F.greatest(a - 1, b - 1, F.lit(0))
    return shared(x0, x1, width) & shared(y0, y1, height)


def finger_features(frames: DataFrame, tip: Column, distal: Column, reference: Column) -> DataFrame:
    """Raw tip count, distal and reference patch means, and their difference.

    Centres are structs (u, v); a centre or patch outside the frame names its reason.
    """
    pixels, width, height = F.col("pixels"), F.col("width"), F.col("height")
    tx, ty = half_up(tip["u"]), half_up(tip["v"])
    inside = (tx >= 0) & (tx < width) & (ty >= 0) & (ty < height)
    at = lambda p, r: arrays.strict_patch(pixels, width, height, half_up(p["u"]), half_up(p["v"]), r)
    cut = frames.withColumns(
        {
            "tip_raw_count": F.when(inside, F.get(pixels, ty * width + tx)),
            "distal_3x3_mean_count": arrays.mean(at(distal, 1)),
            "distal_5x5_mean_count": arrays.mean(at(distal, 2)),
            "reference_5x5_mean_count": arrays.mean(at(reference, 2)),
        }
    )
    reason = first_reason(
        (F.col("tip_raw_count").isNull(), "tip_out_of_bounds"),
        (F.col("distal_3x3_mean_count").isNull(), "distal_3x3_out_of_bounds"),
        (F.col("distal_5x5_mean_count").isNull(), "distal_5x5_out_of_bounds"),
        (F.col("reference_5x5_mean_count").isNull(), "reference_5x5_out_of_bounds"),
    )
    signal = F.col("distal_3x3_mean_count") - F.col("reference_5x5_mean_count")
    return cut.withColumns({"primary_signal_count": signal, "reason": reason}).drop("pixels")


def contrast_gate(frames: DataFrame, minimum: float) -> DataFrame:
    """p95 - p5 of each frame and whether it is too flat to use."""
    ordered = frames.withColumn("_s", F.array_sort("pixels"))
    span = arrays.quantile(F.col("_s"), 0.95) - arrays.quantile(F.col("_s"), 0.05)
    return ordered.withColumn("frame_range", span).withColumn(
        "low_contrast", F.col("frame_range") < minimum
    ).drop("_s")


def warm_centroid(frames: DataFrame, *, percentile: float = 0.97, min_area: int = 4, min_range: float = 2.0) -> DataFrame:
    """Centre of the pixels above a high percentile; null for flat frames and tiny spots."""
    gated = contrast_gate(frames, min_range).withColumn("_s", F.array_sort("pixels"))
    threshold = F.greatest(arrays.quantile(F.col("_s"), percentile), F.lit(1.0))
    flags = arrays.against(F.col("pixels"), threshold, lambda v, t: v > t)
    warm = gated.withColumn("_hit", arrays.positions_where(flags))
    enough = (F.size("_hit") >= min_area) & ~F.col("low_contrast")
    xs = F.transform("_hit", lambda p: p % F.col("width"))
    ys = F.transform("_hit", lambda p: F.floor(p / F.col("width")))
    return warm.select(
        "trial", "frame", F.size("_hit").alias("area_px"),
        F.when(enough, arrays.mean(xs)).alias("u"),
        F.when(enough, arrays.mean(ys)).alias("v"),
    )


def touch_motion(frames: DataFrame, is_baseline: Column, *, split: bool | None = None) -> DataFrame:
    """Mean absolute difference of each frame to the median baseline image, and its limit.

    The limit is mean + 6 standard deviations of the baseline frames, at least 2.
    """
    templates = median_image(frames.filter(is_baseline), split=split)
    joined = frames.join(templates, "trial")
    gap = F.transform(arrays.difference(F.col("pixels"), F.col("template")), F.abs)
    motion = joined.select("trial", "frame", is_baseline.alias("is_baseline"), arrays.mean(gap).alias("motion"))
    quiet = F.when(F.col("is_baseline"), F.col("motion"))
    limits = motion.groupBy("trial").agg(
        F.greatest(F.avg(quiet) + 6 * F.stddev_pop(quiet), F.lit(2.0)).alias("motion_threshold"),
        F.max(quiet).alias("baseline_motion_max"),
    )
    return motion.join(limits, "trial")


def nearest_palette(colours: DataFrame, palette: DataFrame, *, invert: bool = False) -> DataFrame:
    """Nearest palette entry per distinct colour (r, g, b); ties take the lowest index.

    A palette file holds at most 256 entries, so it travels as one array value.
    Only distinct colours are matched; join the result back on the colour.
    """
    entries = F.array_sort(F.collect_list(F.struct("idx", "r", "g", "b")))
    # Checked before it is broadcast; the size is what the file format allows.
    small = F.when(F.count(F.lit(1)) <= PALETTE_ENTRIES, entries).otherwise(
        F.raise_error(F.lit("a palette has at most 256 entries"))
    )
    one = palette.limit(PALETTE_ENTRIES + 1).agg(small.alias("_palette"), F.lit(1).alias("_one"))
    distinct = colours.select("r", "g", "b").distinct().withColumn("_one", F.lit(1))
    near = F.array_min(
        F.transform(
            "_palette",
            lambda p: F.struct(
                (
                    F.pow(p["r"] - F.col("r"), 2) + F.pow(p["g"] - F.col("g"), 2) + F.pow(p["b"] - F.col("b"), 2)
                ).alias("distance"),
                p["idx"].alias("idx"),
            ),
        )
    )
    matched = distinct.join(F.broadcast(one), "_one").withColumn("_near", near)
    index = F.col("_near.idx")
    if invert:
        index = F.size("_palette") - 1 - index
    return matched.select("r", "g", "b", index.alias("palette_index"))


def zbuffer(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest sample per target cell; ties by source row, source column, raw depth.

    An aggregate over an ordered struct: no sort and no task per cell.
    """
    order = F.struct("z", "source_y", "source_x", "raw_depth")
    return samples.groupBy(*keys, "u", "v").agg(
        F.min(order).alias("_w"), F.count(F.lit(1)).alias("candidates")
    ).select(*keys, "u", "v", "_w.*", "candidates")


def zbuffer_counts(samples: DataFrame, winners: DataFrame, keys: list[str], rejected: Column) -> DataFrame:
    """Input, accepted, rejected and collision counts per map."""
    seen = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("input_count"), F.count(F.when(rejected, 1)).alias("rejected_count")
    )
    won = winners.groupBy(*keys).agg(F.count(F.lit(1)).alias("winner_count"))
    joined = seen.join(won, keys, "left").withColumn(
        "winner_count", F.coalesce("winner_count", F.lit(0).cast("long"))
    )
    accepted = F.col("input_count") - F.col("rejected_count")
    return joined.withColumns(
        {
            "accepted_count": accepted,
            "collision_count": accepted - F.col("winner_count"),
            "status": F.when(F.col("winner_count") > 0, "ok").otherwise("no_valid_projections"),
        }
    )


def raw_count_at(winners: DataFrame, frames: DataFrame) -> DataFrame:
    """Raw count of the frame pixel under each winning cell."""
    joined = winners.join(frames.select("trial", "frame", "width", "pixels"), FRAME)
    return joined.withColumn(
        "raw_count", F.get("pixels", (F.col("v") * F.col("width") + F.col("u")).cast("int"))
    ).drop("pixels", "width")


def mask_summary(frames: DataFrame, mask: Column, support: int = 1) -> DataFrame:
    """Pixel count, centre, whether the mask touches the frame edge, interior share."""
    hit = arrays.masked_positions(mask, lambda m: m == 1)
    found = frames.withColumn("_hit", hit)
    x = lambda p: p % F.col("width")
    y = lambda p: F.floor(p / F.col("width"))
    inner = lambda p, r: (x(p) >= r) & (x(p) < F.col("width") - r) & (y(p) >= r) & (y(p) < F.col("height") - r)
    return found.select(
        "trial", "frame",
        F.size("_hit").alias("pixels_in_mask"),
        arrays.mean(F.transform("_hit", x)).alias("centre_x"),
        arrays.mean(F.transform("_hit", y)).alias("centre_y"),
        F.exists("_hit", lambda p: ~inner(p, 1)).alias("touches_boundary"),
        F.try_divide(
            arrays.count_where(F.col("_hit"), lambda p: inner(p, support)), F.size("_hit")
        ).alias("interior_share"),
    )


def _spread(mask: np.ndarray, radius: int, dilate: bool) -> np.ndarray:
    """Running minimum or maximum over 2 radius + 1 pixels, along rows and then along columns."""
    for axis in (1, 0):
        width = mask.shape[axis]
        sums = np.insert(np.cumsum(mask, axis=axis, dtype=np.int32), 0, 0, axis=axis)
        at = np.arange(width)
        upto, before = np.minimum(at + radius + 1, width), np.maximum(at - radius, 0)
        hits = np.take(sums, upto, axis=axis) - np.take(sums, before, axis=axis)
        mask = hits > 0 if dilate else hits == 2 * radius + 1
    return mask


def morphology(mask: Column, width: Column, height: Column, radius: int, *, dilate: bool) -> Column:
    """Square erosion or dilation of a 0/1 mask; outside counts as empty. A null mask stays null."""

    def run(masks: pd.Series, widths: pd.Series) -> pd.Series:
        whole = lambda m, w: _spread(np.asarray(m).reshape(-1, int(w)) != 0, radius, dilate).ravel().astype(np.int32)
        return pd.Series([None if m is None else whole(m, w) for m, w in zip(masks, widths)], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))(mask, width)


def hand_axis(frames: DataFrame, mask: Column, *, tip_share: float = 0.03) -> DataFrame:
    """Tip (median of the leftmost band), centre (median) and unit vector of a mask."""
    hit = arrays.masked_positions(mask, lambda m: m == 1)
    placed = frames.withColumn("_hit", hit)
    width = F.col("width")
    xs = F.transform("_hit", lambda p: (p % width).cast("double"))
    ys = F.transform("_hit", lambda p: F.floor(p / width).cast("double"))
    placed = placed.withColumns({"_xs": xs, "_ys": ys})
    edge = arrays.quantile(F.array_sort("_xs"), tip_share)
    flags = arrays.against(F.col("_xs"), edge, lambda x, e: x <= e)
    placed = placed.withColumn("_band", F.transform(arrays.positions_where(flags), lambda i: F.get("_hit", i)))
    med = lambda values: arrays.quantile(F.array_sort(values), 0.5)
    placed = placed.withColumns(
        {
            "tip_x": med(F.transform("_band", lambda p: (p % width).cast("double"))),
            "tip_y": med(F.transform("_band", lambda p: F.floor(p / width).cast("double"))),
            "centre_x": med(F.col("_xs")),
            "centre_y": med(F.col("_ys")),
        }
    )
    dx, dy = F.col("centre_x") - F.col("tip_x"), F.col("centre_y") - F.col("tip_y")
    length = F.hypot(dx, dy)
    return placed.select(
        "trial", "frame", "tip_x", "tip_y", "centre_x", "centre_y",
        F.when(length > 0, F.try_divide(dx, length)).alias("axis_x"),
        F.when(length > 0, F.try_divide(dy, length)).alias("axis_y"),
    )


def dark_marker_depth(frames: DataFrame, u: Column, v: Column, radius: int = 2) -> Column:
    """Median of the positive depths in a box around a marker."""
    cut = arrays.clipped_patch(
        F.col("pixels"), F.col("width"), F.col("height"), half_even(u), half_even(v), radius
    )
    return arrays.quantile(F.array_sort(F.filter(cut, lambda d: d > 0)), 0.5)


def any_frame(*frames: DataFrame) -> DataFrame:
    """Union of frame tables from several recordings."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Numbers that a task holds in partial sums before it passes them on.
GRAM_NUMBERS = 1 << 24


def _gram_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and trial: count, sum and cross products of the pixel vectors."""
    held: dict[Any, list] = {}

    def passed_on() -> pd.DataFrame:
        rows = [(trial, 0, n, total, gram.ravel()) for trial, (n, total, gram) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["trial", "part", "n", "total", "gram"])

    for batch in batches:
        for trial, part in batch.groupby("trial"):
            x = np.stack(part["delta"].to_numpy()).astype(float)
            n, total, gram = held.get(trial, (0, 0.0, 0.0))
            held[trial] = [n + len(x), total + x.sum(axis=0), gram + x.T @ x]
        if sum(h[2].size for h in held.values()) > GRAM_NUMBERS:
            yield passed_on()
    yield passed_on()


def _summed(part: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    total, gram = 0.0, 0.0
    for t, g in zip(part["total"], part["gram"]):
        total, gram = total + np.asarray(t), gram + np.asarray(g)
    return int(part["n"].sum()), total, gram


def _add_grams(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
    n, total, gram = _summed(part)
    return pd.DataFrame({"trial": [key[0]], "part": [key[1]], "n": [n], "total": [total], "gram": [gram]})


def _leading_axes(part: pd.DataFrame) -> pd.DataFrame:
    n, total, gram = _summed(part)
    mean = total / n
    spread = gram.reshape(len(mean), -1) - n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(spread)
    axes = []
    for i in np.argsort(values)[::-1][:3]:
        v = vectors[:, i] if values[i] > 1e-9 * max(values[-1], 1.0) and n > 1 else np.zeros(len(mean))
        # The sign of an axis is free: the entry of largest size is made positive.
        axes.append(v * (1.0 if v[np.argmax(np.abs(v))] >= 0 else -1.0))
    while len(axes) < 3:
        axes.append(np.zeros(len(mean)))
    return pd.DataFrame({"trial": [part["trial"].iloc[0]], "mean": [mean], "axes": [axes]})


def pca_scores(deltas: DataFrame, region: tuple[int, int, int, int] | None) -> DataFrame:
    """First three principal scores of each frame's delta within its trial.

    ``region`` (x, y, width, height) is cut out of each frame first and sets the cost: the square of its pixels per
    trial and task; None takes the vectors as they are. Cross products are summed within each task, then in parts of
    a trial, then once a trial, so no task adds up what all tasks made.
    """
    if region is not None:
        cut = arrays.crop(F.col("delta"), F.col("width"), *[F.lit(v) for v in region])
        deltas = deltas.withColumn("delta", cut).where(F.col("delta").isNotNull())
    key = deltas.schema["trial"]
    doubles = T.ArrayType(T.DoubleType())
    partial_type = T.StructType(
        [
            key, T.StructField("part", T.LongType()), T.StructField("n", T.LongType()),
            T.StructField("total", doubles), T.StructField("gram", doubles),
        ]
    )
    axes_type = T.StructType([key, T.StructField("mean", doubles), T.StructField("axes", T.ArrayType(doubles))])
    partial = deltas.select("trial", "delta").mapInPandas(_gram_parts, partial_type)
    spread = partial.withColumn("part", F.spark_partition_id().cast("long") % 32)
    summed = spread.groupBy("trial", "part").applyInPandas(_add_grams, partial_type)
    axes = summed.groupBy("trial").applyInPandas(_leading_axes, axes_type)
    joined = deltas.select("trial", "frame", "delta").join(axes, "trial")
    centred = arrays.difference(F.col("delta"), F.col("mean"))
    score = lambda i: arrays.total(F.zip_with(centred, F.get("axes", i), lambda a, b: a * b))
    return joined.select("trial", "frame", *[score(i).alias(f"pca{i + 1}_score") for i in range(3)])
