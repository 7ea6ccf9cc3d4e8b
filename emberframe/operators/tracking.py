"""Finger regions per trial and their movement from frame to frame.

Segmentation, regions and measurements are row-wise Spark expressions on all
frames at once. What is left to walk in order is the shift decision, a few
integers of state per trial; a trial of this protocol lasts 20 seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.functions import arrays
from emberframe.functions.numbers import first_reason, half_even, median_of, trimmed_mean
from emberframe.operators.components import FRAME, SEGMENT_MIN_AREA, SEGMENT_OFFSET, components, hand_component, with_hand
from emberframe.operators.pixels import hand_axis, median_image, morphology

# Fixed values of the tracked-finger protocol, in pixels and counts.
DISTAL_RANGE = (5.0, 13.0)
PROXIMAL_RANGE = (15.0, 23.0)
HALF_WIDTH = 3.5
MIN_WIDTH, WIDTH_TOLERANCE = 10.0, 0.05
MAX_STEP, MAX_AREA_CHANGE, MIN_SUPPORT = 1.0, 0.20, 0.80
MIN_ROI_PIXELS = 20
DESK_SIZE, DESK_TOP, DESK_STRIDE, DESK_MARGIN = 15, 82, 3, 7
SHIFT_SEARCH = 4
TEMPLATE_PAD, TEMPLATE_SEARCH, MIN_TEMPLATE_SCORE = 8, 12, 0.5
# Chamfer weights of straight, diagonal and knight steps.
CHAMFER = (1.0, 1.4, 2.1969)


def as_mask(positions: Column, size: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), size - 1), lambda p: F.when(F.array_contains(positions, p), 1).otherwise(0)
    )


def positions_of(mask: Column) -> Column:
    return arrays.masked_positions(mask, lambda m: m == 1)


def axial_region(
    positions: Column, width: Column, tip_x: Column, tip_y: Column, ax: Column, ay: Column,
    span: tuple[float, float], half_width: float = HALF_WIDTH,
) -> Column:
    """Positions whose distance along the finger axis is in ``span`` and near the axis."""

    def inside(p: Column) -> Column:
        dx, dy = (p % width) - tip_x, F.floor(p / width) - tip_y
        along, across = dx * ax + dy * ay, F.abs(dy * ax - dx * ay)
        return (across <= half_width) & (along >= span[0]) & (along < span[1])

    return F.filter(positions, inside)


def chamfer_radius(outside: Column, width: Column, x: Column, y: Column) -> Column:
    """Chamfer distance of a pixel to the nearest of the outside positions."""
    a, b, c = CHAMFER

    def distance(p: Column) -> Column:
        dx, dy = F.abs(p % width - x), F.abs(F.floor(p / width) - y)
        far, near = F.greatest(dx, dy), F.least(dx, dy)
        steep = (far - near) * c + (2 * near - far) * b
        return F.when(far >= 2 * near, (far - 2 * near) * a + near * c).otherwise(steep)

    return F.array_min(F.transform(outside, distance))


def finger_width(
    mask: Column, width: Column, tip_x: Column, tip_y: Column, ax: Column, ay: Column,
    span: tuple[float, float] = DISTAL_RANGE, points: int = 7,
) -> Column:
    """Twice the median radius at points along the distal axis; null when all miss the mask."""
    outside = arrays.masked_positions(mask, lambda m: m == 0)
    steps = [span[0] + 1.0 + i * (span[1] - span[0] - 2.0) / (points - 1) for i in range(points)]
    radii = []
    for s in steps:
        x, y = half_even(tip_x + s * ax), half_even(tip_y + s * ay)
        height = F.floor(F.size(mask) / width)
        seen = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        covered = F.get(mask, (y * width + x).cast("int")) == 1
        radii.append(F.when(seen & covered, chamfer_radius(outside, width, x, y)))
    known = F.filter(F.array(*radii), lambda r: r.isNotNull())
    return F.when(F.size(known) > 0, 2.0 * median_of(known))


def desk_patch(frames: DataFrame, hands: DataFrame) -> DataFrame:
    """Calmest patch per trial away from the hand: lowest temporal plus a tenth of spatial spread."""
    radius = DESK_SIZE // 2
    grid = F.flatten(
        F.transform(
            F.sequence(F.lit(DESK_TOP), F.col("height") - radius - 1, F.lit(DESK_STRIDE)),
            lambda v: F.transform(
                F.sequence(F.lit(radius), F.col("width") - radius - 1, F.lit(DESK_STRIDE)),
                lambda u: F.struct(v.alias("v"), u.alias("u")),
            ),
        )
    )
    reach = radius + DESK_MARGIN
    near = lambda p, c: (
        (F.abs(p % F.col("width") - c["u"]) <= reach) & (F.abs(F.floor(p / F.col("width")) - c["v"]) <= reach)
    )
    free = hands.select(
        "trial",
        F.explode(F.filter(grid, lambda c: ~F.exists("positions", lambda p: near(p, c)))).alias("_c"),
    )
    patch = arrays.strict_patch(
        F.col("pixels"), F.col("width"), F.col("height"), F.col("_c.u"), F.col("_c.v"), radius
    )
    seen = frames.join(free, "trial").select(
        "trial", "_c", F.array_sort(patch).alias("_p")
    ).select("trial", "_c", arrays.quantile(F.col("_p"), 0.5).alias("level"), arrays.deviation(F.col("_p")).alias("spread"))
    scored = seen.groupBy("trial", "_c").agg(
        (F.stddev_pop("level") + 0.1 * F.median("spread")).alias("score")
    )
    best = F.min(F.struct("score", F.col("_c.v").alias("v"), F.col("_c.u").alias("u")))
    return scored.groupBy("trial").agg(best.alias("_b")).select(
        "trial", F.col("_b.u").alias("desk_u"), F.col("_b.v").alias("desk_v")
    )


def trial_anchor(resting: DataFrame, **segment) -> DataFrame:
    """Per trial: hand, distal and proximal positions, finger width and desk patch.

    ``resting`` holds the trial's opening frames (two seconds).
    """
    size = resting.groupBy("trial").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    still = median_image(resting, "pixels").join(size, "trial").withColumn("frame", F.lit(0))
    hand = hand_component(still, **segment)
    masked = hand.withColumn("mask", as_mask(F.col("positions"), F.col("width") * F.col("height")))
    axis = hand_axis(masked, F.col("mask")).drop("frame", "centre_x", "centre_y")
    shaped = masked.join(axis, "trial").withColumn(
        "_inner", positions_of(morphology(F.col("mask"), F.col("width"), F.col("height"), 1, dilate=False))
    )
    at = (F.col("tip_x"), F.col("tip_y"), F.col("axis_x"), F.col("axis_y"))
    anchored = shaped.withColumns(
        {
            "distal": axial_region(F.col("_inner"), F.col("width"), *at, DISTAL_RANGE),
            "proximal": axial_region(F.col("_inner"), F.col("width"), *at, PROXIMAL_RANGE),
            "finger_width_px": finger_width(F.col("mask"), F.col("width"), *at),
        }
    )
    desk = desk_patch(resting, hand)
    joined = size.join(
        anchored.select("trial", "positions", "distal", "proximal", "finger_width_px", "tip_x", "tip_y", "axis_x"),
        "trial", "left",
    ).join(desk, "trial", "left")
    reason = first_reason(
        (F.col("positions").isNull(), "right_hot_hand_component_missing"),
        (F.col("axis_x").isNull(), "right_hot_hand_axis_invalid"),
        (F.col("finger_width_px").isNull(), "finger_interior_missing"),
        (F.size("distal") < MIN_ROI_PIXELS, "distal_interior_pixels_insufficient"),
        (F.size("proximal") < MIN_ROI_PIXELS, "proximal_interior_pixels_insufficient"),
        (F.col("desk_u").isNull(), "far_desk_roi_missing"),
    )
    return joined.withColumn("reason", reason)


def moved(positions: np.ndarray, width: int, height: int, du: int, dv: int) -> np.ndarray:
    """Positions shifted by (du, dv); those that leave the frame are dropped."""
    y, x = positions // width + dv, positions % width + du
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return y[inside] * width + x[inside]


def best_shift(anchor: np.ndarray, current: np.ndarray, width: int, height: int, around: tuple[int, int]) -> tuple[int, int]:
    """Shift near ``around`` with the largest overlap share; the smaller step wins ties."""
    here = np.zeros(width * height, dtype=bool)
    here[current] = True
    offers = []
    for dv in range(around[1] - SHIFT_SEARCH, around[1] + SHIFT_SEARCH + 1):
        for du in range(around[0] - SHIFT_SEARCH, around[0] + SHIFT_SEARCH + 1):
            placed = moved(anchor, width, height, du, dv)
            shared = int(here[placed].sum())
            union = len(placed) + len(current) - shared
            share = shared / union if union else 0.0
            step = float(np.hypot(du - around[0], dv - around[1]))
            offers.append((-share, step, len(offers), (du, dv)))
    return min(offers)[3]


def advance(anchor, state: tuple[int, int, int], current, width: int, height: int, enforce: bool = True):
    """One tracking step: (new state, shift, step, area change, reason).

    ``state`` is the last accepted shift and hand area; it moves only on success.
    """
    du, dv, area = state
    if current is None:
        return state, (du, dv), 0.0, None, "right_hot_hand_component_missing"
    current = np.asarray(current)
    shift = best_shift(np.asarray(anchor["positions"]), current, width, height, (du, dv))
    step = float(np.hypot(shift[0] - du, shift[1] - dv))
    change = abs(len(current) - area) / area
    faults = [
        name
        for bad, name in (
            (anchor["finger_width_px"] < MIN_WIDTH - WIDTH_TOLERANCE, "finger_width_below_10px"),
            (step > MAX_STEP, "center_step_exceeded"),
            (change > MAX_AREA_CHANGE, "component_area_jump"),
        )
        if bad
    ]
    if faults and enforce:
        return state, shift, step, change, faults[0]
    for name in ("distal", "proximal"):
        roi = moved(np.asarray(anchor[name]), width, height, *shift)
        x, y = roi % width, roi // width
        if ((x == 0) | (x == width - 1) | (y == 0) | (y == height - 1)).any():
            return state, shift, step, change, f"{name}_roi_touches_frame_boundary"
        if len(roi) == 0 or np.isin(roi, current).mean() < MIN_SUPPORT:
            return state, shift, step, change, f"{name}_interior_pixels_insufficient"
    return (shift[0], shift[1], len(current)), shift, step, change, None


TRACK_FIELDS = [
    T.StructField("shift_u", T.IntegerType()), T.StructField("shift_v", T.IntegerType()),
    T.StructField("center_step_px", T.DoubleType()), T.StructField("area_change_ratio", T.DoubleType()),
    T.StructField("tracking_reason", T.StringType()),
]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by trial and frame; the state of a trial is carried from batch to batch, so no trial is held whole."""
    trial = anchor = state = None
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            if anchor is None or r.trial != trial:
                trial = r.trial
                anchor = {k: getattr(r, f"anchor_{k}") for k in ("positions", "distal", "proximal", "finger_width_px")}
                state = (0, 0, len(anchor["positions"]))
            state, shift, step, change, reason = advance(anchor, state, r.positions, int(r.width), int(r.height))
            rows.append((r.trial, r.frame, *shift, step, change, reason))
        yield pd.DataFrame(rows, columns=["trial", "frame", *[f.name for f in TRACK_FIELDS]])


_ANCHORED = ("positions", "distal", "proximal", "finger_width_px")


def _held(anchors: DataFrame) -> DataFrame:
    usable = anchors.filter(F.col("reason").isNull())
    return usable.select("trial", "desk_u", "desk_v", *[F.col(n).alias(f"anchor_{n}") for n in _ANCHORED])


def hands_beside_anchors(frames: DataFrame, anchors: DataFrame, *kept: str, **segment) -> DataFrame:
    """Frames of anchored trials with their hand's positions (null without a hand) and the trial's anchor.

    ``anchors`` has one row a trial. A stream of frames may be joined to a table of anchors.
    """
    segment = {"offset": SEGMENT_OFFSET, "min_area": SEGMENT_MIN_AREA, "min_centre_x": 60.0, "min_x": 0, **segment}
    hands = with_hand(frames, **segment).select(*FRAME, *kept, "width", "height", "_best.positions")
    return hands.join(_held(anchors).drop("desk_u", "desk_v"), "trial")


def track_trials(frames: DataFrame, anchors: DataFrame, **segment) -> DataFrame:
    """Shift, validity and region counts for every frame of anchored trials."""
    joined = hands_beside_anchors(frames, anchors, **segment)
    schema = T.StructType([frames.schema["trial"], frames.schema["frame"], *TRACK_FIELDS])
    walked = joined.repartition("trial").sortWithinPartitions(*FRAME).mapInPandas(_walk, schema)
    return tracked_counts(walked, frames, anchors)


def tracked_counts(walked: DataFrame, frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """Region counts of walked frames: medians and trimmed means under the shifted anchor regions."""
    measured = walked.join(frames, FRAME).join(_held(anchors), "trial")
    width = F.col("width")
    valid = F.col("tracking_reason").isNull()

    def values(name: str) -> Column:
        shifted = F.transform(f"anchor_{name}", lambda p: (p + F.col("shift_v") * width + F.col("shift_u")).cast("int"))
        return F.when(valid, F.transform(shifted, lambda p: F.get("pixels", p).cast("double")))

    desk = arrays.strict_patch(
        F.col("pixels"), width, F.col("height"), F.col("desk_u"), F.col("desk_v"), DESK_SIZE // 2
    )
    measured = measured.withColumns({"_d": values("distal"), "_p": values("proximal"), "_k": F.array_sort(desk)})
    return measured.select(
        *FRAME, *[f.name for f in TRACK_FIELDS], valid.alias("tracking_valid"),
        median_of(F.col("_d")).alias("distal_count"), median_of(F.col("_p")).alias("proximal_count"),
        F.when(valid, arrays.quantile(F.col("_k"), 0.5)).alias("desk_count"),
        trimmed_mean(F.col("_d")).alias("distal_trimmed_mean_count"),
        trimmed_mean(F.col("_p")).alias("proximal_trimmed_mean_count"),
        (median_of(F.col("_d")) - median_of(F.col("_p"))).alias("primary_signal_count"),
    )


def otsu_level(values: np.ndarray) -> int:
    """Byte level that best separates two classes (largest between-class variance)."""
    share = np.bincount(values, minlength=256) / len(values)
    levels = np.arange(256)
    below, mean_below = np.cumsum(share), np.cumsum(share * levels)
    above = 1.0 - below
    total = mean_below[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (total * below - mean_below) ** 2 / (below * above)
    between[~np.isfinite(between)] = 0.0
    return int(np.argmax(between))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def otsu_mask(crops: pd.Series) -> pd.Series:
    """0/1 mask of the brighter class of each crop after min-max scaling to bytes."""

    def one(pixels) -> np.ndarray:
        values = np.asarray(pixels, dtype=float)
        span = values.max() - values.min()
        scaled = ((values - values.min()) * (255.0 / span) if span > 0 else values * 0).astype(np.uint8)
        return (scaled > otsu_level(scaled)).astype(np.int32)

    return pd.Series([one(p) for p in crops])


def clicked_regions(frames: DataFrame) -> DataFrame:
    """Distal and proximal regions from two clicks on one finger.

    ``frames`` carries tip_x, tip_y, along_x, along_y. A box around the clicks is
    split by brightness and the part under the middle (or the tip) is the finger.
    """
    pad = TEMPLATE_PAD
    width, height = F.col("width"), F.col("height")
    u0 = F.greatest(F.lit(0), F.floor(F.least("tip_x", "along_x")) - pad).cast("int")
    v0 = F.greatest(F.lit(0), F.floor(F.least("tip_y", "along_y")) - pad).cast("int")
    u1 = F.least(width, F.ceil(F.greatest("tip_x", "along_x")) + pad + 1).cast("int")
    v1 = F.least(height, F.ceil(F.greatest("tip_y", "along_y")) + pad + 1).cast("int")
    length = F.hypot(F.col("along_x") - F.col("tip_x"), F.col("along_y") - F.col("tip_y"))
    placed = frames.withColumns({"_u": u0, "_v": v0, "_w": u1 - u0, "_h": v1 - v0, "clicked_length_px": length})
    box = placed.withColumn(
        "_mask", otsu_mask(arrays.crop(F.col("pixels"), width, F.col("_u"), F.col("_v"), F.col("_w"), F.col("_h")))
    )
    local = box.select(*FRAME, F.col("_w").alias("width"), F.col("_h").alias("height"), "_mask")
    parts = components(local, F.transform("_mask", lambda m: m == 1)).select(*FRAME, "label", "positions")
    spot = lambda x, y: ((y - F.col("_v")) * F.col("_w") + x - F.col("_u")).cast("int")
    middle = spot(half_even((F.col("tip_x") + F.col("along_x")) / 2), half_even((F.col("tip_y") + F.col("along_y")) / 2))
    tip = spot(half_even(F.col("tip_x")), half_even(F.col("tip_y")))
    held = box.drop("pixels", "_mask").join(parts, FRAME, "left")
    under = F.when(F.array_contains("positions", middle), 0).when(F.array_contains("positions", tip), 1)
    chosen = held.withColumn("_under", under).groupBy(*FRAME).agg(
        F.min_by("positions", F.struct(F.coalesce("_under", F.lit(2)), "label")).alias("positions"),
        F.min("_under").alias("_under"),
        *[F.max(c).alias(c) for c in ("width", "height", "_u", "_v", "_w", "_h", "tip_x", "tip_y", "along_x", "along_y", "clicked_length_px")],
    )
    whole = F.transform(
        "positions",
        lambda p: ((F.floor(p / F.col("_w")) + F.col("_v")) * F.col("width") + p % F.col("_w") + F.col("_u")).cast("int"),
    )
    finger = chosen.withColumn("positions", F.when(F.col("_under").isNotNull(), whole)).withColumn(
        "mask", as_mask(F.coalesce("positions", F.array().cast("array<int>")), F.col("width") * F.col("height"))
    )
    finger = finger.withColumn(
        "_inner", positions_of(morphology(F.col("mask"), F.col("width"), F.col("height"), 1, dilate=False))
    )
    ax = F.try_divide(F.col("along_x") - F.col("tip_x"), F.col("clicked_length_px"))
    ay = F.try_divide(F.col("along_y") - F.col("tip_y"), F.col("clicked_length_px"))
    at = (F.col("tip_x"), F.col("tip_y"), ax, ay)
    out = finger.withColumns(
        {
            "distal": axial_region(F.col("_inner"), F.col("width"), *at, DISTAL_RANGE),
            "proximal": axial_region(F.col("_inner"), F.col("width"), *at, PROXIMAL_RANGE),
            "finger_width_px": finger_width(F.col("mask"), F.col("width"), *at),
        }
    )
    reason = first_reason(
        (F.col("clicked_length_px") < 12.0, "clicks_too_close"),
        (F.col("positions").isNull(), "finger_component_missing"),
        (F.size("distal") < MIN_ROI_PIXELS, "distal_interior_pixels_insufficient"),
        (F.size("proximal") < MIN_ROI_PIXELS, "proximal_interior_pixels_insufficient"),
        (F.col("finger_width_px").isNull(), "finger_interior_missing"),
    )
    return out.select(
        *FRAME, "clicked_length_px", "positions", "distal", "proximal", "finger_width_px", reason.alias("reason")
    )


def template_match(search: np.ndarray, template: np.ndarray) -> tuple[int, int, float]:
    """Offset (x, y) and score of the best normalised correlation of a template in an image."""
    windows = np.lib.stride_tricks.sliding_window_view(search, template.shape)
    flat = windows.reshape(*windows.shape[:2], -1).astype(np.float64)
    flat = flat - flat.mean(axis=2, keepdims=True)
    pattern = template.ravel().astype(np.float64) - template.mean()
    norm = np.sqrt((flat**2).sum(axis=2) * (pattern**2).sum())
    score = np.divide(flat @ pattern, norm, out=np.zeros_like(norm), where=norm > 0)
    y, x = np.unravel_index(int(np.argmax(score)), score.shape)
    return int(x), int(y), float(score[y, x])


_MATCH = T.StructType(
    [T.StructField("du", T.IntegerType()), T.StructField("dv", T.IntegerType()), T.StructField("score", T.DoubleType())]
)


def _match_batches(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for pixels, widths, templates, us, vs, ws in batches:
        rows = []
        for p, width, t, u0, v0, w in zip(pixels, widths, templates, us, vs, ws):
            image = np.asarray(p).reshape(-1, int(width))
            pattern = np.asarray(t).reshape(-1, int(w))
            u0, v0, r = int(u0), int(v0), TEMPLATE_SEARCH
            su, sv = max(0, u0 - r), max(0, v0 - r)
            search = image[sv : v0 + pattern.shape[0] + r, su : u0 + pattern.shape[1] + r]
            x, y, score = template_match(search, pattern)
            rows.append((su + x - u0, sv + y - v0, score))
        yield pd.DataFrame(rows, columns=["du", "dv", "score"])


def track_template(frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """Follow clicked regions by correlation around their anchor; frames are independent.

    ``anchors`` has per trial the anchor ``pixels``, distal and proximal positions.
    """
    width = F.col("width")
    both = F.array_union("distal", "proximal")
    xs, ys = F.transform(both, lambda p: p % width), F.transform(both, lambda p: F.floor(p / width).cast("int"))
    pad = TEMPLATE_PAD
    boxed = anchors.withColumns(
        {
            "_u": F.greatest(F.lit(0), F.array_min(xs) - pad), "_v": F.greatest(F.lit(0), F.array_min(ys) - pad),
            "_u1": F.least(width, F.array_max(xs) + pad + 1), "_v1": F.least(F.col("height"), F.array_max(ys) + pad + 1),
        }
    )
    template = arrays.crop(
        F.col("pixels"), width, F.col("_u"), F.col("_v"), F.col("_u1") - F.col("_u"), F.col("_v1") - F.col("_v")
    )
    held = boxed.select(
        "trial", "distal", "proximal", "_u", "_v", (F.col("_u1") - F.col("_u")).alias("_w"), template.alias("_template")
    )
    match = F.pandas_udf(_match_batches, _MATCH)
    found = frames.join(held, "trial").withColumn("_m", match("pixels", "width", "_template", "_u", "_v", "_w"))
    du, dv = F.col("_m.du"), F.col("_m.dv")

    def shifted(name: str) -> Column:
        inside = lambda p: (
            (p % width + du >= 0) & (p % width + du < width)
            & (F.floor(p / width) + dv >= 0) & (F.floor(p / width) + dv < F.col("height"))
        )
        return F.transform(F.filter(name, inside), lambda p: (p + dv * width + du).cast("int"))

    placed = found.withColumns({"_d": shifted("distal"), "_p": shifted("proximal")})
    edge = F.greatest(F.abs(du), F.abs(dv)) >= TEMPLATE_SEARCH
    reasons = F.filter(
        F.array(
            F.when(F.col("_m.score") < MIN_TEMPLATE_SCORE, "template_score_below_threshold"),
            F.when(edge, "template_shift_at_search_boundary"),
            F.when(F.size("_d") < MIN_ROI_PIXELS, "distal_roi_left_the_frame"),
            F.when(F.size("_p") < MIN_ROI_PIXELS, "proximal_roi_left_the_frame"),
        ),
        lambda r: r.isNotNull(),
    )
    placed = placed.withColumn("tracking_reasons", reasons)
    valid = F.size("tracking_reasons") == 0
    level = lambda c: F.when(
        valid, median_of(F.transform(c, lambda p: F.get("pixels", p).cast("double")))
    )
    return placed.select(
        *FRAME, du.alias("shift_u"), dv.alias("shift_v"), F.hypot(du, dv).alias("shift_magnitude_px"),
        F.col("_m.score").alias("template_score"), "tracking_reasons", valid.alias("tracking_valid"),
        level("_d").alias("distal_count"), level("_p").alias("proximal_count"),
        (level("_d") - level("_p")).alias("primary_signal_count"),
    )

