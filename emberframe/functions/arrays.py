"""Statistics of one frame held as a row-major array column; no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, as the element of an array.

    Else each mention would copy the value's whole expression, and copies of copies outgrow the driver. One inside
    another's ``use`` is not taken out of a Python function's argument by Spark; one as another's value is.
    """
    return F.get(F.transform(F.array(value), use), 0)


def against(values: Column, scalar: Column, test) -> Column:
    """Combine every value with one per-row scalar, evaluated once for the row.

    Naming the scalar inside the lambda would evaluate its whole expression again
    for every element.
    """
    return F.zip_with(values, F.array_repeat(scalar, F.size(values)), test)


def positions_where(flags: Column) -> Column:
    """0-based positions of the true entries, ascending."""
    marked = F.transform(flags, lambda f, i: F.when(f, i))
    return F.filter(marked, lambda i: i.isNotNull())


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def mean(values: Column) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.try_divide(total(values), n.cast("double")))


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    n = F.size(values).cast("double")
    gaps = against(values, mean(values), lambda v, m: (v.cast("double") - m) * (v.cast("double") - m))
    return F.when(n > 0, F.sqrt(F.try_divide(total(gaps), n)))


def count_where(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def _halves(value: Column) -> tuple[Column, Column]:
    """A double as a sum of two with half the digits each, so products of halves are exact."""
    wide = value * F.lit(134_217_729.0)
    high = wide - (wide - value)
    return high, value - high


def fused(terms: Column) -> Column:
    """``x * y + z`` of a struct (x, y, z) rounded once, as a fused multiply-add does it: both roundings' errors are added back."""

    def split(t: Column) -> Column:
        halves = zip(("xh", "xl", "yh", "yl"), (*_halves(t["x"]), *_halves(t["y"])))
        return F.struct(*[half.alias(name) for name, half in halves], (t["x"] * t["y"]).alias("product"), t["z"].alias("z"))

    def corrected(t: Column) -> Column:
        product, z = t["product"], t["z"]
        total_ = product + z
        part = total_ - product
        lost = ((t["xh"] * t["yh"] - product) + t["xh"] * t["yl"] + t["xl"] * t["yh"]) + t["xl"] * t["yl"]
        lost = lost + ((product - (total_ - part)) + (z - part))
        return total_ + F.nanvl(lost, F.lit(0.0))

    return bound(bound(terms, split), corrected)


def quantile(ordered: Column, p: float) -> Column:
    """Linear interpolation in an ascending array.

    The last bit decides limits that a range just meets, so it is the weighted sum of both neighbours, fused.
    """

    def weighted(ordered: Column) -> Column:
        position = (F.size(ordered) - 1) * F.lit(float(p))
        low = F.floor(position).cast("int")
        high = F.ceil(position).cast("int")
        a = F.get(ordered, low).cast("double")
        b = F.get(ordered, high).cast("double")
        share = position - low
        return F.struct(a.alias("x"), (F.lit(1.0) - share).alias("y"), (b * share).alias("z"))

    return fused(bound(ordered, weighted))


def nearest_rank(ordered: Column, p: float) -> Column:
    return F.get(ordered, F.rint((F.size(ordered) - 1) * F.lit(float(p))).cast("int"))


def top_mean(ordered: Column, share: float) -> Column:
    """Mean of the largest ``ceil(share * n)`` values, at least one."""
    n = F.size(ordered)
    k = F.greatest(F.lit(1), F.ceil(n * F.lit(share)).cast("int"))
    return mean(F.slice(ordered, n - k + 1, k))


def crop(pixels: Column, width: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Row-major cut-out of ``w`` by ``h`` pixels at (x, y); null when it leaves the frame."""
    rows = F.sequence(y, y + h - 1)
    cut = F.flatten(F.transform(rows, lambda r: F.slice(pixels, r * width + x + 1, w)))
    height = F.floor(F.size(pixels) / width)
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height)
    return F.when(inside, cut)


def crop_region(pixels: Column, width: Column, region: Column) -> Column:
    return crop(pixels, width, region["x"], region["y"], region["width"], region["height"])


def clipped_patch(pixels: Column, width: Column, height: Column, x: Column, y: Column, radius: int) -> Column:
    """The part of a square patch that lies inside the frame; null when nothing does."""
    x0 = F.greatest(F.lit(0), x - radius)
    y0 = F.greatest(F.lit(0), y - radius)
    x1 = F.least(width, x + radius + 1)
    y1 = F.least(height, y + radius + 1)
    some = (x1 > x0) & (y1 > y0)
    return F.when(some, crop(pixels, width, x0, y0, x1 - x0, y1 - y0))


def strict_patch(pixels: Column, width: Column, height: Column, x: Column, y: Column, radius: int) -> Column:
    """The whole square patch, or null when any of it leaves the frame."""
    side = F.lit(2 * radius + 1)
    inside = (x >= radius) & (y >= radius) & (x + radius < width) & (y + radius < height)
    return F.when(inside, crop(pixels, width, x - radius, y - radius, side, side))


def edge_padded_patch(pixels: Column, width: Column, height: Column, x: Column, y: Column, radius: int) -> Column:
    """Square patch where outside pixels repeat the nearest edge pixel."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    rows = F.transform(steps, lambda d: F.least(F.greatest(y + d, F.lit(0)), height - 1))
    columns = F.transform(steps, lambda d: F.least(F.greatest(x + d, F.lit(0)), width - 1))
    return F.flatten(
        F.transform(rows, lambda r: F.transform(columns, lambda c: F.get(pixels, (r * width + c).cast("int"))))
    )


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p.cast("double") - q.cast("double"))


def masked_positions(values: Column, test) -> Column:
    """0-based positions whose value passes the test, ascending."""
    flags = F.transform(values, lambda v, i: F.when(test(v), i))
    return F.filter(flags, lambda i: i.isNotNull())


# 15-bit luma weights of blue, green and red; they sum to 32768.
LUMA_WEIGHTS = (3735, 19235, 9798)


def gray(blue: Column, green: Column, red: Column) -> Column:
    """Luma of a colour pixel in whole numbers, rounded half up to a byte."""
    b, g, r = LUMA_WEIGHTS
    return F.floor((blue * b + green * g + red * r + 16384) / 32768).cast("int")


def scaled_byte(value: Column, low: Column, high: Column, *, rounded: bool) -> Column:
    """Position between ``low`` and ``high`` as 0..255: truncated, or rounded half to even.

    A flat range gives zeros when truncating and is widened to one when rounding.
    """
    top = F.when(high <= low, low + 1.0).otherwise(high)
    share = F.least(F.greatest(F.try_divide(value - low, top - low), F.lit(0.0)), F.lit(1.0))
    if rounded:
        return F.rint(share * 255).cast("int")
    return F.when(high <= low, F.lit(0)).otherwise(F.floor(share * 255).cast("int"))


def palette_index(count: Column, low: Column, high: Column) -> Column:
    """Raw count to a 0..255 index by integer floor, clamped."""
    step = F.floor((count - low) * 255 / (high - low))
    return F.when(high > low, F.least(F.greatest(step, F.lit(0)), F.lit(255)).cast("int"))


def counts_to_celsius(count: Column, enabled: Column, resolution: Column) -> Column:
    """Radiometric counts to °C at a known resolution, else null."""
    known = enabled & resolution.isin(0.01, 0.1)
    return F.when(F.coalesce(known, F.lit(False)), count * resolution - 273.15)
