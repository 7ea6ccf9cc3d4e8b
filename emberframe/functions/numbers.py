"""Parsing, rounding and guarded statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
ULP_SHARE = 2.0**-52


def is_finite(value: Column) -> Column:
    """True for a non-null number that is neither NaN nor infinite."""
    number = value.cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(INFINITY))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def lenient_number(text: Column) -> Column:
    """Text to double; unparsable, NaN and infinite become null."""
    return finite_or_null(F.trim(text).try_cast("double"))


def number_error(text: Column) -> Column:
    """Why a required number is unusable: missing, blank, invalid, or null when fine."""
    return (
        F.when(text.isNull(), F.lit("missing"))
        .when(F.trim(text) == "", F.lit("blank"))
        .when(F.trim(text).try_cast("double").isNull(), F.lit("invalid"))
    )


def strict_number(text: Column, label: str) -> Column:
    """Text to double; an unusable value stops the job with its reason."""
    problem = number_error(text)
    return F.when(problem.isNull(), F.trim(text).try_cast("double")).otherwise(
        F.raise_error(F.concat(problem, F.lit(f" value for {label}"))).cast("double")
    )


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes"), F.lit(False))


def persisted_flag(raw: Column) -> Column:
    """A stored flag counts only as JSON ``true`` or integer ``1`` (read as raw text)."""
    return F.coalesce(raw.isin("true", "1"), F.lit(False))


def finite_pair(pair: Column) -> Column:
    """Two finite numbers, or null."""
    good = (F.size(pair) == 2) & is_finite(F.get(pair, 0)) & is_finite(F.get(pair, 1))
    return F.when(good, pair)


def half_up(value: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(value + 0.5).cast("int")


def half_even(value: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(value).cast("int")


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)


def rounded_feature(value: Column) -> Column:
    return F.bround(value, 6)


def half_open_bin(value: Column, start: float, width: float, end: float) -> Column:
    """``floor((value - start) / width)`` inside ``[start, end)``, else null."""
    inside = (value >= start) & (value < end)
    return F.when(inside, F.floor((value - F.lit(start)) / F.lit(width)).cast("int"))


def guarded_correlation(a: Column, b: Column) -> Column:
    """Pearson over the pairs where both are known; NaN below two pairs or without spread."""
    both = a.isNotNull() & b.isNotNull()
    x = F.when(both, a.cast("double"))
    y = F.when(both, b.cast("double"))
    enough = (F.count(x) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(
        enough & (spread > 0), F.try_divide(F.covar_pop(x, y), spread)
    ).otherwise(F.lit(float("nan")))


def nan_as_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def min_max_scaled(value: Column, low: Column, high: Column) -> Column:
    """Position between the group's extremes; zero when the group is flat."""
    return F.when(high > low, F.try_divide(value - low, high - low)).otherwise(F.lit(0.0))


def standardised(value: Column, mean: Column, deviation: Column) -> Column:
    """Population z-score; zero when the group is flat."""
    return F.when(deviation > 0, F.try_divide(value - mean, deviation)).otherwise(F.lit(0.0))


def limit_exceeded(later: Column, earlier: Column, limit: float) -> Column:
    """``later - earlier > limit`` with one unit of floating-point tolerance."""
    slack = F.greatest(F.abs(later), F.abs(earlier), F.lit(limit)) * F.lit(ULP_SHARE)
    return (later - earlier) > (F.lit(limit) + slack)


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The reason of the first case that holds, else null."""
    return F.coalesce(*[F.when(bad, F.lit(reason)) for bad, reason in cases])


def all_reasons(*cases: tuple[Column, str]) -> Column:
    """Every reason that holds, in the given order."""
    flags = F.array(*[F.when(bad, F.lit(reason)) for bad, reason in cases])
    return F.filter(flags, lambda r: r.isNotNull())


def median_of(values: Column) -> Column:
    """Median of an array without nulls; null when empty."""
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def trimmed_mean(values: Column, share: float = 0.2) -> Column:
    """Mean without the lowest and highest ``share`` of the values."""
    n = F.size(values)
    cut = F.floor(n * F.lit(share)).cast("int")
    kept = F.slice(F.array_sort(values), cut + 1, n - 2 * cut)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(kept) > 0, F.try_divide(total, F.size(kept).cast("double")))
