"""Phase clocks, labels and gates of the press protocols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the recorded protocols.
TRIAL_PHASES = ("A1", "X", "A2", "A3")
PHASE_SECONDS = 5.0
ROUND_PHASES = ("LIGHT_A", "HARD", "LIGHT_B")
COMPRESSION_TARGETS = {"R": 0.0, "N": 0.0, "C0": 0.0, "C10": 10.0, "C20": 20.0, "C30": 30.0}
HARD_SHARE = 0.7
NOT_HARD_SHARE = 0.5


def phase_at(elapsed: Column, phases: tuple[str, ...] = TRIAL_PHASES, seconds: float = PHASE_SECONDS) -> Column:
    """Name of the phase that holds ``elapsed``; null outside the trial."""
    index = F.floor(elapsed / F.lit(seconds)).cast("int")
    inside = (elapsed >= 0) & (elapsed < seconds * len(phases))
    return F.when(inside, F.get(F.array(*[F.lit(p) for p in phases]), index))


def phase_elapsed(elapsed: Column, phases: tuple[str, ...] = TRIAL_PHASES, seconds: float = PHASE_SECONDS) -> Column:
    inside = (elapsed >= 0) & (elapsed < seconds * len(phases))
    return F.when(inside, elapsed - F.floor(elapsed / F.lit(seconds)) * F.lit(seconds))


def global_elapsed(phase: Column, within: Column, phases: tuple[str, ...] = TRIAL_PHASES, seconds: float = PHASE_SECONDS) -> Column:
    index = F.array_position(F.array(*[F.lit(p) for p in phases]), phase) - 1
    good = (index >= 0) & (within >= 0) & (within < seconds)
    return F.when(good, index * F.lit(seconds) + within)


def force_label(share: Column, hard: float = HARD_SHARE, not_hard: float = NOT_HARD_SHARE) -> Column:
    """``hard``, ``not_hard`` or ``ambiguous`` from a force share."""
    return (
        F.when(share >= hard, F.lit("hard"))
        .when(share <= not_hard, F.lit("not_hard"))
        .when(share.isNotNull(), F.lit("ambiguous"))
    )


def compression_percent(distance: Column, reference: Column) -> Column:
    """Shortening against the reference distance in percent; null when it is not positive."""
    return F.when(reference > 0, F.lit(100.0) * F.try_divide(reference - distance, reference))


def target_force(percent: Column, maximum: Column) -> Column:
    return percent / F.lit(100.0) * maximum


def step_direction(previous: Column, current: Column) -> Column:
    """baseline / start for the first level (null before it), then up / down / hold."""
    return (
        F.when(previous.isNull() & (current == 0), F.lit("baseline"))
        .when(previous.isNull(), F.lit("start"))
        .when(current > previous, F.lit("up"))
        .when(current < previous, F.lit("down"))
        .otherwise(F.lit("hold"))
    )


def progress(elapsed: Column, duration: Column) -> Column:
    """Share of a sweep that has passed, clamped to 0..1."""
    return F.least(F.greatest(F.try_divide(elapsed, duration), F.lit(0.0)), F.lit(1.0))


def ramp(start: Column, end: Column, share: Column) -> Column:
    return start + (end - start) * share


def reference_span_adequate(span: Column, minimum: float) -> Column:
    size = F.abs(span)
    return F.coalesce((size >= minimum) & ~F.isnan(span) & (size != F.lit(float("inf"))), F.lit(False))


def step_tolerance(state: Column, tolerance: float, release_tolerance: float) -> Column:
    return F.when(state == "R", F.lit(release_tolerance)).otherwise(F.lit(tolerance))
