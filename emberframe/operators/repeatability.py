"""Raw-count repeatability: phase windows, phase metrics, recovery, offsets, drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions import arrays
from emberframe.functions.numbers import first_reason
from emberframe.operators.joins import interval_join
from emberframe.operators.ordered import Series
from emberframe.operators.pixels import explode_pixels
from emberframe.operators.quantiles import exact_median
from emberframe.operators.settle import settle
from emberframe.operators.statistics import nearest_rank
from emberframe.operators.windows import gap_clusters


def phase_windows(log: DataFrame, keys: list[str], name: str, at: str) -> DataFrame:
    """Pair ``phase_start`` and ``phase_end`` events; broken phases keep their reason."""
    is_start = F.col("event_type") == "phase_start"
    is_end = F.col("event_type") == "phase_end"
    paired = log.groupBy(*keys, name).agg(
        F.count(F.when(is_start, 1)).alias("_starts"),
        F.count(F.when(is_end, 1)).alias("_ends"),
        F.min(F.when(is_start, F.col(at))).alias("start"),
        F.max(F.when(is_end, F.col(at))).alias("end"),
    )
    violation = first_reason(
        (F.col("_starts") > 1, "starts_more_than_once"),
        (F.col("_starts") == 0, "ends_without_start"),
        (F.col("_ends") == 0, "missing_end"),
        (F.col("_ends") > 1, "ends_more_than_once"),
        (F.col("end") < F.col("start"), "ends_before_start"),
    )
    return paired.withColumn("violation", violation).drop("_starts", "_ends")


def suggest_fixed_range(
    frames: DataFrame, keys: list[str], *, minimum_span: int = 256, alignment: int = 16,
    padding: float = 0.1,
) -> DataFrame:
    """Display bounds around the 0.5 % and 99.5 % counts, padded and aligned."""
    ranks = nearest_rank(
        explode_pixels(frames, *keys), keys, "v", {"source_p005": 0.005, "source_p995": 0.995}
    )
    span = F.greatest(F.col("source_p995") - F.col("source_p005"), F.lit(minimum_span))
    padded = ranks.withColumn("_pad", F.ceil(span * F.lit(padding)).cast("int"))
    low = F.floor((F.col("source_p005") - F.col("_pad")) / alignment) * alignment
    high = F.floor((F.col("source_p995") + F.col("_pad") + alignment - 1) / alignment) * alignment
    return padded.withColumns(
        {
            "raw_low": F.greatest(F.lit(0).cast("long"), low).cast("int"),
            "raw_high": F.least(F.lit(65535).cast("long"), high).cast("int"),
        }
    ).drop("_pad")


def frame_medians(frames: DataFrame, keys: list[str], region: tuple[int, int, int, int]) -> DataFrame:
    """Integer median of a region for every unique normal frame."""
    normal = frames.filter((F.col("ffc_state") == "normal") & ~F.col("repeated"))
    cut = arrays.crop(F.col("pixels"), F.col("width"), *[F.lit(v) for v in region])
    return normal.select(
        *keys, "frame", "ts_ns", F.floor(arrays.quantile(F.array_sort(cut), 0.5)).cast("long").alias("level")
    )


def phase_metric(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Count, integer median, mean, spread and time bounds of frame medians per phase."""
    totals = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_frame_count"),
        F.avg("level").alias("mean"),
        F.stddev_pop("level").alias("population_stdev"),
        F.min("ts_ns").alias("start_ns"),
        F.max("ts_ns").alias("end_ns"),
    )
    medians = exact_median(placed, keys, "level", "median")
    return totals.join(medians, keys).withColumn("median", F.floor("median").cast("long"))


def recovery_windows(
    states: DataFrame, keys: list[str], *, window_ns: int, delay_ns: int, gap_ns: int | None
) -> DataFrame:
    """Shutter events with the stretch before and the delayed stretch after each.

    ``states`` has ts_ns, frame and ffc_state. Shutter frames further apart than
    ``gap_ns`` are separate events; None takes the whole capture as one.
    """
    shut = states.filter(F.col("ffc_state") == "ffc").select(*keys, "ts_ns", "frame")
    if gap_ns is None:
        clustered = shut.withColumn("cluster", F.lit(0).cast("long"))
    else:
        clustered = gap_clusters(shut, Series(tuple(keys), ("ts_ns", "frame")), "ts_ns", gap_ns)
    events = clustered.groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("ffc_frame_count"),
        F.min("ts_ns").alias("ffc_start_ns"), F.max("ts_ns").alias("ffc_end_ns"),
    )
    spans = F.array(
        F.struct(
            F.lit("pre").alias("side"), (F.col("ffc_start_ns") - window_ns).alias("start"),
            (F.col("ffc_start_ns") - 1).alias("end"),
        ),
        F.struct(
            F.lit("post").alias("side"), (F.col("ffc_end_ns") + delay_ns).alias("start"),
            (F.col("ffc_end_ns") + delay_ns + window_ns).alias("end"),
        ),
    )
    return events.withColumn("_s", F.explode(spans)).select(
        *keys, "cluster", "ffc_frame_count", "ffc_start_ns", "ffc_end_ns", "_s.*"
    )


def ffc_recovery(levels: DataFrame, windows: DataFrame, keys: list[str], *, window_ns: int) -> DataFrame:
    """Level shift over each shutter event; a side without frames names its reason."""
    placed = interval_join(
        levels, windows.select(*keys, "cluster", "side", "start", "end"), keys, "ts_ns",
        bucket=window_ns, disjoint=True,
    )
    metric = phase_metric(placed, [*keys, "cluster", "side"])
    events = windows.select(*keys, "cluster", "ffc_frame_count", "ffc_start_ns", "ffc_end_ns").distinct()
    at = lambda n, s: F.max(F.when(F.col("side") == s, F.col(n)))
    wide = metric.groupBy(*keys, "cluster").agg(
        *[
            at(n, s).alias(f"{s}_{n}")
            for s in ("pre", "post")
            for n in ("median", "unique_frame_count", "population_stdev")
        ]
    )
    joined = events.join(wide, [*keys, "cluster"], "left")
    reason = first_reason(
        (F.col("pre_median").isNull(), "pre_window_empty"), (F.col("post_median").isNull(), "post_window_empty")
    )
    return joined.withColumns(
        {"post_minus_pre_counts": F.col("post_median") - F.col("pre_median"), "reason": reason}
    )


def restart_offsets(summaries: DataFrame, keys: list[str], run: str, level: str) -> DataFrame:
    """Offset of every restart run to the first one, and the largest of them."""
    first = summaries.groupBy(*keys).agg(
        F.min_by(level, run).alias("reference_level"), F.min(run).alias("reference_run")
    )
    moved = summaries.join(first, keys).withColumn("offset", F.col(level) - F.col("reference_level"))
    largest = moved.groupBy(*keys).agg(F.max(F.abs("offset")).alias("max_absolute_offset"))
    return moved.join(largest, keys)


def dynamic_cycles(metrics: DataFrame, keys: list[str], name: str, level: str) -> DataFrame:
    """Hot and recovery minus baseline per numbered cycle; incomplete cycles say so.

    Phase names end in the cycle number after baseline_, hot_hand_ or recovery_.
    """
    part = F.regexp_extract(name, r"^(baseline|hot_hand|recovery)_(.+)$", 1)
    cycle = F.regexp_extract(name, r"^(baseline|hot_hand|recovery)_(.+)$", 2)
    at = lambda p: F.max(F.when(F.col("_part") == p, F.col(level)))
    wide = (
        metrics.withColumns({"_part": part, "cycle": cycle})
        .filter(F.col("_part") != "")
        .groupBy(*keys, "cycle")
        .agg(at("baseline").alias("_b"), at("hot_hand").alias("_h"), at("recovery").alias("_r"))
        .filter(F.col("_b").isNotNull())
    )
    missing = F.col("_h").isNull() | F.col("_r").isNull()
    return wide.select(
        *keys, "cycle", (F.col("_h") - F.col("_b")).alias("hot_minus_baseline"),
        (F.col("_r") - F.col("_b")).alias("recovery_minus_baseline"),
        F.when(missing, "cycle_incomplete").alias("issue"),
    )


def display_issues(frames: DataFrame, mode: Column, low: Column, high: Column) -> Column:
    """Where a frame's stored display mapping departs from the run's contract."""
    wanted = F.when(mode == "dynamic", "dynamic_per_frame_min_max").when(mode == "fixed", "fixed_raw_counts")
    fixed = wanted == "fixed_raw_counts"
    bounds = ~(F.col("raw_low").eqNullSafe(low) & F.col("raw_high").eqNullSafe(high))
    return first_reason(
        (wanted.isNull(), "display_contract_invalid"),
        (F.col("display_mode") != wanted, "display_mode_mismatch"),
        (fixed & bounds, "display_bounds_mismatch"),
    )


def palette_comparison(levels: DataFrame, observed: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """Palette index expected from the raw level beside the one seen in colour frames."""
    expected = arrays.palette_index(F.col("median"), low, high)
    joined = levels.join(observed.select(*keys, "observed_palette_index"), keys, "left")
    return joined.select(
        *keys, F.col("median").alias("target_raw_median"), expected.alias("expected_palette_index"),
        "observed_palette_index",
        (F.col("observed_palette_index") - expected).alias("observed_minus_expected"),
    )


def capture_audit(frames: DataFrame, keys: list[str], *, max_repeated: float | None = None) -> DataFrame:
    """Consistency of a raw capture: dimensions, states, repeats, stored statistics, drift.

    ``frames`` has frame, ts_ns, width, height, pixels, ffc_state, repeated and the
    stored raw_min, raw_median and raw_max.
    """
    ordered = F.array_sort("pixels")
    seen = frames.withColumns(
        {
            "_min": F.get(ordered, 0), "_max": F.array_max("pixels"),
            "_median": F.floor(arrays.quantile(ordered, 0.5)).cast("long"),
        }
    )
    wrong = (
        (F.col("_min") != F.col("raw_min")) | (F.col("_max") != F.col("raw_max"))
        | (F.col("_median") != F.col("raw_median"))
    )
    normal = F.col("ffc_state") == "normal"
    fresh = normal & ~F.col("repeated")
    seconds = F.when(fresh, F.col("ts_ns") / 1e9)
    level = F.when(fresh, F.col("_median"))
    audit = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.count_distinct("width", "height").alias("dimension_count"),
        F.count(F.when(wrong, 1)).alias("stat_mismatch_count"),
        F.bool_or(F.col("_max") > 255).alias("has_values_above_255"),
        F.count(F.when(F.col("repeated"), 1)).alias("repeated_frame_count"),
        F.count(F.when(F.col("ffc_state") == "ffc", 1)).alias("ffc_frame_count"),
        F.count(F.when(normal, 1)).alias("normal_frame_count"),
        F.count(level).alias("deduplicated_normal_frame_count"),
        F.min(level).alias("level_min"), F.max(level).alias("level_max"),
        F.avg(level).alias("level_mean"), F.stddev_pop(level).alias("level_stdev"),
        F.regr_slope(level, seconds).alias("drift_counts_per_s"),
    )
    share = F.try_divide(F.col("repeated_frame_count"), F.col("frame_count"))
    accepted = F.col("has_values_above_255") & (F.col("dimension_count") == 1)
    issue = first_reason(
        (F.col("stat_mismatch_count") > 0, "stat_mismatch"),
        *([(share > max_repeated, "repeated_fraction_exceeded")] if max_repeated is not None else []),
    )
    return audit.withColumns(
        {"repeated_frame_fraction": share, "raw_stream_accepted": accepted, "issue": issue}
    )


def session_report(
    frames: DataFrame, runs: DataFrame, windows: DataFrame, regions: dict[str, tuple[int, int, int, int]], *,
    window_ns: int, delay_ns: int, gap_ns: int,
) -> DataFrame:
    """What each run of a session gives by its mode, one row a value: (session, run, mode, region, part, name, value, issue).

    ``runs`` has session, run, mode (ffc, restart or dynamic) and the display contract (display, low, high);
    ``frames`` the raw frames with run and their stored display mapping; ``windows`` (run, phase, start, end) the
    phases. Shutter runs give the level shift over each event; restart runs the level of the stable phase and its
    offset from the session's first run; dynamic runs the level of each phase and the changes of each cycle. Every
    run has a ``display`` row with its first departure from the contract, and a run of no known mode an issue.
    """
    runs = settle(runs)
    placed = frames.join(runs.select("run", "session", "mode", "display", "low", "high"), "run")
    shape = lambda part, name, value, issue: [
        "session", "run", "mode", F.col("_region").alias("region"), F.lit(part).alias("part"), name.cast("string").alias("name"),
        value.cast("double").alias("value"), issue.cast("string").alias("issue"),
    ]
    none = F.lit(None)
    of = ["session", "run", "mode"]
    known = F.col("mode").isin("ffc", "restart", "dynamic")
    departs = display_issues(placed, F.col("display"), F.col("low"), F.col("high"))
    checked = placed.withColumn("_departs", departs).groupBy(*of).agg(
        F.min_by("_departs", F.when(F.col("_departs").isNotNull(), F.col("frame"))).alias("_issue")
    )
    seen = runs.select(*of).join(checked, of, "left").withColumn("_region", none.cast("string"))
    issue = F.when(~known, "mode_invalid").otherwise(F.col("_issue"))
    parts = [seen.select(*shape("display", none, none, issue))]
    # the regions are rows: one plan for all of them, over levels, spans and metrics that are written once
    keys = [*of, "_region"]
    each = F.explode(F.array(*[F.lit(region) for region in regions]))
    levels = settle(reduce(DataFrame.unionByName, [frame_medians(placed, of, box).withColumn("_region", F.lit(region)) for region, box in regions.items()]))
    shut = placed.where("mode = 'ffc'").select(*of, "frame", "ts_ns", "ffc_state")
    spans = settle(recovery_windows(shut, of, window_ns=window_ns, delay_ns=delay_ns, gap_ns=gap_ns)).withColumn("_region", each)
    events = ffc_recovery(levels.where("mode = 'ffc'"), spans, keys, window_ns=window_ns)
    parts.append(events.select(*shape("ffc_event", F.col("cluster"), F.col("post_minus_pre_counts"), F.col("reason"))))
    phased = interval_join(levels.where("mode <> 'ffc'"), windows, ["run"], "ts_ns", bucket=window_ns, disjoint=True)
    metrics = settle(phase_metric(phased, [*keys, "phase"]))
    stable = metrics.where("mode = 'restart' and phase = 'stable'")
    restarts = runs.where("mode = 'restart'").select(*of).withColumn("_region", each)
    held = restarts.join(stable, keys, "left")
    parts.append(held.select(*shape("stable", F.lit("stable"), F.col("median"), F.when(F.col("median").isNull(), "stable_phase_missing"))))
    moved = restart_offsets(stable.select(*keys, "median"), ["session", "_region"], "run", "median")
    parts.append(moved.select(*shape("restart_offset", F.col("reference_run"), F.col("offset"), none)))
    dynamic = metrics.where("mode = 'dynamic'")
    parts.append(dynamic.select(*shape("phase", F.col("phase"), F.col("median"), none)))
    cycles = dynamic_cycles(dynamic, keys, "phase", "median")
    for change in ("hot_minus_baseline", "recovery_minus_baseline"):
        parts.append(cycles.select(*shape(change, F.col("cycle"), F.col(change), F.col("issue"))))
    return reduce(DataFrame.unionByName, parts)
