"""Paired null/press inference: binned curves, integrity, cluster permutation test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions import arrays
from emberframe.functions.numbers import (
    all_reasons,
    finite_or_null,
    first_reason,
    half_open_bin,
    is_finite,
)
from emberframe.operators.ordered import Series, previous, running_sum, scan, with_group_stats
from emberframe.operators.quantiles import exact_median
from emberframe.operators.settle import settle


def measured_bins(
    df: DataFrame, keys: list[str], at: str, value: str, *, start: float, width: float, bins: int
) -> DataFrame:
    """Median and count per half-open time bin; bins without samples are absent."""
    index = half_open_bin(F.col(at), start, width, start + width * bins)
    placed = df.withColumn("bin", index).filter(F.col("bin").isNotNull())
    counts = placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(exact_median(placed, [*keys, "bin"], value), [*keys, "bin"], "left")


def with_every_bin(df: DataFrame, keys: list[str], groups: DataFrame, bins: int) -> DataFrame:
    """Add rows for the bins a group lacks (count 0, null elsewhere)."""
    grid = groups.select(*keys).distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    full = grid.join(df, [*keys, "bin"], "left")
    return full.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def binned_curve(
    df: DataFrame, keys: list[str], at: str, value: str, *, start: float, width: float, bins: int
) -> DataFrame:
    measured = measured_bins(df, keys, at, value, start=start, width=width, bins=bins)
    return with_every_bin(measured, keys, df, bins)


# Fixed values of the single-finger protocol.
PHASES = ("A1", "X", "A2", "A3")
PHASE_SECONDS = 5.0
BIN_SECONDS = 0.5
BINS_PER_PHASE = 10
MIN_FRAMES_PER_BIN = 2
MAX_GAP_S = 0.75
ANALYSIS_START_S = 5.0
ANALYSIS_BINS = 30
PAIRS = 6
T_THRESHOLD_DF5 = 2.5706
SIGNIFICANCE = 0.05
TRIAL = ["session", "block", "condition"]


def admissible(rows: DataFrame) -> DataFrame:
    """Frame rows of a known condition with a block number."""
    return rows.filter(
        (F.col("row_type") == "frame") & F.col("condition").isin("null", "press") & F.col("block").isNotNull()
    )


def trial_integrity(rows: DataFrame, order: str, *, rows_per_chunk: int | None = None) -> DataFrame:
    """Per trial: ordered reasons why it cannot be used; empty means valid.

    ``rows`` has phase, phase_elapsed_s, thermal_host_s and the booleans
    ffc_active, artifact_ok, tracking_valid.
    """
    timed = rows.filter(is_finite(F.col("thermal_host_s")))
    series = Series(tuple(TRIAL), (order,))
    stepped = scan(timed, series, {"_t": previous(F.col("thermal_host_s"))}, rows_per_chunk=rows_per_chunk)
    step = F.col("thermal_host_s") - F.col("_t")
    gaps = stepped.groupBy(*TRIAL).agg(
        F.coalesce(F.bool_or((step <= 0) | (step > MAX_GAP_S)), F.lit(False)).alias("_gap")
    )
    elapsed = F.col("phase_elapsed_s")
    known = F.coalesce(F.col("phase").isin(*PHASES), F.lit(False))
    timely = is_finite(elapsed) & (elapsed >= 0) & (elapsed < PHASE_SECONDS)
    flags = rows.groupBy(*TRIAL).agg(
        F.bool_or("ffc_active").alias("_ffc"),
        F.bool_or(~F.coalesce(F.col("artifact_ok"), F.lit(False))).alias("_artifact"),
        F.bool_or(~is_finite(F.col("thermal_host_s"))).alias("_untimed"),
        F.bool_or(~known).alias("_phase"),
        F.bool_or(known & ~F.coalesce(timely, F.lit(False))).alias("_elapsed"),
    )
    tracked = rows.filter(known & timely & F.col("tracking_valid")).withColumn(
        "bin", F.least(F.floor(elapsed / BIN_SECONDS), F.lit(BINS_PER_PHASE - 1)).cast("int")
    )
    counts = tracked.groupBy(*TRIAL, "phase", "bin").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(p).alias("phase"), F.lit(b).alias("bin"))
            for i, (p, b) in enumerate((p, b) for p in PHASES for b in range(BINS_PER_PHASE))
        ]
    )
    grid = flags.select(*TRIAL, F.explode(cells).alias("_c")).select(*TRIAL, "_c.*")
    short = (
        grid.join(counts, [*TRIAL, "phase", "bin"], "left")
        .filter(F.coalesce("n", F.lit(0)) < MIN_FRAMES_PER_BIN)
        .groupBy(*TRIAL)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("rank", F.concat_ws(":", F.lit("insufficient_tracking"), "phase", F.col("bin").cast("string")).alias("reason"))
                )
            ).alias("_short")
        )
    )
    joined = flags.join(gaps, TRIAL, "left").join(short, TRIAL, "left")
    head = all_reasons(
        (F.col("_ffc"), "ffc_active"),
        (F.col("_artifact"), "required_artifact_write_failed"),
        (F.col("_untimed") | F.coalesce("_gap", F.lit(False)), "thermal_timestamp_gap"),
        (F.col("_phase"), "invalid_phase"),
        (F.col("_elapsed"), "invalid_phase_elapsed"),
    )
    tail = F.coalesce(F.transform("_short", lambda s: s["reason"]), F.array().cast("array<string>"))
    return joined.select(*TRIAL, F.concat(head, tail).alias("reasons"))


def selected_blocks(integrity: DataFrame, *, wanted: int = PAIRS) -> DataFrame:
    """Every block with its validity; ``selected`` marks the first valid pairs."""
    blocks = integrity.groupBy("session", "block").agg(
        (F.count_distinct("condition") == 2).alias("_both"),
        F.bool_and(F.size("reasons") == 0).alias("_clean"),
    ).withColumn("valid", F.col("_both") & F.col("_clean"))
    flag = F.when(F.col("valid"), 1).otherwise(0).cast("long")
    ranked = scan(blocks, Series(("session",), ("block",)), {"_nth": running_sum(flag)})
    reason = F.when(~F.col("_both"), "condition_missing").when(~F.col("_clean"), "trial_invalid")
    return ranked.select(
        "session", "block", "valid", (F.col("valid") & (F.col("_nth") <= wanted)).alias("selected"),
        reason.alias("reason"),
    )


def trial_curve(rows: DataFrame) -> DataFrame:
    """Tracked rows relative to their trial's resting medians (A1, seconds 3 to 5).

    Trials whose resting medians are missing give no rows here and a reason in
    ``curve_failures``.
    """
    valid = rows.filter("tracking_valid")
    base = _resting(valid)
    fields = ("primary_signal_count", "u", "v", "depth_m")
    usable = is_finite(F.col("global_elapsed_s"))
    for f in fields:
        usable = usable & is_finite(F.col(f))
    for f in fields:
        usable = usable & F.col(f"rest_{f}").isNotNull()
    joined = valid.join(base, TRIAL).filter(usable)
    return joined.select(
        *TRIAL, F.col("global_elapsed_s").alias("time_s"),
        (F.col("primary_signal_count") - F.col("rest_primary_signal_count")).alias("primary_signal_count"),
        F.hypot(F.col("u") - F.col("rest_u"), F.col("v") - F.col("rest_v")).alias("uv_displacement_px"),
        (F.col("depth_m") - F.col("rest_depth_m")).alias("depth_change_m"),
    )


def _resting(valid: DataFrame) -> DataFrame:
    resting = valid.filter((F.col("phase") == "A1") & F.col("phase_elapsed_s").between(3.0, 5.0)).filter(
        F.col("phase_elapsed_s") < 5.0
    )
    base = valid.select(*TRIAL).distinct()
    for f in ("primary_signal_count", "u", "v", "depth_m"):
        finite = resting.withColumn(f, finite_or_null(F.col(f)))
        base = base.join(exact_median(finite, TRIAL, f, f"rest_{f}"), TRIAL, "left")
    return base


def curve_failures(rows: DataFrame) -> DataFrame:
    """Trials without a resting median, with the first one that is missing."""
    names = {
        "primary_signal_count": "primary_baseline_missing", "u": "u_baseline_missing",
        "v": "v_baseline_missing", "depth_m": "depth_baseline_missing",
    }
    reason = first_reason(*[(F.col(f"rest_{f}").isNull(), r) for f, r in names.items()])
    return _resting(rows.filter("tracking_valid")).select(*TRIAL, reason.alias("reason")).filter(
        F.col("reason").isNotNull()
    )


CURVE_FIELDS = ("primary_signal_count", "uv_displacement_px", "depth_change_m")


def long_curves(curves: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in CURVE_FIELDS])
    return curves.select(*TRIAL, "time_s", F.explode(pairs).alias("_f")).select(*TRIAL, "time_s", "_f.*")


def paired_differences(binned: DataFrame, keys: list[str], pair: str, value: str = "median") -> DataFrame:
    """press - null per pair and bin; null where either side is missing."""
    side = lambda c: F.max(F.when(F.col("condition") == c, F.col(value)))
    return binned.groupBy(*keys, pair, "bin").agg((side("press") - side("null")).alias("difference"))


def _t_value(values: Column) -> Column:
    """One-sample t of a short array; signed infinity without spread, zero without effect."""
    n = F.size(values).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    mean = total(values) / n
    squares = total(arrays.against(values, mean, lambda v, m: (v - m) * (v - m)))
    spread = F.sqrt(squares / (n - 1)) / F.sqrt(n)
    return (
        F.when(spread > 0, mean / spread)
        .when(mean > 0, F.lit(float("inf")))
        .when(mean < 0, F.lit(float("-inf")))
        .otherwise(F.lit(0.0))
    )


def _pair_arrays(differences: DataFrame, keys: list[str], pair: str) -> DataFrame:
    """Per bin the pairs' differences in pair order: as many entries as the study has pairs."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pair).alias("p"), F.col("difference").alias("d"))))
    return differences.groupBy(*keys, "bin").agg(F.transform(ordered, lambda x: x["d"]).alias("values"))


def paired_t(differences: DataFrame, keys: list[str], pair: str) -> DataFrame:
    arrays = _pair_arrays(differences, keys, pair)
    return arrays.select(*keys, "bin", F.size("values").alias("pairs"), _t_value(F.col("values")).alias("t"))


_CLUSTER = "array<struct<start_bin:int,end_bin:int,sign:int,mass:double>>"


def _clusters(ts: Column, threshold: float) -> Column:
    """Runs of neighbouring bins beyond the threshold with one sign, with their mass.

    One left-to-right fold over the bins of a row; the last entry is the open run.
    """
    state = F.struct(F.array().cast(_CLUSTER).alias("done"), F.lit(0).alias("at"))

    def step(acc: Column, t: Column) -> Column:
        done, at = acc["done"], acc["at"]
        sign = F.when(t > 0, 1).otherwise(-1)
        last = F.get(done, F.size(done) - 1)
        joins = (F.size(done) > 0) & (last["end_bin"] == at - 1) & (last["sign"] == sign)
        grown = F.struct(
            last["start_bin"].alias("start_bin"), at.alias("end_bin"), last["sign"].alias("sign"),
            (last["mass"] + F.abs(t)).alias("mass"),
        )
        fresh = F.struct(at.alias("start_bin"), at.alias("end_bin"), sign.alias("sign"), F.abs(t).alias("mass"))
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        after = F.when(
            F.abs(t) > threshold,
            F.when(F.coalesce(joins, F.lit(False)), F.concat(head, F.array(grown).cast(_CLUSTER))).otherwise(
                F.concat(done, F.array(fresh).cast(_CLUSTER))
            ),
        ).otherwise(done)
        return F.struct(after.alias("done"), (at + 1).alias("at"))

    return F.aggregate(ts, state, step, lambda acc: acc["done"])


def permutation_clusters(
    differences: DataFrame, keys: list[str], pair: str, *, pairs: int = PAIRS, bins: int = ANALYSIS_BINS,
    threshold: float = T_THRESHOLD_DF5,
) -> DataFrame:
    """Clusters of all 2^pairs sign patterns; the last pattern is the data as observed.

    Input is aggregated already (pairs x bins per test). Each bin keeps its pairs
    in one row, so every pattern is the same arithmetic in the same order and the
    observed clusters compare exactly with their own pattern. Tests that are not
    complete give no rows.
    """
    arrays = _pair_arrays(differences.filter(F.col("difference").isNotNull()), keys, pair)
    whole = with_group_stats(
        arrays, keys,
        {
            "_bins": F.count(F.lit(1)),
            "_least": F.min(F.size("values")), "_most": F.max(F.size("values")),
        },
    ).filter((F.col("_bins") == bins) & (F.col("_least") == pairs) & (F.col("_most") == pairs))
    patterns = whole.select(
        *keys, "bin", "values", F.explode(F.sequence(F.lit(0), F.lit(2**pairs - 1))).alias("perm")
    )
    keeps = [F.col("perm").bitwiseAND(F.lit(1 << i)) != 0 for i in range(pairs)]
    signs = F.array(*[F.when(k, 1.0).otherwise(-1.0) for k in keeps])
    flipped = F.zip_with(F.col("values"), signs, lambda v, s: v * s)
    t = patterns.select(*keys, "perm", "bin", _t_value(flipped).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("bin", "t")))
    rows = t.groupBy(*keys, "perm").agg(F.transform(ordered, lambda b: b["t"]).alias("_ts"))
    return rows.select(*keys, "perm", _clusters(F.col("_ts"), threshold).alias("clusters"))


def cluster_permutation(
    differences: DataFrame, keys: list[str], pair: str, *, pairs: int = PAIRS, bins: int = ANALYSIS_BINS,
    threshold: float = T_THRESHOLD_DF5,
) -> DataFrame:
    """Exact sign-flip cluster test: observed clusters with their corrected p."""
    rows = permutation_clusters(
        differences, keys, pair, pairs=pairs, bins=bins, threshold=threshold
    )
    largest = F.coalesce(F.array_max(F.transform("clusters", lambda c: c["mass"])), F.lit(0.0))
    masses = rows.select(*keys, "perm", largest.alias("largest"))
    observed = rows.filter(F.col("perm") == 2**pairs - 1).select(
        *keys, F.explode("clusters").alias("_c")
    ).select(*keys, "_c.*")
    return observed.join(masses, keys).groupBy(*keys, "start_bin", "end_bin", "sign", "mass").agg(
        F.count(F.lit(1)).alias("permutations"),
        F.avg(F.when(F.col("largest") >= F.col("mass"), 1.0).otherwise(0.0)).alias("p_corrected"),
    )


def cluster_report(
    clusters: DataFrame, differences: DataFrame, keys: list[str], *, kelvin: float | None = None
) -> DataFrame:
    """Significant clusters with their seconds, median and largest difference."""
    kept = clusters.filter(F.col("p_corrected") <= SIGNIFICANCE)
    inside = kept.join(differences, keys).filter(F.col("bin").between(F.col("start_bin"), F.col("end_bin")))
    at = [*keys, "start_bin", "end_bin", "sign", "mass", "p_corrected"]
    out = inside.groupBy(*at).agg(
        F.median("difference").alias("median_difference"),
        F.max(F.abs("difference")).alias("largest_difference"),
    )
    out = out.withColumns(
        {
            "start_s": ANALYSIS_START_S + F.col("start_bin") * BIN_SECONDS,
            "end_s": ANALYSIS_START_S + (F.col("end_bin") + 1) * BIN_SECONDS,
        }
    )
    if kelvin is not None:
        out = out.withColumn("median_difference_k", F.col("median_difference") * kelvin)
    return out


# Descriptive windows as half-open bin ranges.
CURVE_WINDOWS = {
    "x_early": (0, 3), "x_middle": (3, 7), "x_late": (7, 10), "a2_contact": (10, 20), "a3_lift": (20, 30),
}


def window_descriptives(differences: DataFrame, keys: list[str]) -> DataFrame:
    """Median and largest absolute difference per named window."""
    spans = F.array(
        *[F.struct(F.lit(n).alias("window"), F.lit(a).alias("first"), F.lit(b).alias("stop")) for n, (a, b) in CURVE_WINDOWS.items()]
    )
    placed = differences.withColumn("_w", F.explode(spans)).filter(
        (F.col("bin") >= F.col("_w.first")) & (F.col("bin") < F.col("_w.stop"))
    )
    return placed.groupBy(*keys, F.col("_w.window").alias("window")).agg(
        F.median("difference").alias("median_difference"),
        F.max(F.abs("difference")).alias("largest_difference"),
    )


def late_slope(differences: DataFrame, keys: list[str], pair: str) -> DataFrame:
    """Median over pairs of the least-squares slope in the late contact window, per second."""
    first, stop = CURVE_WINDOWS["x_late"]
    late = differences.filter((F.col("bin") >= first) & (F.col("bin") < stop))
    slopes = late.groupBy(*keys, pair).agg(
        F.regr_slope("difference", F.col("bin") * F.lit(BIN_SECONDS)).alias("slope")
    )
    return slopes.groupBy(*keys).agg(F.median("slope").alias("median_late_slope"))


def curve_verdict(clusters: DataFrame, complete: DataFrame, keys: list[str], field: str = "field") -> DataFrame:
    """INCOMPLETE, GEOMETRY_CONFOUNDED, SIGNIFICANT or NO_DETECTED separation per session."""
    kept = clusters.filter(F.col("p_corrected") <= SIGNIFICANCE)
    thermal = kept.filter(F.col(field) == CURVE_FIELDS[0]).select(
        *keys, F.col("start_bin").alias("_a"), F.col("end_bin").alias("_b")
    )
    geometry = kept.filter(F.col(field) != CURVE_FIELDS[0]).select(*keys, "start_bin", "end_bin")
    overlapping = thermal.join(geometry, keys).filter(
        (F.col("_a") <= F.col("end_bin")) & (F.col("start_bin") <= F.col("_b"))
    ).select(*keys).distinct().withColumn("_confounded", F.lit(True))
    found = thermal.select(*keys).distinct().withColumn("_found", F.lit(True))
    joined = complete.join(overlapping, keys, "left").join(found, keys, "left")
    verdict = (
        F.when(~F.col("complete"), "INCOMPLETE_FOR_PRIMARY_TEST")
        .when(F.col("_confounded"), "GEOMETRY_CONFOUNDED")
        .when(F.col("_found"), "SIGNIFICANT_CURVE_SEPARATION")
        .otherwise("NO_DETECTED_SEPARATION_5S")
    )
    return joined.select(*keys, verdict.alias("verdict"))


def analyse_sessions(rows: DataFrame, order: str) -> dict[str, DataFrame]:
    """The whole paired analysis: integrity, blocks, differences, clusters, verdict.

    Results that several later steps read (one row per trial, or per pair and bin)
    are written once to the shared folder.
    """
    frames = admissible(rows)
    integrity = settle(trial_integrity(frames, order))
    blocks = settle(selected_blocks(integrity))
    failures = settle(curve_failures(frames))
    usable = blocks.filter("selected").join(
        failures.select("session", "block"), ["session", "block"], "left_anti"
    ).select("session", "block")
    curves = settle(long_curves(trial_curve(frames.join(usable, ["session", "block"], "left_semi"))))
    binned = measured_bins(
        curves, [*TRIAL, "field"], "time_s", "value",
        start=ANALYSIS_START_S, width=BIN_SECONDS, bins=ANALYSIS_BINS,
    )
    differences = settle(paired_differences(binned, ["session", "field"], "block"))
    clusters = settle(cluster_permutation(differences, ["session", "field"], "block"))
    cells = differences.filter(F.col("difference").isNotNull()).groupBy("session").agg(
        F.count(F.lit(1)).alias("_cells")
    )
    wanted = PAIRS * ANALYSIS_BINS * len(CURVE_FIELDS)
    complete = frames.select("session").distinct().join(cells, "session", "left").select(
        "session", (F.coalesce("_cells", F.lit(0)) == wanted).alias("complete")
    )
    return {
        "integrity": integrity, "blocks": blocks, "curve_failures": failures,
        "differences": differences, "clusters": clusters,
        "verdict": curve_verdict(clusters, complete, ["session"]),
    }
