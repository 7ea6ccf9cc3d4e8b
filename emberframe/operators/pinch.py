"""Pinch-signal sessions: accepted samples, phase medians, centred effects, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.numbers import all_reasons, finite_pair, is_finite, median_of
from emberframe.operators.quantiles import exact_quantiles

# Fixed values of the pinch protocol and its decision gates.
GROUPS = 6
TARGET_SAMPLES = 5
TIPS = ("thumb_tip", "index_tip")
PHASE_LABELS = {
    "record_just_touch": "contact",
    "record_press_hard": "press",
    "record_return_touch": "contact",
}
TOUCH = "record_just_touch"
# Column suffix of each phase.
SUFFIX = {phase: phase.removeprefix("record_") for phase in PHASE_LABELS}
MIN_VALID_GROUPS = 5
MIN_ACCURACY = 0.75
MIN_GAIN = 0.10
MIN_CONSISTENT_GROUPS = 4
MAX_RECOVERY = 0.50

POINTS = ("thermal_uv", "thermal_pixel", "color_pixel", "depth_pixel")
SCALARS = ("raw", "patch", "corrected_exact", "corrected_patch", "depth_m")


def session_identity(rows: DataFrame, expected: dict[str, object]) -> DataFrame:
    """``metadata_valid`` per session: one metadata and one summary row that agree.

    The metadata row must carry the ``expected`` values, and the summary must
    account for all groups and say complete exactly when enough are valid.
    """
    meta, summary = F.col("row_type") == "metadata", F.col("row_type") == "summary"
    same = F.lit(True)
    for name, value in expected.items():
        same = same & F.col(name).eqNullSafe(F.lit(value))
    enough = F.col("pinch_signal_valid_groups") >= MIN_VALID_GROUPS
    told = (
        (F.col("pinch_signal_valid_groups") + F.col("pinch_signal_invalid_groups") == GROUPS)
        & F.col("pinch_signal_started")
        & (F.col("pinch_signal_protocol_completed") == enough)
        & (F.col("pinch_signal_acquisition_blocked") == ~enough)
        & (F.col("status") == F.when(enough, "ok").otherwise("blocked"))
    )
    ok = lambda flag, test: F.coalesce(F.bool_and(F.when(flag, F.coalesce(test, F.lit(False)))), F.lit(False))
    return rows.groupBy("session").agg(
        (
            (F.count(F.when(meta, 1)) == 1) & (F.count(F.when(summary, 1)) == 1)
            & ok(meta, same) & ok(summary, told)
        ).alias("metadata_valid")
    )


def accepted_tips(rows: DataFrame) -> DataFrame:
    """One row per accepted attempt and fingertip, from nested session rows.

    An attempt counts when its gate accepted it, it was recording inside its
    quota, its phase and label agree, and both tips carry every number.
    """
    cue = F.col("pinch_signal")
    labels = F.create_map(*[F.lit(v) for pair in PHASE_LABELS.items() for v in pair])
    known = (
        (F.col("row_type") == "attempt")
        & (F.col("status") == "software_gate_accepted")
        & cue["recording"] & cue["quota_accepted"]
        & (F.size(cue["quota_reasons"]) == 0)
        & (cue["target_valid_samples"] == TARGET_SAMPLES)
        & cue["group_index"].between(0, GROUPS - 1)
        & (cue["label"] == F.try_element_at(labels, cue["phase"]))
        & is_finite(F.col("thermal_frame_median_count"))
        & finite_pair(F.col("thermal_pinch_center_uv")).isNotNull()
        & F.col("pinch_geometry.valid") & is_finite(F.col("pinch_geometry.pinch_distance_2d_norm"))
        & F.col("thermal_patches_overlap").isNotNull()
        & ((cue["phase"] == TOUCH) | is_finite(F.col("pinch_center_shift_px")))
    )

    def complete(tip: Column) -> Column:
        good = tip["label"].isin(*TIPS)
        for name in ("thermal_raw_count", "thermal_patch_3x3_mean_count", "depth_m"):
            good = good & is_finite(tip[name])
        for name in POINTS:
            good = good & finite_pair(tip[name].cast("array<double>")).isNotNull()
        return F.coalesce(good, F.lit(False))

    tips = F.filter("fingertips", complete)
    whole = rows.filter(known).withColumn("_tips", tips).filter(
        F.size(F.array_distinct(F.transform("_tips", lambda t: t["label"]))) == len(TIPS)
    )
    def first_tip(name: str) -> Column:
        return F.get(F.filter("_tips", lambda t: t["label"] == name), 0)

    exploded = whole.withColumn("_t", F.explode(F.array(*[first_tip(n) for n in TIPS])))
    tip, level = F.col("_t"), F.col("thermal_frame_median_count")
    return exploded.select(
        "session", "attempt", cue["group_index"].alias("group_index"), cue["phase"].alias("phase"),
        tip["label"].alias("tip"),
        tip["thermal_raw_count"].alias("raw"),
        tip["thermal_patch_3x3_mean_count"].alias("patch"),
        (tip["thermal_raw_count"] - level).alias("corrected_exact"),
        (tip["thermal_patch_3x3_mean_count"] - level).alias("corrected_patch"),
        tip["depth_m"].alias("depth_m"),
        *[
            F.get(tip[p], i).cast("double").alias(f"{p}_{axis}")
            for p in POINTS for i, axis in enumerate("xy")
        ],
        F.col("pinch_geometry.pinch_distance_2d_norm").alias("pinch_2d"),
        F.col("pinch_center_shift_px").alias("center_shift_px"),
        F.col("thermal_patches_overlap").alias("patch_overlap"),
    )


def valid_groups(samples: DataFrame, *, wanted: int | None = TARGET_SAMPLES) -> DataFrame:
    """Accepted attempts per phase and whether the group is usable.

    ``wanted`` is the exact count each phase needs; None asks for at least one.
    """
    one_tip = samples.filter(F.col("tip") == TIPS[0])
    counts = {p: F.count(F.when(F.col("phase") == p, 1)) for p in PHASE_LABELS}
    groups = one_tip.groupBy("session", "group_index").agg(
        *[c.alias(f"n_{SUFFIX[p]}") for p, c in counts.items()]
    )
    valid = F.lit(True)
    for label in SUFFIX.values():
        n = F.col(f"n_{label}")
        valid = valid & ((n >= 1) if wanted is None else (n == wanted))
    return groups.withColumn("valid", valid)


def _phase_wide(medians: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    at = lambda n, p: F.max(F.when(F.col("phase") == p, F.col(n)))
    return medians.groupBy(*keys).agg(
        *[at(n, p).alias(f"{n}_{SUFFIX[p]}") for n in names for p in PHASE_LABELS]
    )


def _melted_medians(samples: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Median of several columns per (keys, phase) in one pass over long rows."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    long = samples.select(*keys, "phase", F.explode(cells).alias("_c")).select(
        *keys, "phase", F.col("_c.name").alias("name"), F.col("_c.value").alias("value")
    )
    medians = exact_quantiles(long, [*keys, "phase", "name"], "value", {"median": 0.5})
    return medians.groupBy(*keys, "phase").agg(
        *[F.max(F.when(F.col("name") == n, F.col("median"))).alias(n) for n in names]
    )


def centred(name: str) -> Column:
    """Press minus the mean of touch and return."""
    return F.col(f"{name}_press_hard") - 0.5 * (F.col(f"{name}_just_touch") + F.col(f"{name}_return_touch"))


def tip_effects(samples: DataFrame) -> DataFrame:
    """Phase medians per tip with centred effects, return delta and shifts."""
    keys = ["session", "group_index", "tip"]
    points = [f"{p}_{a}" for p in POINTS for a in "xy"]
    names = [*SCALARS, *points]
    wide = _phase_wide(_melted_medians(samples, keys, names), keys, names)
    moved = {}
    for phase in ("press_hard", "return_touch"):
        short = phase.split("_")[0]
        for p in POINTS:
            dx = F.col(f"{p}_x_{phase}") - F.col(f"{p}_x_just_touch")
            dy = F.col(f"{p}_y_{phase}") - F.col(f"{p}_y_just_touch")
            moved[f"{short}_{p}_shift_px"] = F.hypot(dx, dy)
        moved[f"{short}_depth_shift_m"] = F.col(f"depth_m_{phase}") - F.col("depth_m_just_touch")
    return wide.withColumns(
        {
            "exact_effect": centred("corrected_exact"),
            "patch_effect": centred("corrected_patch"),
            "return_delta": F.col("corrected_exact_return_touch") - F.col("corrected_exact_just_touch"),
            "raw_press_delta": F.col("raw_press_hard") - F.col("raw_just_touch"),
            **moved,
        }
    )


def group_effects(samples: DataFrame, groups: DataFrame) -> DataFrame:
    """Per valid group: primary, patch and geometry effect, recovery, shifts, overlap."""
    keys = ["session", "group_index"]
    kept = samples.join(groups.filter("valid").select(*keys), keys, "left_semi")
    per_tip = tip_effects(kept).groupBy(*keys).agg(
        *[F.median(c).alias(n) for n, c in (
            ("primary_effect", "exact_effect"), ("patch_effect", "patch_effect"), ("recovery_delta", "return_delta"))]
    )
    attempts = kept.filter(F.col("tip") == TIPS[0])
    names = ["pinch_2d", "center_shift_px"]
    shape = _phase_wide(_melted_medians(attempts, keys, names), keys, names)
    overlap = attempts.groupBy(*keys).agg(
        F.avg(F.when(F.col("patch_overlap"), 1.0).otherwise(0.0)).alias("patch_overlap_rate")
    )
    return per_tip.join(shape, keys).join(overlap, keys).select(
        *keys, "primary_effect", "patch_effect", centred("pinch_2d").alias("geometry_effect"),
        "recovery_delta", F.col("center_shift_px_press_hard").alias("press_center_shift_px"),
        F.col("center_shift_px_return_touch").alias("return_center_shift_px"), "patch_overlap_rate",
    )


def held_out_accuracy(effects: Column, *, groups: int = GROUPS) -> Column:
    """Paired balanced accuracy of half-median thresholds, each group held out once.

    ``effects`` is the array of a session's valid group effects, at most
    ``groups`` long; missing groups count as wrong.
    """

    def judged(value: Column, at: Column) -> Column:
        others = F.filter(effects, lambda _, i: i != at)
        press = median_of(others)
        contact_ok = press.isNotNull() & ~(
            ((press > 0) & (press / 2 <= 0)) | ((press < 0) & (press / 2 >= 0))
        )
        press_ok = ((press > 0) & (value >= press / 2)) | ((press < 0) & (value <= press / 2))
        one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
        return one(contact_ok) + one(press_ok)

    total = F.aggregate(F.transform(effects, judged), F.lit(0.0), lambda acc, v: acc + v)
    return total / (2.0 * groups)


def session_analysis(
    samples: DataFrame, sessions: DataFrame, *, wanted: int | None = TARGET_SAMPLES
) -> DataFrame:
    """One row per session: accuracies, per-tip direction, recovery, reasons and verdict.

    ``sessions`` has session and ``metadata_valid``. Only group-level rows, at most
    six per session, are gathered.
    """
    groups = valid_groups(samples, wanted=wanted)
    effects = group_effects(samples, groups)
    key = ["session", "group_index"]
    kept = samples.join(groups.filter("valid").select(*key), key, "left_semi")
    tips = tip_effects(kept)
    per_tip = tips.groupBy("session", "tip").agg(
        F.median("exact_effect").alias("median_effect"),
        F.count(F.when(F.col("exact_effect") > 0, 1)).alias("_up"),
        F.count(F.when(F.col("exact_effect") < 0, 1)).alias("_down"),
        (F.median(F.abs("return_delta")) / F.greatest(F.median(F.abs("exact_effect")), F.lit(1.0))).alias("recovery"),
    )
    per_tip = per_tip.withColumns(
        {
            "direction": F.signum("median_effect"),
            "consistent": F.when(F.col("median_effect") > 0, F.col("_up"))
            .when(F.col("median_effect") < 0, F.col("_down"))
            .otherwise(F.lit(0)),
        }
    ).groupBy("session").agg(
        F.count(F.lit(1)).alias("_tips"),
        F.min("direction").alias("_dmin"), F.max("direction").alias("_dmax"),
        F.min("consistent").alias("consistent_groups"), F.max("recovery").alias("press_recovery_ratio"),
    )
    gathered = effects.groupBy("session").agg(
        F.count(F.lit(1)).alias("valid_groups"),
        F.array_sort(F.collect_list(F.struct("group_index", "primary_effect", "geometry_effect"))).alias("_g"),
        F.median("primary_effect").alias("median_effect"),
        F.median("patch_effect").alias("patch_median_effect"),
    )
    ir = held_out_accuracy(F.transform("_g", lambda g: g["primary_effect"]))
    geometry = held_out_accuracy(F.transform("_g", lambda g: g["geometry_effect"]))
    joined = sessions.join(gathered, "session", "left").join(per_tip, "session", "left")
    joined = joined.withColumns(
        {
            "valid_groups": F.coalesce("valid_groups", F.lit(0).cast("long")),
            "ir_accuracy": F.coalesce(ir, F.lit(0.0)),
            "geometry_accuracy": F.coalesce(geometry, F.lit(0.0)),
        }
    ).withColumn("ir_gain", F.col("ir_accuracy") - F.col("geometry_accuracy"))
    blocked = all_reasons(
        (~F.col("metadata_valid"), "metadata_mismatch"),
        (F.col("valid_groups") < MIN_VALID_GROUPS, "insufficient_valid_groups"),
    )
    agree = (
        (F.col("_tips") == len(TIPS)) & (F.col("_dmin") == F.col("_dmax")) & (F.col("_dmin") != 0)
        & (F.col("consistent_groups") >= MIN_CONSISTENT_GROUPS)
    )
    same_sign = F.col("median_effect") * F.col("patch_median_effect") > 0
    failed = all_reasons(
        (F.col("ir_accuracy") < MIN_ACCURACY, "ir_eba_below_threshold"),
        (F.col("ir_gain") < MIN_GAIN, "ir_gain_over_geometry_below_threshold"),
        (~F.coalesce(agree, F.lit(False)), "per_tip_press_direction_inconsistent"),
        (~F.coalesce(same_sign, F.lit(False)), "sampling_method_sign_disagreement"),
        (
            F.coalesce(F.col("press_recovery_ratio") > MAX_RECOVERY, F.lit(True)),
            "press_recovery_ratio_above_threshold",
        ),
    )
    reasons = F.when(F.size(blocked) > 0, blocked).otherwise(failed)
    verdict = (
        F.when(F.size(blocked) > 0, "BLOCKED_ACQUISITION")
        .when(F.size(failed) > 0, "STOP_BEFORE_STAGE1F")
        .otherwise("PROCEED_TO_STAGE1F_SHADOW")
    )
    return joined.select(
        "session", "valid_groups", "ir_accuracy", "geometry_accuracy", "ir_gain", "median_effect",
        "patch_median_effect", "consistent_groups", "press_recovery_ratio",
        reasons.alias("reasons"), verdict.alias("verdict"),
    )


def descriptive_replay(analysis: DataFrame, identity: DataFrame) -> DataFrame:
    """The same analysis marked as non-authoritative, with its identity checks beside it."""
    return analysis.join(identity, "session", "left").withColumns(
        {"authoritative": F.lit(False), "descriptive_verdict": F.col("verdict")}
    ).drop("verdict")
