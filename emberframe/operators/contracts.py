"""Ledger, schedule, identity and output checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.numbers import all_reasons
from emberframe.operators.ordered import Series, running_sum, scan
from emberframe.operators.windows import attempt_faults

# Label letters of the schedule and the abort budget per label.
LABELS = {"L": "loose", "T": "tight"}
ABORT_BUDGET = 5


def schedule_slots(schedules: DataFrame, keys: list[str], primary: str) -> DataFrame:
    """One row per scheduled slot (from 1) with its label letter."""
    return schedules.select(
        *keys, F.posexplode(F.split(primary, "")).alias("_pos", "letter")
    ).select(*keys, (F.col("_pos") + 1).cast("long").alias("slot"), "letter")


def schedule_issues(primary: Column, stored_hash: Column, per_label: int = 15) -> Column:
    """What is wrong with a schedule string: length, labels, balance, hash."""
    count = lambda letter: F.length(F.regexp_replace(primary, f"[^{letter}]", ""))
    return all_reasons(
        (F.length(primary) != 2 * per_label, "schedule_length"),
        ((count("L") != per_label) | (count("T") != per_label), "label_balance"),
        (F.sha2(primary, 256) != F.coalesce(stored_hash, F.lit("")), "schedule_hash_mismatch"),
    )


def ledger_violations(
    trials: DataFrame, slots: DataFrame, series: Series, *, rows_per_chunk: int | None = None
) -> DataFrame:
    """Every attempt with the reasons that break the ledger rules, in rule order.

    ``trials`` needs slot, attempt, label and outcome, and the booleans
    pretrial_ffc, ffc_reset, ffc_active, color_valid, thermal_valid, has_rgb,
    has_depth, has_thermal; ``slots`` gives the letter of (keys, slot).
    """
    keys = list(series.keys)
    completed = F.col("outcome") == "completed"
    ordered = attempt_faults(
        trials, series, "slot", "attempt", completed, rows_per_chunk=rows_per_chunk
    )
    expected = F.when(F.col("letter") == "L", F.lit("loose")).when(F.col("letter") == "T", F.lit("tight"))
    labelled = ordered.join(slots, [*keys, "slot"], "left").withColumn("expected_label", expected)
    aborted = F.when(F.col("outcome") == "technical_abort", 1).otherwise(0).cast("long")
    per_label = Series((*series.keys, "expected_label"), series.order)
    counted = scan(
        labelled, per_label, {"label_aborts": running_sum(aborted)}, rows_per_chunk=rows_per_chunk
    )
    repeats = counted.join(
        trials.groupBy(*keys, "slot", "attempt").agg(F.count(F.lit(1)).alias("_copies")),
        [*keys, "slot", "attempt"],
    )
    ffc_ready = F.col("pretrial_ffc") & F.col("ffc_reset")
    return repeats.withColumn(
        "violations",
        all_reasons(
            (F.col("_copies") > 1, "duplicate_key"),
            (F.col("slot_out_of_order"), "slot_out_of_order"),
            (F.col("attempt_mismatch"), "attempt_mismatch"),
            (F.coalesce(F.col("label") != F.col("expected_label"), F.lit(True)), "label_mismatch"),
            (completed & ~ffc_ready, "completed_without_ffc"),
            (completed & F.col("ffc_active") & F.col("thermal_valid"), "thermal_valid_during_ffc"),
            (
                completed & F.col("color_valid") & ~(F.col("has_rgb") & F.col("has_depth")),
                "color_artifact_missing",
            ),
            (
                completed & F.col("thermal_valid") & ~F.col("has_thermal"),
                "thermal_artifact_missing",
            ),
            ((aborted == 1) & (F.col("label_aborts") > ABORT_BUDGET), "abort_budget_exceeded"),
        ),
    ).drop("_copies")


def first_violation(violations: DataFrame, series: Series) -> DataFrame:
    """The first broken row per ledger with its first reason; null when all hold."""
    broken = F.size("violations") > 0
    at = F.when(broken, series.position())
    return violations.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count(F.when(broken, 1)).alias("broken_rows"),
        F.min_by(F.get("violations", 0), at).alias("first_violation"),
    )


def exactly_one(df: DataFrame, keys: list[str], kind: str, names: list[str]) -> DataFrame:
    """Row counts per row kind, and whether each of ``names`` occurs exactly once."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.when(F.col(kind) == n, 1)).alias(f"n_{n}") for n in names],
    )
    good = F.lit(True)
    for n in names:
        good = good & (F.col(f"n_{n}") == 1)
    return counts.withColumn("valid", good)


def identity_issues(row: DataFrame, expected: dict[str, object]) -> DataFrame:
    """Names of the identity fields that differ from their frozen values."""
    checks = [
        (~F.col(name).eqNullSafe(F.lit(value)), name) for name, value in expected.items()
    ]
    return row.withColumn("identity_issues", all_reasons(*checks))


def domain_issues(
    enums: dict[str, tuple[str, ...]], required: tuple[str, ...] = (), rep: str | None = None
) -> Column:
    """Spec violations: value outside its domain, empty text, repetition outside 1..99."""
    cases = [
        (~F.coalesce(F.col(name).isin(*values), F.lit(False)), f"invalid_{name}")
        for name, values in enums.items()
    ]
    cases += [
        (F.coalesce(F.trim(F.col(name).cast("string")) == "", F.lit(True)), f"empty_{name}")
        for name in required
    ]
    if rep is not None:
        cases.append((~F.coalesce(F.col(rep).between(1, 99), F.lit(False)), "rep_out_of_range"))
    return all_reasons(*cases)


def structural_issues(rules: dict[str, Column]) -> Column:
    """Names of the structural rules that do not hold (null counts as broken)."""
    return all_reasons(*[(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])


def not_fresh(planned: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Planned trials that already have recorded rows; must be empty before a recording."""
    return planned.join(recorded.select(*keys), keys, "left_semi")


def missing_from_grid(grid: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected combinations that never occur."""
    return grid.join(present.select(*keys), keys, "left_anti")


def content_manifest(files: DataFrame, path: str, content: str) -> DataFrame:
    """Path, size in bytes and SHA-256 of every file."""
    raw = F.col(content).cast("binary")
    return files.select(
        F.col(path).alias("path"),
        F.octet_length(raw).cast("long").alias("bytes"),
        F.sha2(raw, 256).alias("sha256"),
    )


def session_rollup(trials: DataFrame, session: list[str], block: str, *, wanted: int) -> DataFrame:
    """Pair validity per block rolled up to the session status.

    ``trials`` has valid, aborted and failed booleans and an artifact count.
    """
    blocks = trials.groupBy(*session, block).agg(
        F.bool_and("valid").alias("pair_valid"),
        F.count(F.lit(1)).alias("trials"),
        F.bool_or("aborted").alias("aborted"),
        F.bool_or("failed").alias("failed"),
        F.sum("artifacts").alias("artifacts"),
    )
    rolled = blocks.groupBy(*session).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count(F.when(F.col("pair_valid") & (F.col("trials") >= 2), 1)).alias("valid_pairs"),
        F.bool_or("aborted").alias("any_aborted"),
        F.bool_or("failed").alias("any_failed"),
        F.sum("artifacts").alias("artifacts"),
    )
    status = (
        F.when(F.col("any_failed"), "error")
        .when(F.col("any_aborted"), "aborted")
        .when(F.col("valid_pairs") >= wanted, "complete")
        .otherwise("incomplete")
    )
    return rolled.withColumn("status", status).drop("any_aborted", "any_failed")
