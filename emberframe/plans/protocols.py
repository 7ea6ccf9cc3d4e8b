"""Protocol plans as small generated tables, and checks of recordings against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberframe.functions.protocol import COMPRESSION_TARGETS, step_direction
from emberframe.operators.ordered import Series, previous, running_sum, scan

# State orders of the three recordings, in recording order.
STEADY_ORDERS = {
    1: ("C20", "N", "C0", "C30", "C10", "C0", "C20", "N", "C10", "C30"),
    2: ("N", "C10", "C30", "C0", "C20", "C30", "N", "C20", "C0", "C10"),
    3: ("C30", "C0", "N", "C20", "C10", "C20", "C10", "C30", "N", "C0"),
}
HYSTERESIS_STATES = ("C0", "C10", "C20", "C30", "C20", "C10", "C0", "R")
HYSTERESIS_SECONDS = (4.0, 4.0, 4.0, 6.0, 4.0, 4.0, 4.0, 12.0)
PULSE_STATES = (("release", "R", 8.0), ("target", "C30", 6.0), ("release", "R", 12.0))
PULSES = 4
# Conditions of the paired study's blocks in order, and the repeatability phases with their seconds.
PRIMARY_BLOCKS = (
    ("null", "press"), ("press", "null"), ("press", "null"),
    ("null", "press"), ("null", "press"), ("press", "null"),
)
RESERVE_BLOCKS = (("null", "press"), ("press", "null"))
REPEATABILITY_PHASES = {
    "ffc": (("stationary", 240.0),),
    "restart": (("warmup", 30.0), ("stable", 20.0), ("observation", 40.0)),
    "dynamic": (
        ("baseline_01", 15.0), ("hot_hand_01", 15.0), ("recovery_01", 15.0),
        ("baseline_02", 15.0), ("hot_hand_02", 15.0), ("recovery_02", 15.0),
    ),
}
# A plan is a table of this protocol's steps; anything longer is not one.
MAX_PLAN_STEPS = 1000
LEVEL_VALUES = {"zero": 0.0, "light": 1.0, "medium": 2.0, "hard": 3.0}


def recording_plan(spark: SparkSession) -> DataFrame:
    """All steps of the compression protocol for recordings 1 to 3."""
    base = "recording int, block string, phase string, state string, hold_s double, sequence_id int, step_index int, pulse_index int"
    drift = [("start_drift", 30.0, 0), ("middle_drift", 20.0, 2), ("end_drift", 30.0, 5)]
    rows = [(r, b, "baseline", "R", s, q, 0, 0) for r in STEADY_ORDERS for b, s, q in drift]
    for r, order in STEADY_ORDERS.items():
        rows += [(r, "steady_state", "release", "R", 6.0, 1, 2 * i, 0) for i in range(len(order))]
        rows += [(r, "steady_state", "target", s, 6.0, 1, 2 * i + 1, 0) for i, s in enumerate(order)]
        rows += [
            (r, "hysteresis", "target", s, hold, 3, i, 0)
            for i, (s, hold) in enumerate(zip(HYSTERESIS_STATES, HYSTERESIS_SECONDS))
        ]
        rows += [
            (r, "release_pulses", phase, s, hold, 4, 3 * p + k, p + 1)
            for p in range(PULSES)
            for k, (phase, s, hold) in enumerate(PULSE_STATES)
        ]
    plan = spark.createDataFrame(rows, base)
    targets = F.create_map(*[F.lit(v) for item in COMPRESSION_TARGETS.items() for v in item])
    name = F.format_string("%s_s%02d_step%02d_%s", "block", "sequence_id", "step_index", F.lower("state"))
    return plan.withColumns({"target_compression_pct": targets[F.col("state")], "step_name": name})


def stepped_plan(levels: DataFrame, cycles: int, level: str = "level", value: str = "value") -> DataFrame:
    """Levels repeated for every cycle with the direction from the step before.

    ``levels`` has step_index, a level name and its value.
    """
    repeated = levels.withColumn("cycle", F.explode(F.sequence(F.lit(1), F.lit(cycles))))
    repeated = repeated.withColumns({"_plan": F.lit(0), "_at": F.col("cycle") * F.lit(100_000) + F.col("step_index")})
    walked = scan(repeated, Series(("_plan",), ("_at",)), {"_before": previous(F.col(value))})
    name = F.format_string("cycle%02d_step%02d_%s", "cycle", "step_index", level)
    return walked.select(
        "cycle", "step_index", name.alias("step_name"), value,
        step_direction(F.col("_before"), F.col(value)).alias("direction"),
    )


def block_schedule(spark: SparkSession) -> DataFrame:
    """Trials of the paired study: the primary blocks, then the reserve ones, of two conditions each."""
    primary = spark.createDataFrame([(list(PRIMARY_BLOCKS), False), (list(RESERVE_BLOCKS), True)], "pairs array<array<string>>, reserve boolean")
    blocks = primary.select("reserve", F.posexplode("pairs").alias("nth", "pair"))
    block = F.col("nth") + F.when(F.col("reserve"), len(PRIMARY_BLOCKS)).otherwise(0)
    return blocks.select(block.alias("block"), "reserve", F.posexplode("pair").alias("order_in_block", "condition")).select(
        "block", "condition", "order_in_block", "reserve"
    )


def repeatability_plan(spark: SparkSession) -> DataFrame:
    rows = [
        (mode, i, name, seconds)
        for mode, phases in REPEATABILITY_PHASES.items()
        for i, (name, seconds) in enumerate(phases)
    ]
    return spark.createDataFrame(rows, "mode string, position int, phase string, seconds double")


def phase_sums(rows: DataFrame, plan: DataFrame, mode: str, elapsed: str, sums: dict[str, Column]) -> DataFrame:
    """Aggregates of the rows in each phase of a plan (mode, position, phase, seconds), phases one after another.

    ``elapsed`` is in seconds of the mode's run; rows outside all phases count nowhere, phases without rows stay.
    The plan's few windows per mode are an array beside the mode's rows, so rows are neither copied nor sorted.
    """
    each = Window.partitionBy("mode").orderBy("position")
    timed = plan.withColumn("_end", F.sum("seconds").over(each))
    windows = timed.groupBy(F.col("mode").alias(mode)).agg(
        F.array_sort(F.collect_list(F.struct("_end", (F.col("_end") - F.col("seconds")).alias("_start"), "position"))).alias("_windows")
    )
    inside = lambda w: (F.col(elapsed) >= w["_start"]) & (F.col(elapsed) < w["_end"])
    placed = rows.join(windows, mode).withColumn("position", F.get(F.filter("_windows", inside), 0)["position"])
    found = placed.where(F.col("position").isNotNull()).groupBy(mode, "position").agg(*[c.alias(n) for n, c in sums.items()])
    counted = {n: F.coalesce(n, F.lit(0).cast("long")) for n in sums if dict(found.dtypes)[n] == "bigint"}
    return plan.withColumnRenamed("mode", mode).join(found, [mode, "position"], "left").withColumns(counted)


def realized_blocks(validity: DataFrame, keys: list[str], *, wanted: int = 6) -> DataFrame:
    """Blocks a session runs: all primary ones, reserves only while pairs are missing."""
    flag = F.when(F.col("valid"), 1).otherwise(0).cast("long")
    counted = scan(validity, Series(tuple(keys), ("block",)), {"_valid": running_sum(flag)})
    before = F.col("_valid") - flag
    primary = F.col("block") < len(PRIMARY_BLOCKS)
    reserve = (F.col("block") < len(PRIMARY_BLOCKS) + len(RESERVE_BLOCKS)) & (before < wanted)
    return counted.filter(primary | reserve).drop("_valid")


def plan_completeness(events: DataFrame, plan: DataFrame, keys: list[str], step: list[str]) -> DataFrame:
    """Planned steps per recording with how often the log completed them.

    ``plan`` is a fixed protocol of a few dozen steps; the log is aggregated first.
    """
    done = events.groupBy(*keys, *step).agg(F.count(F.lit(1)).alias("completions"))
    runs = events.select(*keys).distinct()
    listed = F.when(F.count(F.lit(1)) <= MAX_PLAN_STEPS, F.collect_list(F.struct(*step))).otherwise(
        F.raise_error(F.lit("not a protocol plan: too many steps"))
    )
    steps = plan.select(*step).distinct().limit(MAX_PLAN_STEPS + 1)
    cells = steps.agg(listed.alias("_steps"), F.lit(1).alias("_one"))
    grid = runs.withColumn("_one", F.lit(1)).join(F.broadcast(cells), "_one").select(
        *keys, F.explode("_steps").alias("_s")
    ).select(*keys, "_s.*")
    joined = grid.join(done, [*keys, *step], "left")
    return joined.withColumn("completions", F.coalesce("completions", F.lit(0).cast("long")))


def sweep_goal(start: Column, end: Column, elapsed: Column, duration: Column) -> Column:
    share = F.least(F.greatest(F.try_divide(elapsed, duration), F.lit(0.0)), F.lit(1.0))
    return start + (end - start) * share
