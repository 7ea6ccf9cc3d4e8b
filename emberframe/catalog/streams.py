"""Structured Streaming runs and state-machine replays over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import micros_since_origin, q, telemetry, with_telemetry
from emberframe.catalog.registry import ORACLES, query
from emberframe.catalog import timing  # noqa: F401  registers the SQL reused below
from emberframe.streaming import machines, run, windows


def _stream(spark, root):
    rows = run.open_table(spark, f"{root}/events.parquet")
    micros = micros_since_origin("ts")
    return rows.select(
        F.col("user_id").alias("trial"), F.col("event_id").alias("frame"), micros.alias("t_us"),
        (micros / 1e6).alias("t"), F.col("event_type").alias("phase"), F.col("value").alias("value"),
    )


@query("stream_stable_gate", ORACLES["stable_gate"])
def stream_stable_gate(spark, root):
    """The stable gate as a stream with keyed state, against the batch SQL."""
    gate = machines.StableGate(target=30.0, tolerance=25.0, required_s=7200.0)
    out = run.run_available(run.stateful(_stream(spark, root), ["trial"], ["t_us", "frame"], gate), spark)
    return out.select("trial", "frame", q("stable_s").alias("stable_s"), "gate_open")


@query("stream_cycle_count", ORACLES["cycle_count"])
def stream_cycle_count(spark, root):
    counter = machines.CycleCounter(close=20.0, reopen=40.0)
    out = run.run_available(run.stateful(_stream(spark, root), ["trial"], ["t_us", "frame"], counter), spark)
    return out.groupBy("trial").agg(F.max("cycles").alias("cycles"))


@query("replay_hold_gate", ORACLES["hold_gate"])
def replay_hold_gate(spark, root):
    gate = machines.HoldGate(target=30.0, tolerance=25.0, max_gap_s=21600.0)
    rows = telemetry(spark, root).withColumnRenamed("signal", "value")
    return run.replay(rows, ["trial"], ["t_us", "frame"], gate).select("trial", "frame", "hold_ok")


@query("replay_gap_counter")
def replay_gap_counter(spark, root):
    rows = telemetry(spark, root).withColumn("missing", F.col("signal") < 40)
    return run.replay(rows, ["trial"], ["t_us", "frame"], machines.GapCounter(limit=6)).select(
        "trial", "frame", "gaps_in_row", "stream_lost"
    )


@query(
    "soak_verdict",
    with_telemetry(
        """
, s AS (SELECT *, lag(t) OVER (PARTITION BY trial ORDER BY t_us, frame) AS p FROM ev),
x AS (SELECT trial, min(CASE WHEN p IS NOT NULL AND t - p > 86400 THEN t_us END) AS stop, count(*) AS ticks FROM s GROUP BY trial),
k AS (SELECT ev.*, row_number() OVER (PARTITION BY ev.trial ORDER BY t_us, frame) AS rn, CASE WHEN signal >= 40 THEN 'open' WHEN signal <= 20 THEN 'closed' END AS mark FROM ev JOIN x USING (trial)
   WHERE phase = 'view' AND (stop IS NULL OR t_us < stop)),
f AS (SELECT trial, min(t_us) AS fo FROM k WHERE mark = 'open' GROUP BY trial),
l AS (SELECT k.trial, mark, lag(mark) OVER (PARTITION BY k.trial ORDER BY t_us, frame) AS was FROM k JOIN f USING (trial) WHERE mark IS NOT NULL AND t_us >= fo),
c AS (SELECT trial, count(CASE WHEN mark = 'open' AND was = 'closed' THEN 1 END) AS cycles FROM l GROUP BY trial)
SELECT trial, ticks, coalesce(cycles, 0) AS cycles, CAST(0 AS BIGINT) AS fault_closure_violations,
  CASE WHEN stop IS NOT NULL THEN 'oak_observed_timestamp_gap' WHEN coalesce(cycles, 0) < 2 THEN 'insufficient_cycles' ELSE 'completed' END AS reason
FROM x LEFT JOIN c USING (trial)"""
    ),
)
def soak_verdict(spark, root):
    rows = telemetry(spark, root).select(
        "trial", "t_us", "frame", F.col("t").alias("now_s"), F.col("frame").alias("frame_id"), F.col("t").alias("observed_s"),
        (F.col("phase") != "error").alias("hand_valid"), F.when(F.col("phase") == "view", "open").otherwise("closed").alias("fist"),
        F.lit("baseline").alias("status"), F.lit(True).alias("available"), F.col("signal").alias("pinch"),
    )
    monitor = machines.SoakMonitor(max_stall_s=86400.0, close=20.0, reopen=40.0)
    log = run.replay(rows, ["trial"], ["t_us", "frame"], monitor)
    return windows.soak_verdict(log, ["trial"], ["t_us", "frame"], min_cycles=2)
