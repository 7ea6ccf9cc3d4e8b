"""How the driver tables play the roles of sensor recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators.ordered import Series

# Seconds are counted from the first instant of 2024, as the stored wall clock reads.
ORIGIN = "2024-01-01 00:00:00"

EVENT_SERIES = Series(keys=("trial",), order=("t_us", "frame"))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def micros_since_origin(ts: str) -> Column:
    """Microseconds since the origin; both ends are read in the session zone, so it cancels."""
    origin = F.lit(ORIGIN).cast("timestamp_ntz").cast("timestamp")
    return F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(origin)


def instant(ts: str) -> Column:
    """The stored wall clock as an instant, read as UTC whatever the session zone is."""
    return F.timestamp_micros(micros_since_origin(ts) + F.lit(1_704_067_200_000_000))


def telemetry(spark: SparkSession, root: str) -> DataFrame:
    """``events`` as trial telemetry: one trial per user, one row per frame."""
    events = table(spark, root, "events")
    micros = micros_since_origin("ts")
    return events.select(
        F.col("user_id").alias("trial"),
        F.col("event_id").alias("frame"),
        micros.alias("t_us"),
        (micros / F.lit(1e6)).alias("t"),
        F.col("event_type").alias("phase"),
        F.col("value").alias("signal"),
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("int").alias("counter"),
    )


# The same binding for the SQL side.
TELEMETRY_SQL = """
ev AS (
  SELECT user_id AS trial, event_id AS frame,
         epoch_us(ts) - 1704067200000000 AS t_us,
         (epoch_us(ts) - 1704067200000000) / 1e6 AS t,
         event_type AS phase, value AS signal,
         CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS counter
  FROM events
)"""


def with_telemetry(body: str) -> str:
    return f"WITH {TELEMETRY_SQL.strip()}{body}"


def frames(spark: SparkSession, root: str) -> DataFrame:
    """``embeddings`` as 8x8 frames; values scaled to counts."""
    return frames_of(table(spark, root, "embeddings"))


def frames_of(rows: DataFrame) -> DataFrame:
    counts = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000).cast("int"))
    return rows.select(
        F.col("label").alias("trial"),
        F.col("vec_id").alias("frame"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        counts.alias("pixels"),
    )


# One row per pixel: y = pos // 8, x = pos % 8.
FRAMES_SQL = """
px AS (
  SELECT label AS trial, vec_id AS frame, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x,
         CAST(round(CAST(embedding[pos] AS DOUBLE) * 1000) AS INTEGER) AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) AS p
)"""


def with_frames(body: str) -> str:
    return f"WITH {FRAMES_SQL.strip()}{body}"


def q(value, places: int = 6):
    """Round for comparison: sums of floats depend on their order in the last bits."""
    return F.round(value, places)
