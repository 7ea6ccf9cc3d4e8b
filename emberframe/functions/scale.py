"""Input-size checks that choose between a one-task and a split strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame

ONE_TASK_BYTES_SETTING = "emberframe.oneTaskBytes"
ONE_TASK_BYTES = 64 * 1024 * 1024
ROWS_PER_CHUNK_SETTING = "emberframe.rowsPerChunk"
ROWS_PER_CHUNK = 2_000_000


def input_bytes(df: DataFrame) -> int:
    """Summed size estimates of the tables a plan reads, as the broadcast rule sees them.

    Taken from the leaves because an estimate above a join multiplies its sides.
    A source of unknown size counts as huge. No job runs.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(name, str(default)))


def fits_one_task(df: DataFrame) -> bool:
    """True when even a group holding every row of ``df`` is a comfortable task."""
    return input_bytes(df) <= setting(df, ONE_TASK_BYTES_SETTING, ONE_TASK_BYTES)
