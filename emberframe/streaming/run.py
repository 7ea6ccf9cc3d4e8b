"""Run state machines on streams, and replay them on recorded tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberframe.operators.settle import shared_folder
from emberframe.streaming.machines import Machine

_STATE = T.StructType([T.StructField("state", T.StringType())])


def _plain(value):
    """Arrow values as plain Python, missing numbers as None."""
    if hasattr(value, "tolist"):
        return value.tolist()
    if isinstance(value, float) and value != value:
        return None
    return value


def _walk(machine: Machine, state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    names = list(rows.columns)
    added = []
    for values in rows.itertuples(index=False, name=None):
        row = {n: _plain(None if v is pd.NA or v is pd.NaT else v) for n, v in zip(names, values)}
        state, out = machine.step(state, row)
        added.append(out)
    result = rows.copy()
    for i, (name, kind) in enumerate(machine.output):
        column = [o[i] for o in added]
        dtype = "Int64" if isinstance(kind, T.LongType) else "float64" if isinstance(kind, T.DoubleType) else object
        result[name] = pd.Series(column, index=rows.index, dtype=dtype)
    return state, result


def output_schema(df: DataFrame, machine: Machine) -> T.StructType:
    added = [T.StructField(name, kind) for name, kind in machine.output]
    return T.StructType([*df.schema.fields, *added])


def stateful(stream: DataFrame, keys: list[str], order: list[str], machine: Machine) -> DataFrame:
    """The stream with the machine's columns; state lives in the state store per key.

    Rows of one trigger are taken in ``order``; a row that arrives in a later
    trigger is judged against the state as it then is, which is what the machines'
    own staleness rules are for.
    """

    def update(key: tuple[Any, ...], batches: Iterable[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = pd.concat(parts).sort_values(order, kind="stable").reset_index(drop=True)
        state = json.loads(group.get[0]) if group.exists else machine.initial()
        state, result = _walk(machine, state, rows)
        group.update((json.dumps(state),))
        yield result

    return stream.groupBy(*keys).applyInPandasWithState(
        update, output_schema(stream, machine), _STATE, "append", GroupStateTimeout.NoTimeout
    )


def replay(df: DataFrame, keys: list[str], order: list[str], machine: Machine) -> DataFrame:
    """The same columns for a recorded table.

    Rows are sorted by key and time and walked in Arrow batches with one state in
    hand, so no key is ever held whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, machine.initial()
        for batch in batches:
            same = batch[keys].ne(batch[keys].shift()).any(axis=1).cumsum()
            done = []
            for _, rows in batch.groupby(same, sort=False):
                key = tuple(_plain(v) for v in rows[keys].iloc[0])
                if key != current:
                    current, state = key, machine.initial()
                state, result = _walk(machine, state, rows)
                done.append(result)
            if done:
                yield pd.concat(done)

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, output_schema(df, machine))


def run_available(stream: DataFrame, spark: SparkSession, *, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process what is there now into files of the shared folder and read them back.

    With the ``folder`` of an earlier run the stream goes on where that one stopped.
    """
    folder = folder or shared_folder(spark)
    running = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def open_table(spark: SparkSession, path: str, *, files_per_trigger: int = 8) -> DataFrame:
    """The parquet files ``folder/name`` (name may be a glob) as a stream."""
    folder, name = path.rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder)


def timed(stream: DataFrame, seconds: str, name: str = "event_time") -> DataFrame:
    """Seconds as an event-time column for watermarks."""
    return stream.withColumn(name, F.timestamp_micros((F.col(seconds) * 1_000_000).cast("long")))
