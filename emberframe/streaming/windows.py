"""Event-time windows, latest-sample views, side tables of late rows and judged pairs of sensor streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from emberframe.operators.settle import shared_folder
from emberframe.streaming.timed import timed_stream, use_rocksdb
from emberframe.streaming.watches import PairWatch


def tumbling(stream: DataFrame, keys: list[str], at: str, width: str, delay: str, aggregates: list[Column]) -> DataFrame:
    """Fixed bins; a bin closes when the watermark has passed it."""
    return stream.withWatermark(at, delay).groupBy(*keys, F.window(at, width)).agg(*aggregates)


def sliding(
    stream: DataFrame, keys: list[str], at: str, width: str, step: str, delay: str, aggregates: list[Column]
) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(*keys, F.window(at, width, step)).agg(*aggregates)


def sessions(stream: DataFrame, keys: list[str], at: str, gap: str, delay: str, aggregates: list[Column]) -> DataFrame:
    """Clusters of events separated by quiet gaps."""
    return stream.withWatermark(at, delay).groupBy(*keys, F.session_window(at, gap)).agg(*aggregates)


def latest(stream: DataFrame, keys: list[str], at: str, fields: list[str]) -> DataFrame:
    """Newest sample per key; older arrivals change nothing. Use update or complete mode."""
    return stream.groupBy(*keys).agg(
        F.max(at).alias(at), *[F.max_by(f, at).alias(f) for f in fields]
    )


def progress(stream: DataFrame, at: str, delay: str, status: str, every: str = "10 seconds") -> DataFrame:
    """Ticks per interval and status."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, every), status).agg(F.count(F.lit(1)).alias("ticks"))


def progress_report(counted: DataFrame, status: str) -> DataFrame:
    """Reports per interval of a finished run: ticks of the interval and so far, ticks so far per status.

    ``counted`` is what ``progress`` gave; its rows are intervals, not ticks, so the running sums are small.
    """
    so_far = Window.partitionBy(status).orderBy("window.start")
    overall = Window.orderBy("start")
    each = counted.withColumn("status_ticks", F.sum("ticks").over(so_far))
    totals = counted.groupBy(F.col("window.start").alias("start")).agg(F.sum("ticks").alias("interval_ticks"))
    totals = totals.withColumn("ticks_so_far", F.sum("interval_ticks").over(overall))
    return each.withColumn("start", F.col("window.start")).drop("window").join(totals, "start")


def keep_latest(updates: DataFrame, spark: SparkSession, keys: list[str], at: str, *, folder: str | None = None) -> DataFrame:
    """Run an update-mode stream to its end and read the newest state of each key.

    Each trigger's changed rows are written under its batch number, so a trigger that is run again after a
    failure replaces its own files. The newest ``at`` of a key wins.
    """
    folder = folder or shared_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    query = (
        updates.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    written = spark.read.schema(T.StructType([*updates.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/updates")
    newest = F.max_by(F.struct(*updates.columns), F.struct(at, "batch"))
    return written.groupBy(*keys).agg(newest.alias("_row")).select("_row.*")


class _Arrivals(StatefulProcessor):
    """Judge each row against the newest instant its key has shown before."""

    def __init__(self, columns: list[str], order: list[str], at: str, late_us: int):
        self.columns, self.order, self.at, self.late_us = columns, order, at, late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        newest = self.newest.get()[0] if self.newest.exists() else None
        named = Row(*self.columns, "arrival")
        for row in sorted(rows, key=lambda r: [r[c] for c in self.order]):
            at = row[self.at]
            if newest is None or at > newest:
                arrival, newest = "fresh", at
            elif at == newest:
                arrival = "pending"
            else:
                arrival = "late" if newest - at > self.late_us else "stale"
            yield named(*(row[c] for c in self.columns), arrival)
        if newest is not None:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


def arrivals(stream: DataFrame, keys: list[str], at: str, order: list[str], late_us: int) -> DataFrame:
    """The stream with ``arrival``: fresh, pending (the newest instant again), stale (older), late (older by over ``late_us``).

    ``at`` is in microseconds and not null; rows of one trigger are taken in ``order``, that of their arrival.
    Nothing is dropped, as it would be by a watermark; one number is kept per key.
    """
    use_rocksdb(stream.sparkSession)
    schema = T.StructType([*stream.schema.fields, T.StructField("arrival", T.StringType())])
    run = _Arrivals(stream.columns, order, at, late_us)
    return stream.groupBy(*keys).transformWithState(run, schema, "append", "None")


def with_side_table(judged: DataFrame, spark: SparkSession, *, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run a stream of ``arrivals`` to its end: the table of rows in time and the side table of late ones."""
    folder = folder or shared_folder(spark)
    query = (
        judged.withColumn("side", F.when(F.col("arrival") == "late", "late").otherwise("main"))
        .writeStream.format("parquet").partitionBy("side").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*judged.schema.fields, T.StructField("side", T.StringType())])).parquet(f"{folder}/rows")
    return rows.where("side = 'main'").drop("side"), rows.where("side = 'late'").drop("side")


def judged_pairs(
    camera: DataFrame, thermal: DataFrame, keys: list[str], camera_at: str, thermal_at: str, watch: PairWatch, *, reach: str,
    delay: str = "0 seconds",
) -> DataFrame:
    """Camera frames with the latest thermal sample at most ``reach`` before, judged by ``watch`` in camera order.

    Both streams have a watermark of ``delay`` behind their newest instant, so the join drops a sample once no
    frame can need it. Frames without a sample come through the outer join once the watermark has passed them.
    Frames are judged when the join's own watermark, ``reach`` behind both streams', has passed them.
    """
    a = camera.withWatermark(camera_at, delay).alias("a")
    b = thermal.withWatermark(thermal_at, delay).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = (F.col(thermal_at) <= F.col(camera_at)) & (F.col(thermal_at) >= F.col(camera_at) - F.expr(f"INTERVAL {reach}"))
    for s in same:
        near = near & s
    own = [F.col(f"a.{c}").alias(c) for c in camera.columns]
    theirs = [F.col(f"b.{c}").alias(c) for c in thermal.columns if c not in (*keys, thermal_at)]
    joined = a.join(b, near, "left_outer").select(*own, *theirs, F.unix_micros(thermal_at).alias("thermal_us"))
    return timed_stream(joined, keys, camera_at, watch, order=("color_frame", "thermal_us", "frame_counter"), delay=None)


def paired_streams(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, *,
    delay: str, reach: str,
) -> DataFrame:
    """Join two streams on key and nearness in time; both sides are bounded by watermarks."""
    a = left.withWatermark(left_at, delay).alias("a")
    b = right.withWatermark(right_at, delay).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = (F.col(right_at) >= F.col(left_at) - F.expr(f"INTERVAL {reach}")) & (
        F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {reach}")
    )
    condition = near
    for s in same:
        condition = condition & s
    return a.join(b, condition).drop(*[F.col(f"b.{k}") for k in keys])


def soak_verdict(log: DataFrame, keys: list[str], order: list[str], *, min_cycles: int, violations: Column | None = None) -> DataFrame:
    """Verdict of a finished soak log: terminal reason first, then violations, latch, cycles."""
    at = F.struct(*order)
    terminal = F.min_by("terminal_reason", F.when(F.col("terminal_reason").isNotNull(), at))
    broken = violations if violations is not None else F.lit(False)
    ended = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ticks"), F.max("cycles").alias("cycles"), terminal.alias("_end"),
        F.max_by("fault_latched", at).alias("_latched"), F.count(F.when(broken, 1)).alias("fault_closure_violations"),
    )
    reason = (
        F.when(F.col("_end").isNotNull(), F.col("_end"))
        .when(F.col("fault_closure_violations") > 0, "fault_closure_violation")
        .when(F.col("_latched"), "pressure_fault_latched")
        .when(F.col("cycles") < min_cycles, "insufficient_cycles")
        .otherwise("completed")
    )
    return ended.withColumn("reason", reason).drop("_end", "_latched")
