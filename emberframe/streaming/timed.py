"""State machines with time-outs, run in event-time order on streams and on recorded tables.

A stream's rows wait in the state store until the watermark has passed them and are then taken in time
order, with the machine's own time-outs in between. So the outcome follows from the rows and the final
watermark alone, not from how rows fell into triggers, and ``replay_timed`` gives the same rows for a
recorded table. A source that goes quiet is noticed by its timer, without another row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

AT = "at_us"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TimedMachine:
    """``state`` and ``output`` are DDL; times are whole microseconds.

    ``due`` names the next time-out, which fires before a row of the same instant. ``on_time`` and ``on_row``
    return the new state and the rows to put out, without key and time.
    """

    state: str
    output: str

    def initial(self) -> dict:
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        return None

    def on_time(self, state: dict, at: int) -> tuple[dict, list[tuple]]:
        raise NotImplementedError

    def on_row(self, state: dict, at: int, row: dict) -> tuple[dict, list[tuple]]:
        raise NotImplementedError


class Walk:
    """One key's run: rows and time-outs in time order; after ``idle_us`` without a row the state is gone."""

    def __init__(self, machine: TimedMachine, idle_us: int | None, state: dict | None = None, last: int | None = None):
        self.machine, self.idle_us, self.state, self.last = machine, idle_us, state, last

    def next_due(self) -> int | None:
        if self.state is None:
            return None
        times = [t for t in (self.machine.due(self.state), self._end()) if t is not None]
        return min(times, default=None)

    def _end(self) -> int | None:
        return None if self.idle_us is None or self.last is None else self.last + self.idle_us + 1

    def until(self, limit: int) -> Iterator[tuple]:
        """Fire what is due up to and including ``limit``."""
        while (at := self.next_due()) is not None and at <= limit:
            due = self.machine.due(self.state)
            if due is not None and due <= at:
                self.state, out = self.machine.on_time(self.state, at)
                for values in out:
                    yield (at, *values)
            else:
                self.state = None

    def take(self, at: int, row: dict) -> Iterator[tuple]:
        yield from self.until(at)
        if self.state is None:
            self.state = self.machine.initial()
        self.state, out = self.machine.on_row(self.state, at, row)
        self.last = at
        for values in out:
            yield (at, *values)


def use_rocksdb(spark: SparkSession) -> None:
    """Typed state and timers need the RocksDB state store; a session that has another is told so here."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _timers(handle: StatefulProcessorHandle) -> list[int]:
    return [t[0] if isinstance(t, (tuple, list)) else t for t in handle.listTimers()]


class _Ordered(StatefulProcessor):
    """Rows wait until the watermark has passed them; one timer a key stands for its next row or time-out."""

    def __init__(self, machine: TimedMachine, output: T.StructType, order: list[str], fields: T.StructType, idle_us: int | None):
        self.machine, self.output, self.order, self.fields, self.idle_us = machine, output.names, order, fields, idle_us
        own = T.StructType.fromDDL(machine.state)
        self.names = own.names
        self.kept_type = T.StructType([T.StructField("last_us", T.LongType()), *own.fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.kept_type)
        # what arrived in one trigger is one element: each costs a round trip of its own
        self.waiting = handle.getListState("arrived", T.StructType([T.StructField("rows", T.ArrayType(self.fields))]))

    def handleInputRows(self, key, rows, timerValues):
        arrived = self._plain(rows)
        if arrived:
            self.waiting.appendValue((arrived,))
            self._wake(min(row[0] for row in arrived))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        last, state = None, None
        if (kept := self.kept.get()) is not None:
            last, *values = kept
            state = dict(zip(self.names, values))
        walk = Walk(self.machine, self.idle_us, state, last)
        rows = [row for (arrived,) in self.waiting.get() for row in arrived]
        ready = [dict(zip(self.fields.names, r)) for r in rows if r[0] <= limit]
        rest = [tuple(r) for r in rows if r[0] > limit]
        out = []
        for row in sorted(ready, key=lambda r: [r[c] for c in self.order]):
            out.extend(walk.take(row[AT], row))
        out.extend(walk.until(limit))
        if ready:
            self.waiting.put([(rest,)]) if rest else self.waiting.clear()
        if walk.state is not None:
            self.kept.update((walk.last, *(walk.state[n] for n in self.names)))
        elif kept is not None:
            self.kept.clear()
        times = [t for t in (walk.next_due(), min((r[0] for r in rest), default=None)) if t is not None]
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))  # the one that has fired was the only one
        named = Row(*self.output)
        return iter([named(*key, *values) for values in out])

    def _plain(self, rows: Iterator[Row]) -> list[tuple]:
        """The rows' own fields as tuples; a Row looks each name up among all."""
        own, out = None, []
        for row in rows:
            if own is None:
                names = row.__fields__
                own = [names.index(n) for n in self.fields.names]
            values = tuple(row)
            out.append(tuple([values[i] for i in own]))
        return out

    def _wake(self, at_us: int) -> None:
        """Keep the earliest timer only; the watermark has passed ``at_us`` from that millisecond on."""
        at = -(-at_us // 1000)
        known = _timers(self.handle)
        if not known or at < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class _Live(StatefulProcessor):
    """Rows count from the moment they arrive; timers follow the wall clock and idle state expires by itself."""

    def __init__(self, machine: TimedMachine, output: T.StructType, order: list[str], ttl_ms: int | None):
        self.machine, self.output, self.order, self.ttl_ms = machine, output.names, order, ttl_ms
        self.kept_type = T.StructType.fromDDL(machine.state)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.kept_type, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        arrived = sorted((row.asDict() for row in rows), key=lambda r: [r[c] for c in self.order])
        return self._go(key, now, arrived)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._go(key, timerValues.getCurrentProcessingTimeInMs() * 1000, [])

    def _go(self, key, now, arrived):
        state = dict(zip(self.kept_type.names, self.kept.get())) if self.kept.exists() else None
        walk = Walk(self.machine, None, state)
        out = []
        for row in arrived:
            out.extend(walk.take(now, row))
        out.extend(walk.until(now))
        if walk.state is not None:
            self.kept.update(tuple(walk.state[n] for n in self.kept_type.names))
            for t in _timers(self.handle):
                self.handle.deleteTimer(t)
            due = walk.next_due()
            if due is not None:
                self.handle.registerTimer(-(-due // 1000))
        named = Row(*self.output)
        return iter([named(*key, *values) for values in out])

    def close(self) -> None:
        pass


def _output(df: DataFrame, keys: list[str], machine: TimedMachine) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), T.StructField(AT, T.LongType()), *T.StructType.fromDDL(machine.output).fields])


def timed_stream(
    stream: DataFrame, keys: list[str], at: str, machine: TimedMachine, *, order: tuple[str, ...] = (), delay: str | None = "0 seconds", idle_us: int | None = None
) -> DataFrame:
    """What the machine puts out on a stream: keys, at_us and its columns, once the watermark has passed.

    ``at`` is the event-time column; rows later than ``delay`` are dropped by the watermark. With a ``delay`` of
    None the stream has its watermark already, as after a join. Rows of one instant are taken by ``order``, else
    as they are. A key's state lives until ``idle_us`` after its last row.
    """
    columns = [c for c in stream.columns if c not in (*keys, at)]
    use_rocksdb(stream.sparkSession)
    clock = stream if delay is None else stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    placed = clock.withColumn(AT, F.unix_micros(at))
    fields = T.StructType([T.StructField(AT, T.LongType()), *(stream.schema[c] for c in columns)])
    output = _output(stream, keys, machine)
    run = _Ordered(machine, output, [AT, *order], fields, idle_us)
    return placed.groupBy(*keys).transformWithState(run, output, "append", "EventTime")


def live_stream(stream: DataFrame, keys: list[str], machine: TimedMachine, *, order: tuple[str, ...] = (), ttl_ms: int | None = None) -> DataFrame:
    """The same machine by the wall clock: a silent source is reported while the query runs, with no event of any key.

    at_us is the time of the trigger that took the row or fired the timer. Rows of one trigger are taken by
    ``order``. State that nothing has touched for ``ttl_ms`` is dropped by the state store.
    """
    use_rocksdb(stream.sparkSession)
    output = _output(stream, keys, machine)
    run = _Live(machine, output, list(order), ttl_ms)
    return stream.groupBy(*keys).transformWithState(run, output, "append", "ProcessingTime")


def final_watermark(df: DataFrame, at: str, delay_us: int = 0) -> int:
    """Where the watermark stands once all rows of a recorded stream were read, in microseconds."""
    newest = df.agg(F.max(F.unix_micros(F.col(at).cast("timestamp")))).first()[0]
    return 0 if newest is None else newest // 1000 * 1000 - delay_us


def replay_timed(
    df: DataFrame, keys: list[str], at: str, machine: TimedMachine, until_us: int, *, order: tuple[str, ...] = (), idle_us: int | None = None
) -> DataFrame:
    """The same rows for a recorded table, up to ``until_us``.

    Rows are sorted by key and time and walked in Arrow batches with one state in hand, so no key is held whole.
    """
    columns = [c for c in df.columns if c not in (*keys, at)]
    schema = _output(df, keys, machine)
    arrow = to_arrow_schema(schema)
    names = [*keys, AT, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, walk, out = None, None, []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, values))
                key = values[: len(keys)]
                if walk is None or key != own:
                    if walk is not None:
                        out.extend((*own, *x) for x in walk.until(until_us))
                    own, walk = key, Walk(machine, idle_us)
                out.extend((*key, *x) for x in walk.take(row[AT], row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), arrow.types)], schema=arrow)
                out = []
        if walk is not None:
            out.extend((*own, *x) for x in walk.until(until_us))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), arrow.types)], schema=arrow)

    placed = df.withColumn(AT, F.unix_micros(F.col(at).cast("timestamp"))).where(F.col(AT) <= until_us)
    sorted_rows = placed.select(*names).repartition(*keys).sortWithinPartitions(*keys, AT, *order)
    return sorted_rows.mapInArrow(run, schema)
