"""Recorded datagram feeds as a stream: capture files of fixed-size records that may grow while they are read.

A capture file holds one stream's datagrams. Each record is time (microseconds), sequence number and length,
little-endian, and the payload padded to the largest datagram, so any whole number of records is a valid
offset: a trigger takes the records that are complete by then, and a restart goes on after the last one taken.

Files that this format writes are packed: the same records in compressed blocks of a fixed number, then the place
of each block. They are whole when they get their name, ``stream~part+records.packed.cap``, so offsets are the same.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

from emberframe.sources.frames import FOOTER_PACKETS, PACKET_BYTES

#: Name of the format, ending of its files.
FORMAT, ENDING, PACKED = "capture", ".cap", ".packed.cap"
HEADER = struct.Struct("<qII")
LONGEST = FOOTER_PACKETS * PACKET_BYTES
RECORD = HEADER.size + LONGEST
#: Records that a task reads, of one file or of many short ones.
PER_TASK = 4096
#: Files that a writing task holds open.
OPEN_FILES = 64
#: Records of a packed file's block.
BLOCK = 32
_PLACE = struct.Struct("<q")
_CODEC = pa.Codec("zstd")
SCHEMA = "stream string, ts timestamp, seq long, payload binary"
_ARROW = pa.schema([("stream", pa.string()), ("ts", pa.timestamp("us", tz="UTC")), ("seq", pa.int64()), ("payload", pa.binary())])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def _records(path: str) -> dict[str, int]:
    """Complete records of each capture file by now."""
    store, folder = _opened(path)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    whole = {f.base_name: f.size // RECORD for f in found if f.is_file and f.base_name.endswith(ENDING)}
    return whole | {name: _packed_records(name) for name in whole if name.endswith(PACKED)}


def _packed_records(name: str) -> int | None:
    """Records that a packed file's name tells; None for one that is not packed."""
    return int(name.removesuffix(PACKED).rpartition("+")[2]) if name.endswith(PACKED) else None


def stream_of(name: str) -> str:
    """Stream id in a file's name, which is ``stream~part.cap``."""
    return name.rpartition("~")[0]


@dataclass
class Spans(InputPartition):
    """Records ``first`` to ``end`` of each named file, at most PER_TASK in all."""

    parts: list[tuple[str, int, int]]


def _spans(first: dict[str, int], end: dict[str, int]) -> list[Spans]:
    """Long files are cut, short ones put together: the number of tasks follows the records, not the files."""
    out, room = [], 0
    for name, n in sorted(end.items()):
        at = first.get(name, 0)
        while at < n:
            if not room:
                out.append(Spans([]))
                room = PER_TASK
            to = min(n, at + room)
            out[-1].parts.append((name, at, to))
            room -= to - at
            at = to
    return out


def _chunks(file: pa.NativeFile, name: str, first: int, end: int) -> Iterator[bytes]:
    """The records ``first`` to ``end`` in chunks of whole records."""
    records = _packed_records(name)
    if records is None:
        for at in range(first, end, 256):
            yield file.read_at((min(at + 256, end) - at) * RECORD, at * RECORD)
        return
    index = file.size() - _PLACE.size * (-(-records // BLOCK) + 1)
    for block in range(first // BLOCK, -(-end // BLOCK)):
        begin, stop = (p for (p,) in _PLACE.iter_unpack(file.read_at(2 * _PLACE.size, index + block * _PLACE.size)))
        at = block * BLOCK
        data = _CODEC.decompress(file.read_at(stop - begin, begin), (min(at + BLOCK, records) - at) * RECORD, asbytes=True)
        yield data[max(first - at, 0) * RECORD : (end - at) * RECORD]


def _read(path: str, spans: Spans) -> Iterator[pa.RecordBatch]:
    store, folder = _opened(path)
    for name, first, end in spans.parts:
        with store.open_input_file(f"{folder}/{name}") as file:
            for data in _chunks(file, name, first, end):
                heads = [HEADER.unpack_from(data, k) for k in range(0, len(data), RECORD)]
                bodies = [data[k * RECORD + HEADER.size : k * RECORD + HEADER.size + h[2]] for k, h in enumerate(heads)]
                columns = [[stream_of(name)] * len(heads), [h[0] for h in heads], [h[1] for h in heads], bodies]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


class _Packed:
    """A packed file that is being written."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.records, self.held, self.places = file, 0, [], [0]

    def add(self, record: bytes) -> None:
        self.held.append(record)
        self.records += 1
        if len(self.held) == BLOCK:
            self._pass_on()

    def _pass_on(self) -> None:
        data = _CODEC.compress(b"".join(self.held), asbytes=True)
        self.file.write(data)
        self.places.append(self.places[-1] + len(data))
        self.held.clear()

    def close(self) -> None:
        if self.held:
            self._pass_on()
        self.file.write(b"".join(_PLACE.pack(p) for p in self.places))
        self.file.close()


class _Stream(DataSourceStreamReader):
    """Offsets are the records taken of each file."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _records(self.path)

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        return _spans(start, end)

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Spans]:
        return _spans({}, _records(self.path)) or [Spans([])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


@dataclass
class Written(WriterCommitMessage):
    names: tuple[tuple[str, int], ...]


class _Writer(DataSourceArrowWriter):
    """Each task writes its own files under another ending; they get theirs when all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _opened(self.path)
        store.create_dir(folder, recursive=True)
        task, files, names = uuid.uuid4().hex, {}, []
        done: dict[str, int] = {}

        def end(stream: str) -> None:
            name, file = files.pop(stream)
            file.close()
            done[name] = file.records

        try:
            for batch in iterator:
                ats = batch.column("ts").cast(pa.int64())
                for stream, at, seq, payload in zip(*(c.to_pylist() for c in (batch.column("stream"), ats, batch.column("seq"), batch.column("payload")))):
                    if len(payload) > LONGEST:
                        raise ValueError(f"datagram {seq} of {stream} is longer than a record")
                    if stream not in files:
                        if len(files) == OPEN_FILES:
                            end(next(iter(files)))  # a stream that comes again has another file
                        names.append(f"{stream}~{task}-{len(names)}")
                        files[stream] = names[-1], _Packed(store.open_output_stream(f"{folder}/{names[-1]}.part"))
                    files[stream][1].add(HEADER.pack(at, seq, len(payload)) + payload.ljust(LONGEST, b"\0"))
        finally:
            for stream in list(files):
                end(stream)
        return Written(tuple((name, done[name]) for name in names))

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _opened(self.path)
        for name, records in (n for m in messages if m for n in m.names):
            store.move(f"{folder}/{name}.part", f"{folder}/{name}+{records}{PACKED}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _opened(self.path)
        for name, _ in (n for m in messages if m for n in m.names):
            store.delete_file(f"{folder}/{name}.part")


class CaptureFeed(DataSource):
    """``spark.readStream.format("capture").load(folder)``, also as a batch and for writing.

    The folder is one that driver and tasks share, by any address that pyarrow's file systems open.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"])

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session.

    Runs that end by themselves then go on, as with other sources, until the last watermark has been acted on.
    """
    spark.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", "true")
    spark.dataSource.register(CaptureFeed)
