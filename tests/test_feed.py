"""Recorded datagram feeds: growing files, restarts, broken records."""

import os

import pytest
from pyspark.sql import functions as F

from emberframe.sources import feed, frames
from emberframe.streaming import run, timed, watches


def datagram(segment, packets=60, mark=0):
    heads = [bytes([(segment << 4 if i == 20 else 0) | i >> 8, i & 255, 0, 0]) for i in range(packets)]
    return b"".join(h + bytes([mark]) * (frames.PACKET_BYTES - 4) for h in heads)


def record(seq, payload):
    return feed.HEADER.pack((seq + 1) * 1_000_000, seq, len(payload)) + payload.ljust(feed.LONGEST, b"\0")


def append(path, data):
    with open(path, "ab") as file:
        file.write(data)


def test_a_growing_feed_is_read_once_over_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "PER_TASK", 3)
    feed.register(spark)
    folder, own = tmp_path / "feed", str(tmp_path / "run")
    folder.mkdir()
    records = [record(i, datagram(i % 4 + 1, mark=i % 251)) for i in range(20)]
    whole = b"".join(records)
    # each run finds more bytes; the cuts are inside records
    cuts = [0, 3 * feed.RECORD + 17, 11 * feed.RECORD - 1, 20 * feed.RECORD]
    for a, b in zip(cuts, cuts[1:]):
        append(folder / "cam~1.cap", whole[a:b])
        append(folder / "other~1.cap", whole[a:b])
        append(folder / "cam~2.part", b"not finished")
        rows = run.run_available(spark.readStream.format("capture").load(str(folder)), spark, folder=own)
        assert rows.count() == 2 * (b // feed.RECORD)
    got = sorted((r.stream, r.seq, bytes(r.payload)) for r in rows.collect())
    assert got == [(s, i, datagram(i % 4 + 1, mark=i % 251)) for s in ("cam", "other") for i in range(20)]


def test_frames_span_restarts(spark, tmp_path):
    feed.register(spark)
    folder, own = tmp_path / "feed", str(tmp_path / "run")
    folder.mkdir()
    parts = [datagram(1), datagram(2), datagram(3), datagram(4), datagram(1), datagram(3), b"short", datagram(1, 61), datagram(2, 61), datagram(3, 61), datagram(4, 61), datagram(4)]
    for a, b in ((0, 2), (2, 9), (9, 12)):
        append(folder / "cam~1.cap", b"".join(record(i, p) for i, p in enumerate(parts) if a <= i < b))
        read = frames.datagrams(spark.readStream.format("capture").load(str(folder)))
        out = run.run_available(timed.timed_stream(read, ["stream"], "ts", watches.FrameAssembly(), order=("seq",)), spark, folder=own)
    got = sorted((r.first_seq, r.last_seq, r.packets, bytes(r.payload)) for r in out.collect())
    assert got == [(0, 3, 60, b"".join(parts[:4])), (7, 10, 61, b"".join(parts[7:11]))]


def test_written_feeds_read_back_as_a_table(spark, tmp_path):
    feed.register(spark)
    rows = [(s, i, i, bytes([i] * (i + 1))) for s in ("a~b", "c") for i in range(9)]
    df = spark.createDataFrame(rows, "stream string, at long, seq long, payload binary")
    df = df.select("stream", F.timestamp_seconds("at").alias("ts"), "seq", "payload")
    df.write.format("capture").mode("append").save(str(tmp_path / "feed"))
    back = spark.read.format("capture").load(str(tmp_path / "feed"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert all(name.endswith(".cap") for name in os.listdir(tmp_path / "feed"))
    assert spark.read.format("capture").load(str(tmp_path / "nothing")).count() == 0


def test_a_datagram_too_long_is_refused(spark, tmp_path):
    feed.register(spark)
    df = spark.createDataFrame([("a", 0, b"x" * (feed.LONGEST + 1))], "stream string, seq long, payload binary")
    with pytest.raises(Exception, match="longer than a record"):
        df.select("stream", F.timestamp_seconds(F.lit(0)).alias("ts"), "seq", "payload").write.format("capture").mode("append").save(str(tmp_path))


def test_short_files_share_tasks():
    files = {f"s{i}~1.cap": 3 for i in range(10000)} | {"long~1.cap": 3 * feed.PER_TASK}
    spans = feed._spans({"s0~1.cap": 2}, files)
    assert len(spans) == -(-(10000 * 3 - 2 + 3 * feed.PER_TASK) // feed.PER_TASK)
    taken = sorted((name, k) for s in spans for name, a, b in s.parts for k in range(a, b))
    assert taken == sorted((name, k) for name, n in files.items() for k in range(2 if name == "s0~1.cap" else 0, n))


def test_more_streams_than_open_files(spark, tmp_path):
    feed.register(spark)
    rows = [(f"s{i}", 100 * k + i, k, bytes([i])) for k in range(3) for i in range(feed.OPEN_FILES + 6)]
    df = spark.createDataFrame(rows, "stream string, at long, seq long, payload binary").coalesce(1)
    df = df.select("stream", F.timestamp_seconds("at").alias("ts"), "seq", "payload")
    df.write.format("capture").mode("append").save(str(tmp_path / "feed"))
    back = spark.read.format("capture").load(str(tmp_path / "feed"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_written_feeds_take_less_room_than_their_records(spark, tmp_path):
    feed.register(spark)
    n, folder = 3 * feed.BLOCK + 5, tmp_path / "feed"
    rows = [("cam", i, i, datagram(i % 4 + 1, 60 + i % 2, mark=i % 251)) for i in range(n)]
    df = spark.createDataFrame(rows, "stream string, at long, seq long, payload binary").coalesce(1)
    df = df.select("stream", F.timestamp_seconds("at").alias("ts"), "seq", "payload")
    df.write.format("capture").mode("append").save(str(folder))
    assert sum(f.stat().st_size for f in folder.iterdir()) < n * feed.RECORD / 20
    back = spark.read.format("capture").load(str(folder))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_any_span_of_a_packed_file_is_read(spark, tmp_path, monkeypatch):
    """Spans begin and end inside blocks; packed files and growing ones lie side by side, over restarts."""
    monkeypatch.setattr(feed, "PER_TASK", 7)
    feed.register(spark)
    folder, own = tmp_path / "feed", str(tmp_path / "run")
    folder.mkdir()
    append(folder / "old+3.cap~1.cap", record(0, b"a") + record(1, b"b"))
    counts = (feed.BLOCK, 2 * feed.BLOCK + 1)
    for k, n in enumerate(counts):
        df = spark.range(n).coalesce(1).selectExpr("'s' AS stream", f"timestamp_seconds(id + {1000 * k}) AS ts", "id AS seq", "CAST(repeat('x', CAST(id AS INT)) AS BINARY) AS payload")
        df.write.format("capture").mode("append").save(str(folder))
        rows = run.run_available(spark.readStream.format("capture").load(str(folder)), spark, folder=own)
        assert rows.count() == 2 + sum(counts[: k + 1])
    got = sorted((r.stream, r.seq, bytes(r.payload)) for r in rows.collect())
    assert got == sorted([("old+3.cap", 0, b"a"), ("old+3.cap", 1, b"b")] + [("s", i, b"x" * i) for n in counts for i in range(n)])
