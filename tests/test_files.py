"""Files written by the tests themselves, read back through the sources and sinks."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe import schema as layouts
from emberframe.operators.ordered import Series
from emberframe.sinks import writers
from emberframe.sources import frames, trials


def png(image, colour):
    depth = 16 if image.dtype == np.uint16 else 8
    height, width = image.shape[:2]
    raw = image.astype(">u2" if depth == 16 else "u1").tobytes()
    step = len(raw) // height
    size = step // width
    lines, above = b"", bytes(step)
    for y in range(height):
        line = raw[y * step : (y + 1) * step]
        kind = y % 5
        coded = bytearray()
        for i, v in enumerate(line):
            left, up, corner = (line[i - size] if i >= size else 0), above[i], (above[i - size] if i >= size else 0)
            p = left + up - corner
            paeth = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
            coded.append((v - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        lines += bytes([kind]) + bytes(coded)
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_all_filters(spark, tmp_path):
    rng = np.random.default_rng(0)
    thermal = rng.integers(0, 65536, (120, 160)).astype(np.uint16)
    color = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    (tmp_path / "frame_000001.png").write_bytes(png(thermal, 0))
    (tmp_path / "frame_000002.png").write_bytes(png(color, 2))
    (tmp_path / "frame_000003.png").write_bytes(b"not a png at all, sorry")
    got = {r["frame"]: r for r in frames.png_frames(spark, f"{tmp_path}/*.png", thermal=True).collect()}
    assert got[1]["pixels"] == thermal.ravel().tolist() and got[1]["issue"] is None
    assert got[2]["pixels"] == color.ravel().tolist() and got[2]["issue"] == "not_a_thermal_frame"
    assert got[3]["pixels"] is None and got[3]["issue"].startswith("unreadable")


def test_raw_frames(spark, tmp_path):
    values = np.arange(12, dtype="<u2") + 60000
    for i, payload in enumerate((values.tobytes(), values.tobytes()[:-2])):
        (tmp_path / f"raw_{i}.bin").write_bytes(payload)
        side = {"frame_index": i, "monotonic_timestamp_ns": 10 + i, "width": 4, "height": 3, "dtype": "uint16", "byte_order": "little",
                "raw_file": f"raw_{i}.bin", "ffc_state": "normal", "repeated_frame_flag": False, "display_mapping": {"mode": "fixed_raw_counts", "raw_low": 1, "raw_high": 9}}
        (tmp_path / f"raw_frame_{i}.json").write_text(json.dumps(side, indent=1))
    got = {r["frame"]: r for r in frames.raw_frames(spark, str(tmp_path)).collect()}
    assert got[0]["pixels"] == values.tolist() and got[0]["raw_high"] == 9
    assert got[1]["pixels"] == [] and got[1]["issue"] == "size_mismatch"


def segment_bytes(number, packets, words):
    out = b""
    for i in range(packets):
        head = bytearray(struct.pack(">HH", i, 0))
        if i == 20:
            head[0] |= number << 4
        out += bytes(head) + words[i].astype(">u2").tobytes()
    return out


def test_packets(spark, stored):
    rng = np.random.default_rng(1)
    image = rng.integers(1, 60000, (120, 160))
    half = np.stack([image[:, :80], image[:, 80:]], axis=1).reshape(240, 80)
    footer = np.zeros((4, 80), dtype=int)
    footer[0, 1], footer[0, 3], footer[0, 20], footer[0, 30] = 5000, (3 << 4) | 8, 77, 2000
    footer[2, 48], footer[2, 49] = 1, 1
    words = np.concatenate([half, footer])
    parts = [segment_bytes(n + 1, 61, words[61 * n : 61 * n + 61]) for n in range(4)]
    rows = [(0, i, p) for i, p in enumerate([parts[1], *parts, parts[0], parts[1], parts[3], parts[0][:-1]])]
    df = frames.datagrams(stored(rows, "stream int, seq int, payload binary"))
    assert [r["segment"] for r in df.orderBy("seq").collect()] == [2, 1, 2, 3, 4, 1, 2, 4, None]
    whole = frames.assembled_frames(df, Series(("stream",), ("seq",)), rows_per_chunk=3)
    out = whole.select("seq", frames.packet_pixels("payload").alias("pixels"), frames.packet_telemetry("payload").alias("t")).collect()
    assert [r["seq"] for r in out] == [4]
    assert out[0]["pixels"] == image.ravel().tolist()
    t = out[0]["t"]
    assert (t["frame_counter"], t["ffc_desired"], t["ffc_state"], t["ffc_in_progress"]) == (77, True, "complete", False)
    assert t["since_last_ffc_s"] == 3.0 and t["tlinear_enabled"] and t["tlinear_resolution_k"] == 0.01


def test_trials_and_sessions(spark, tmp_path):
    for name, load in (("a_rep01", "1.5"), ("b_rep02", "bad")):
        folder = tmp_path / "trials" / name
        folder.mkdir(parents=True)
        (folder / "ir_features.csv").write_text("frame,area_px,mean_delta,max_delta\nf1.png,%s,2,nan\n" % load)
    rows = trials.typed(trials.scan_trials(spark, str(tmp_path), "ir_features.csv", layouts.FEATURES), ["area_px", "max_delta"])
    assert sorted((r["trial"], r["area_px"], r["max_delta"]) for r in rows.collect() if r["area_px"]) == [("a_rep01", 1.5, None)]
    assert rows.count() == 2
    (tmp_path / "s.jsonl").write_text('{"row_type": "frame", "block_index": 1, "tracking_valid": true}\n\n{"row_type": "frame", "tracking_valid": 1}\nnonsense\n[1]\n')
    log = trials.session_log(spark, str(tmp_path / "s.jsonl"), layouts.FINGER_SESSION)
    assert sorted(r["tracking_valid"] for r in log.filter("row_type = 'frame'").collect()) == ["1", "true"]
    assert trials.malformed(log).count() == 2
    with pytest.raises(Exception, match="invalid session line"):
        trials.strict(log).collect()


def test_sample_layouts(spark, tmp_path):
    (tmp_path / "old.csv").write_text("oak_x,oak_y,oak_z,ir_x,ir_y\n1,2,3,4,5\n")
    (tmp_path / "new.csv").write_text("oak_x,oak_y,oak_z,ir_x,ir_y,oak_observed_at_s,thermal_observed_at_s,sensor_skew_s\n1,2,3,4,5,6,7,1\n")
    rows = trials.calibration_samples(spark, str(tmp_path / "old.csv"), str(tmp_path / "new.csv"))
    assert sorted((r["ir_y"], r["sensor_skew_s"]) for r in rows.collect() if r["sensor_skew_s"]) == [(5.0, 1.0)]
    assert rows.count() == 2


def test_geometry_gate(spark, tmp_path):
    text = "<opencv_storage>%s<direction>thermal_to_color</direction><unit>m</unit></opencv_storage>" % "".join(
        f"<{n}><data>{v}</data></{n}>" for n, v in (("R", "1 0 0 0 1 0 0 0 -1"), ("T", "0 0 1"), ("thermal_K", "1 0 0 0 1 0 0 0 1"), ("thermal_D", "0 0 0 0 0"))
    )
    path = tmp_path / "g.xml"
    path.write_text(text)
    held = frames.frozen_files(spark, str(path), hashlib.sha256(text.encode()).hexdigest())
    assert frames.geometry_issues(held, "thermal_to_color", "m").first()["issues"] == ["rotation_is_reflection"]
    with pytest.raises(Exception, match="hash mismatch"):
        frames.frozen_files(spark, str(path), "0" * 64).collect()


def test_sinks(spark, stored, tmp_path):
    df = stored([("f1", 1, 2.0, float("nan"))], "frame string, area_px int, mean_delta double, max_delta double")
    target = str(tmp_path / "features")
    writers.write_features(df, target, csv=True)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        writers.write_features(df, target)
    with pytest.raises(FileExistsError):
        writers.refuse_existing(spark, [str(tmp_path / "new"), target])
    assert writers.json_safe(df).first()["max_delta"] is None
    log = str(tmp_path / "log")
    writers.append_rows(df, log)
    writers.append_rows(df, log)
    assert spark.read.parquet(log).count() == 2
    with pytest.raises(ValueError, match="columns must match"):
        writers.append_rows(df.drop("frame"), log)
    with pytest.raises(ValueError, match="unsupported"):
        writers.shadow_log(log, extra=("x",))
    row = df.select(*[F.lit("v").alias(c) for c in layouts.SHADOW_LOG if c != "schema_version"])
    write = writers.shadow_log(str(tmp_path / "shadow"))
    write(row, 0)
    write(row, 0)
    assert spark.read.parquet(str(tmp_path / "shadow")).count() == 1


def test_renderable_ranges(stored):
    pixels = [5] * 19200
    pixels[100] = pixels[4880 * 3 + 7] = 0
    df = stored([(pixels,)], "p array<int>")
    got = [(r["begin"], r["end"]) for r in df.select(frames.renderable_ranges(F.col("p")).alias("r")).first()["r"]]
    assert got == [(0, 100), (4880, 9760), (9760, 14640), (14640, 14647)]
