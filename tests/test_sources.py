"""Line numbers over splits, raw captures side by side, and sinks that had no test."""

import json

import numpy as np
import pandas as pd
import pytest

from emberframe import schema as layouts
from emberframe.sinks import writers
from emberframe.sources import frames, trials


def test_lines_are_numbered_over_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        want = {}
        for name, n in (("a.jsonl", 700), ("b.jsonl", 3), ("empty.jsonl", 0)):
            lines = [f"{name} {i} " + "x" * (i % 40) if i % 7 else "" for i in range(1, n + 1)]
            (tmp_path / name).write_text("".join(line + "\n" for line in lines))
            want |= {(name, i + 1): line for i, line in enumerate(lines)}
        rows = trials.numbered_lines(spark, f"{tmp_path}/*.jsonl")
        assert rows.rdd.getNumPartitions() > 3
        assert {(r.file.rsplit("/", 1)[1], r.line): r.value for r in rows.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_bad_session_lines_are_named(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"row_type": "frame"}\n\n[1]\n{"row_type": \n{"row_type": "frame"}\n')
    log = trials.session_log(spark, str(tmp_path / "s.jsonl"), layouts.FINGER_SESSION)
    assert sorted((r.line, r[trials.CORRUPT]) for r in trials.malformed(log).collect()) == [(3, "[1]"), (4, '{"row_type": ')]
    assert sorted(r.line for r in log.collect()) == [1, 3, 4, 5]
    with pytest.raises(Exception, match=r"invalid session line [34] of .*s\.jsonl"):
        trials.strict(log).collect()


def test_captures_with_equal_file_names_stay_apart(spark, tmp_path):
    for k in (1, 2):
        folder = tmp_path / f"capture{k}"
        folder.mkdir()
        (folder / "raw_0.bin").write_bytes(np.full(4, k, "<u2").tobytes())
        side = {"frame_index": 0, "monotonic_timestamp_ns": k, "width": 2, "height": 2, "dtype": "uint16", "byte_order": "little", "raw_file": "raw_0.bin", "ffc_state": "normal"}
        (folder / "raw_frame_0.json").write_text(json.dumps(side))
    got = frames.raw_frames(spark, f"{tmp_path}/capture*").collect()
    assert sorted((r.capture, r.ts_ns, r.pixels, r.issue) for r in got) == [("capture1", 1, [1] * 4, None), ("capture2", 2, [2] * 4, None)]


def test_delta_fields_and_calibration_report(spark, tmp_path):
    df = spark.createDataFrame([(t, i, [1, 2], [0.5, 1.0], [1.0, 1.0], "hold") for t in (1, 2) for i in range(3)], "trial int, frame int, pixels array<int>, delta array<double>, baseline array<double>, phase string")
    writers.write_delta_fields(df, str(tmp_path / "fields"), "phase")
    back = spark.read.parquet(str(tmp_path / "fields"))
    assert sorted((r.trial, r.frame, r.pixels, r.delta, r.phase) for r in back.collect()) == [(t, i, [1.0, 2.0], [0.5, 1.0], "hold") for t in (1, 2) for i in range(3)]
    assert sorted(p.name for p in (tmp_path / "fields").glob("trial=*")) == ["trial=1", "trial=2"]
    with pytest.raises(Exception, match="already exists"):
        writers.write_delta_fields(df, str(tmp_path / "fields"), "phase")
    writers.calibration_report(spark.createDataFrame([(1, float("nan"))], "k int, error_px double"), spark.createDataFrame([("GO",)], "decision string"), str(tmp_path / "report"))
    assert [r.asDict() for r in spark.read.schema("k int, error_px double").json(str(tmp_path / "report/samples")).collect()] == [{"k": 1, "error_px": None}]
    assert spark.read.json(str(tmp_path / "report/decision")).first().decision == "GO"


def test_stored_calibrations_and_documents(spark, tmp_path):
    good = {"version": 1, "coeff_x": [1.0, 0.0, 0.0, 2.0], "coeff_y": [0.0, 1.0, 0.0, 3.0], "image_size": [160, 120], "rms_error_px": 1.0, "max_error_px": 2.0, "sample_count": 40}
    bad = {**good, "version": 2, "coeff_x": [1.0], "rms_error_px": 3.0, "sample_count": 1}
    for name, document in (("good", good), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=2))
    read = lambda name, **gates: frames.load_calibration(spark, str(tmp_path / f"{name}.json"), **gates).first().issues
    assert read("good", image_size=(160, 120), max_rms=1.0, max_error=2.0) == []
    assert read("good", image_size=(80, 60), max_rms=0.5, max_error=1.5) == ["image_size", "rms_above_limit", "max_above_limit"]
    assert read("bad") == ["version", "coeff_x", "max_below_rms", "too_few_samples"]
    document = trials.json_document(spark, str(tmp_path / "good.json"), layouts.CALIBRATION).first()
    assert document.version == 1 and document.coeff_y == [0.0, 1.0, 0.0, 3.0] and document.image_size == [160, 120]


def test_payloads_are_decoded_a_few_at_a_time():
    payloads = pd.Series([bytes([i]) * (2 * 164 * 120) for i in range(200)])
    for decode in (frames._split_rows, frames._doubled_rows):
        parts = list(frames._grids(decode).func(iter([payloads])))
        assert max(map(len, parts)) <= 64 and sum(map(len, parts)) == 200
        assert [p[0] for part in parts for p in part] == [i * 257 for i in range(200)]
