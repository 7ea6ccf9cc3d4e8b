"""Nearest projections by growing rings against a search over all depth pixels; every reason a target is blocked for."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberframe.functions.geometry import Camera, Rigid
from emberframe.operators import association

DEPTH, COLOR = Camera(64, 48, 60.0, 60.0, 32.0, 24.0), Camera(90, 70, 61.0, 61.0, 45.0, 35.0)
STILL = Rigid(((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), (0.002, 0.0, 0.0))


def place(x, y, raw):
    z = raw * 0.001
    return ((x - 32) / 60 * z + 0.002) / z * 61 + 45, (y - 24) / 60 * z / z * 61 + 35


@pytest.mark.parametrize("cell", [1, 3, 8, 200])
def test_rings_end_at_the_nearest(spark, cell):
    rng = random.Random(cell)
    depth = [(k, rng.randrange(64), rng.randrange(48), rng.choice([300, 500, 800])) for k in (0, 1, 2) for _ in range((1, 6, 150)[k])]
    depth = list({r[:3]: r for r in depth}.values())
    targets = [(k, i, rng.randrange(90), rng.randrange(70)) for i, k in enumerate([0, 1, 2, 3] * 30)]
    df = spark.createDataFrame([(*r, *place(*r[1:])) for r in depth], "k int, x int, y int, raw_depth int, _u double, _v double")
    df = df.withColumn("depth_m", F.col("raw_depth") * 0.001)
    got = association.nearest_projection(spark.createDataFrame(targets, "k int, target int, cx int, cy int"), df, ["k"], COLOR, cell)
    want = {}
    for k, i, cx, cy in targets:
        near = [(math.hypot(place(*r[1:])[0] - cx, place(*r[1:])[1] - cy), r[1:]) for r in depth if r[0] == k]
        if near:
            want[i] = min(near)
    found = {r.target: (r.match_error_px, (r.depth_pixel.x, r.depth_pixel.y, r.raw_depth)) for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[i][1] == want[i][1] and found[i][0] == pytest.approx(want[i][0]) for i in want)


def test_every_reason(spark):
    u, v = place(32, 24, 500)
    depth = [("ok", 32, 24, 500), ("far", 32, 24, 2000), ("off", 2, 2, 500), ("zero", 32, 24, 0), ("behind", 32, 24, -500), ("aside", 400, 24, 500), ("outside", 64, 24, 500)]
    targets = [(k, k, round(u), round(v), None) for k in ("ok", "far", "off", "zero", "behind", "aside", "none")]
    ou, ov = place(64, 24, 500)
    targets += [("outside", "outside", round(ou), round(ov), None), ("ok", "bad", None, None, "normalized_color_nonfinite"), (None, "null key", 1, 1, None)]
    got = association.associate_depth(
        spark.createDataFrame(targets, "k string, target string, cx int, cy int, reason string"),
        spark.createDataFrame(depth, "k string, x int, y int, raw_depth int"), ["k"], 0.001, DEPTH, COLOR, STILL,
    )
    assert {r.target: r.reason for r in got.collect()} == {
        "ok": None, "far": "color_to_depth_depth_out_of_range", "off": "color_to_depth_match_error_exceeded", "zero": "color_to_depth_zero_depth",
        "behind": "color_to_depth_zero_depth", "aside": "color_to_depth_no_match", "none": "color_to_depth_buffer_missing",
        "outside": "color_to_depth_out_of_bounds", "bad": "normalized_color_nonfinite", "null key": "color_to_depth_buffer_missing",
    }
    back = Rigid(((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, -1.0)), (0.0, 0.0, 0.0))
    one = association.associate_depth(
        spark.createDataFrame(targets[:1], "k string, target string, cx int, cy int, reason string"),
        spark.createDataFrame(depth[:1], "k string, x int, y int, raw_depth int"), ["k"], 0.001, DEPTH, COLOR, back,
    ).collect()
    assert [r.reason for r in one] == ["color_to_depth_forward_geometry_invalid"]


def test_a_cell_is_one_row_however_many_points_it_holds(spark, monkeypatch):
    written, plain = [], association.settle
    monkeypatch.setattr(association, "settle", lambda df: written.append(plain(df)) or written[-1])
    points = spark.range(500).selectExpr("1 as f", "id as x", "0 as y", "1.0 as raw_depth", "0.001 as depth_m", "3 + id / 1000 as _u", "3.0 as _v")
    targets = spark.createDataFrame([(1, 7, 3.2, 3.0)], "f int, target int, cx double, cy double")
    got = association.nearest_projection(targets, points, ["f"], DEPTH).collect()
    assert [(r["target"], r["depth_pixel"]["x"]) for r in got] == [(7, 200)]
    assert [t.count() for t in written if "_points" in t.columns] == [1]
