"""Labelling, outlines, hulls, matching and tracking against small brute-force checks."""

from collections import deque

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberframe.functions import arrays
from emberframe.operators import components, pixels, tracking


def flood(mask, diagonal):
    labels, count = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if labels[start]:
            continue
        count += 1
        queue = deque([start])
        labels[start] = count
        while queue:
            y, x = queue.popleft()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    at = (y + dy, x + dx)
                    if (diagonal or not dy or not dx) and 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1]:
                        if mask[at] and not labels[at]:
                            labels[at] = count
                            queue.append(at)
    return labels


@pytest.mark.parametrize("diagonal", [True, False])
def test_labels(diagonal):
    rng = np.random.default_rng(5)
    for _ in range(60):
        mask = rng.random(rng.integers(1, 14, 2)) < rng.random()
        assert np.array_equal(components.label_mask(mask, diagonal), flood(mask, diagonal))


def test_outline_lengths():
    at = lambda rows: np.flatnonzero(np.array(rows))
    assert components.outline_length(at([[1, 1, 1]] * 3), 3) == 8.0
    assert components.outline_length(at([[1, 1], [0, 0]]), 2) == 2.0
    assert components.outline_length(at([[0, 1, 0], [1, 1, 1], [0, 1, 0]]), 3) == pytest.approx(4 * 2**0.5)


def test_hull(stored):
    df = stored([([0.0, 2.0, 2.0, 0.0, 1.0], [0.0, 0.0, 2.0, 2.0, 1.0])], "x array<double>, y array<double>")
    r = df.select(components.hull("x", "y").alias("h")).first()["h"]
    assert (r["area"], r["cx"], r["cy"]) == (4.0, 1.0, 1.0)


def frame_table(stored, images):
    rows = [(0, i, *image.shape, image.ravel().tolist()) for i, image in enumerate(images)]
    return stored(rows, "trial int, frame int, height int, width int, pixels array<int>")


def test_blob_and_diagonal(stored):
    image = np.zeros((10, 12), int)
    image[2:4, 3:5] = 500
    image[4, 5] = 500
    out = components.hottest_blob(frame_table(stored, [image, image * 0]), min_area=2, pad=1).orderBy("frame").collect()
    assert out[0]["mode"] == "blob" and tuple(out[0]["roi"]) == (2, 1, 4, 4) and out[0]["quality"] == pytest.approx(4 / 16)
    assert out[1]["mode"] == "blob_no_hotspot"


def test_hot_mask_floor(stored):
    flat = np.full((4, 4), 10)
    hot = flat.copy()
    hot[1, 1] = 11
    hot[2, 2] = 15
    df = frame_table(stored, [flat, flat, hot])
    base = pixels.baseline(df.filter("frame < 2"))
    r = pixels.hot_mask_features(pixels.with_delta(df, base)).filter("frame = 2").first()
    assert (r["area_px"], r["mean_delta"], r["max_delta"]) == (1, 5.0, 5.0)


def test_pca_matches_svd(stored):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9, 6))
    df = stored([(0, i, row.tolist()) for i, row in enumerate(x)], "trial int, frame int, delta array<double>")
    got = np.array([r[2:] for r in pixels.pca_scores(df, None).orderBy("frame").collect()])
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6)


def test_pca_of_a_region_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(pixels, "GRAM_NUMBERS", 50)
    rng = np.random.default_rng(4)
    images = {t: rng.normal(size=(30, 6, 8)) for t in (1, 2)}
    rows = [(t, i, 6, 8, image.ravel().tolist()) for t, own in images.items() for i, image in enumerate(own)]
    df = spark.createDataFrame(rows, "trial int, frame int, height int, width int, delta array<double>").repartition(7)
    got = {(r[0], r[1]): r[2:] for r in pixels.pca_scores(df, (2, 1, 4, 3)).collect()}
    for t, own in images.items():
        x = own[:, 1:4, 2:6].reshape(30, -1)
        scores = np.array([got[t, i] for i in range(30)])
        spread = scores.T @ scores
        s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
        assert np.allclose(np.diag(spread), s[:3] ** 2) and np.allclose(spread - np.diag(np.diag(spread)), 0, atol=1e-6)
        assert np.allclose(scores.mean(axis=0), 0, atol=1e-9)


def test_shift_search():
    anchor = np.array([y * 20 + x for y in range(5, 10) for x in range(6, 12)])
    assert tracking.best_shift(anchor, tracking.moved(anchor, 20, 20, 2, -1), 20, 20, (0, 0)) == (2, -1)
    assert tracking.best_shift(anchor, anchor, 20, 20, (1, 0)) == (0, 0)
    image = np.random.default_rng(0).normal(size=(30, 40))
    x, y, score = tracking.template_match(image, image[7:15, 11:21])
    assert (x, y) == (11, 7) and score == pytest.approx(1.0)


def finger_frame(shift=0):
    image = np.full((120, 160), 1000)
    image[50:72, 70 + shift : 160] = 1400
    return image


def test_anchor_and_tracking(stored):
    frames = frame_table(stored, [finger_frame(), finger_frame(), finger_frame(1), finger_frame(4)])
    anchors = tracking.trial_anchor(frames.filter("frame < 2"))
    a = anchors.first()
    assert a["reason"] is None and a["finger_width_px"] >= 10.0
    out = tracking.track_trials(frames, anchors).orderBy("frame").collect()
    assert [r["tracking_valid"] for r in out] == [True, True, True, False]
    assert (out[2]["shift_u"], out[2]["primary_signal_count"]) == (1, 0.0)
    assert out[3]["tracking_reason"] == "center_step_exceeded"


def test_zbuffer_ties(stored):
    rows = [(0, 1, 1, 2.0, 5, 3, 10), (0, 1, 1, 2.0, 4, 9, 11), (0, 1, 1, 2.0, 4, 8, 12), (0, 2, 1, 1.0, 0, 0, 1)]
    df = stored(rows, "map int, u int, v int, z double, source_y int, source_x int, raw_depth int")
    win = {r["u"]: r["raw_depth"] for r in pixels.zbuffer(df, ["map"]).collect()}
    assert win == {1: 12, 2: 1}


def test_palette_ties(stored):
    colours = stored([(1, 0, 0)], "r int, g int, b int")
    palette = stored([(0, 0, 0, 0), (1, 2, 0, 0)], "idx int, r int, g int, b int")
    assert pixels.nearest_palette(colours, palette).first()["palette_index"] == 0
    assert pixels.nearest_palette(colours, palette, invert=True).first()["palette_index"] == 1


def test_two_clicks(stored):
    frames = frame_table(stored, [finger_frame()]).withColumns(
        {"tip_x": F.lit(72.0), "tip_y": F.lit(61.0), "along_x": F.lit(104.0), "along_y": F.lit(61.0)}
    )
    r = tracking.clicked_regions(frames).first()
    assert r["reason"] is None and len(r["distal"]) >= 20 and len(r["proximal"]) >= 20


def test_mask_tracking_walks_whole_trials(spark):
    import pandas as pd

    from emberframe.catalog import shapes
    from tests.oracle import ROOT

    got = {r.trial for r in shapes.mask_tracking(spark, f"{ROOT}/sf0.001").select("trial").distinct().collect()}
    assert got and got <= {r.trial for r in shapes.frames(spark, f"{ROOT}/sf0.001").select("trial").distinct().collect()}
    square = lambda at: [y * 32 + x + at for y in range(10, 22) for x in range(4, 16)]
    inner = [y * 32 + x for y in range(12, 20) for x in range(6, 14)]
    rows = [
        {"trial": t, "frame": f, "width": 32, "height": 32, "positions": square(f // 3), "anchor_positions": square(0),
         "anchor_distal": inner, "anchor_proximal": inner, "anchor_finger_width_px": 12.0}
        for t in (1, 2) for f in range(20)
    ]
    frame = pd.DataFrame(rows)
    whole = pd.concat(tracking._walk(iter([frame])))
    parts = pd.concat(tracking._walk(frame.iloc[k : k + 7] for k in range(0, 40, 7)))
    assert parts.reset_index(drop=True).equals(whole.reset_index(drop=True))
    assert list(parts.shift_u) == [f // 3 for f in range(20)] * 2


def test_quantile_is_the_fused_weighted_sum(spark):
    """To the last bit, which decides whether a range just meets its limit."""
    rng = np.random.default_rng(3)
    frames = [sorted(int(v) for v in rng.integers(-400, 400, 64)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(frames)), "frame int, v array<int>")
    levels = (0.02, 0.05, 0.9, 0.95, 0.98, 0.99)
    got = df.select("frame", *[arrays.quantile(F.col("v"), p) for p in levels]).collect()
    table = pa.table({"frame": np.repeat(np.arange(400, dtype=np.int32), 64), "v": np.concatenate(frames).astype(np.int32)})  # noqa: F841
    expected = duckdb.sql(f"SELECT frame, {', '.join(f'quantile_cont(v, {p})' for p in levels)} FROM \"table\" GROUP BY frame").fetchall()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_quantile_computes_its_array_once(stored):
    df = stored([([3, 1, 2],), ([],), (None,)], "v array<int>")
    inner = arrays.quantile(F.array_sort("v"), 0.5)
    got = df.select(arrays.quantile(F.array_sort(F.array(inner, inner + 1)), 0.5).alias("q"))
    assert _plan(got).count("array_sort(") == 3
    assert [r.q for r in got.collect()] == [2.5, None, None]


def test_the_plan_of_hand_axis_stays_small(stored):
    pixels_of = [0, 0, 1, 1] * 4
    df = stored([(1, 0, 4, 4, pixels_of), (1, 1, 4, 4, [0] * 16)], "trial int, frame int, height int, width int, pixels array<int>")
    out = pixels.hand_axis(df, F.col("pixels"))
    assert len(_plan(out)) < 100_000
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, 0, 2.0, 1.5, 2.5, 1.5, 1.0, 0.0), (1, 1, None, None, None, None, None, None)]


def test_the_plan_of_warm_finger_stays_small(stored):
    image = np.zeros((12, 12), int)
    image[3:9, 2:11] = 90
    image[3:9, 4] = 100
    rows = [(1, 0, 12, 12, image.ravel().tolist()), (1, 1, 12, 12, [0] * 144)]
    df = stored(rows, "trial int, frame int, height int, width int, pixels array<int>")
    out = components.warm_finger(df, offset=40.0, min_area=4, min_centre_x=1.0, min_x=0, distal_inset=1.0, reference_inset=2.0)
    assert len(_plan(out)) < 100_000
    got = {r.frame: r for r in out.collect()}
    whole, none = got[0], got[1]
    assert (whole.component_area_px, whole.tip_x, whole.tip_y) == (54, 2.0, 5.5)
    # rows 5 to 7 and columns 2 to 4 around (3, 6); rows 4 to 8 and columns 2 to 6 around (4, 6)
    assert (whole.distal_3x3_mean_count, whole.reference_5x5_mean_count) == (840 / 9, 2300 / 25)
    assert (whole.primary_signal_count, whole.reason) == (840 / 9 - 92, None)
    assert (none.component_area_px, none.tip_x, none.reason) == (None, None, "right_hot_hand_component_missing")
