"""Connected parts and morphology of whole batches against flood fill, and plans without a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import components, pixels
from tests.test_shapes import flood

SCHEMA = "trial int, frame int, height int, width int, pixels array<int>"


def images(seed=3, n=80):
    rng = np.random.default_rng(seed)
    out = [(rng.random((rng.integers(1, 15), rng.integers(1, 15))) < rng.random()).astype(int) for _ in range(n)]
    return out + [np.zeros((4, 5), int), np.ones((6, 3), int), np.indices((9, 9)).sum(axis=0) % 2]


def brute_parts(mask, diagonal):
    labels = flood(mask.astype(bool), diagonal)
    out = []
    for k in range(1, labels.max() + 1):
        y, x = np.nonzero(labels == k)
        pos = (y * mask.shape[1] + x).tolist()
        out.append((k, len(x), x.min(), y.min(), x.max(), y.max(), round(x.mean(), 9), round(y.mean(), 9), pos))
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("block", [1 << 20, 100])
def test_parts_of_frames_of_many_sizes(spark, monkeypatch, diagonal, block):
    monkeypatch.setattr(components, "BLOCK", block)
    all_images = images()
    rows = [(0, i, *m.shape, m.ravel().tolist()) for i, m in enumerate(all_images)] + [(0, 999, 2, 2, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mask = F.transform("pixels", lambda v: v == 1)
    got = {i: [] for i in range(len(all_images))}
    parts = components.components(df, mask, diagonal=diagonal)
    for r in parts.collect():
        got[r.frame].append((r.label, r.area, r.x0, r.y0, r.x1, r.y1, round(r.cx, 9), round(r.cy, 9), r.positions))
    assert {i: sorted(p) for i, p in got.items()} == {i: brute_parts(m, diagonal) for i, m in enumerate(all_images)}
    best = {r.frame: r for r in components.with_largest(df, mask, lambda p: p["area"] > 2, diagonal=diagonal).collect()}
    for i, m in enumerate(all_images):
        large = [p for p in brute_parts(m, diagonal) if p[1] > 2]
        want = max(large, key=lambda p: (p[1], -p[0]), default=None)
        assert (best[i]._best.label if best[i]._best else None) == (want[0] if want else None) and best[i]._parts == len(large)
    assert best[999]._best is None


def test_shapes_are_found_without_a_shuffle(stored):
    df = stored([(0, i, 8, 8, [i % 3 * 100] * 64) for i in range(4)], SCHEMA)
    mask = F.transform("pixels", lambda v: v > 60)
    for found in (components.components(df, mask), components.hottest_blob(df), components.dark_shape(df), components.hand_component(df), components.warm_finger(df)):
        assert "Exchange" not in plan(found) and "Join" not in plan(found)


@pytest.mark.parametrize("radius", [1, 2, 5])
def test_morphology(spark, radius):
    all_images = images(8, 30)
    df = spark.createDataFrame([(0, i, *m.shape, m.ravel().tolist()) for i, m in enumerate(all_images)] + [(0, 999, 2, 2, None)], SCHEMA)
    size = ("pixels", "width", "height")
    both = [pixels.morphology(*map(F.col, size), radius, dilate=d).alias(n) for d, n in ((False, "thin"), (True, "thick"))]
    for r in df.select("frame", *both).collect():
        if r.frame == 999:
            assert r.thin is None and r.thick is None
            continue
        m = all_images[r.frame]
        near = np.pad(m, radius)
        windows = np.lib.stride_tricks.sliding_window_view(near, (2 * radius + 1,) * 2)
        assert r.thin == windows.min(axis=(2, 3)).ravel().tolist() and r.thick == windows.max(axis=(2, 3)).ravel().tolist()
