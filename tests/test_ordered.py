"""The split forms give what the plain windows give, hot keys and cuts included."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberframe.operators import gates, statistics, windows
from emberframe.operators.joins import asof_pairs, interval_join, longest_prefix
from emberframe.operators.ordered import (
    Series,
    following,
    last_known,
    neighbours,
    next_known,
    previous,
    prior_max,
    row_index,
    running_max,
    running_sum,
    scan,
)
from emberframe.operators.quantiles import exact_quantiles

SERIES = Series(("k",), ("t", "id"))


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows sit in key 0; many times are tied; some values are null."""
    rng = random.Random(4)
    data = [
        (0 if i % 3 == 0 else rng.randrange(1, 9), rng.randrange(0, 60), i, None if rng.random() < 0.3 else rng.randrange(-5, 6) / 2)
        for i in range(900)
    ]
    path = spark.createDataFrame(data, "k int, t int, id int, v double")
    return path.cache()


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


STEPS = {
    "index": (lambda: row_index(), lambda w: F.row_number().over(w).cast("long")),
    "sum": (lambda: running_sum(F.col("v")), lambda w: F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))),
    "max": (lambda: running_max(F.col("v")), lambda w: F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0))),
    "prior": (lambda: prior_max(F.col("v")), lambda w: F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1))),
    "previous": (lambda: previous(F.col("v")), lambda w: F.lag("v").over(w)),
    "following": (lambda: following(F.col("v")), lambda w: F.lead("v").over(w)),
    "last": (lambda: last_known(F.col("v")), lambda w: F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))),
    "next": (lambda: next_known(F.col("v")), lambda w: F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing))),
}


@pytest.mark.parametrize("name", STEPS)
@pytest.mark.parametrize("size", [7, 200])
def test_scan_equals_window(rows, name, size):
    step, window = STEPS[name]
    same(rows.withColumn("x", window(SERIES.window())), scan(rows, SERIES, {"x": step()}, rows_per_chunk=size))


def test_neighbours_equal_window(rows):
    def build(w):
        return {"m": F.percentile("v", 0.5).over(w.rowsBetween(-2, 2)), "l": F.lag("v", 2).over(w)}

    same(rows.withColumns(build(SERIES.window())), neighbours(rows, SERIES, 2, build, rows_per_chunk=5))


def test_quantiles_equal_numpy(rows):
    levels = {"a": 0.0, "b": 0.03, "c": 0.5, "d": 0.98, "e": 1.0}
    got = {r["k"]: r for r in exact_quantiles(rows, ["k"], "v", levels, split=True).collect()}
    data = rows.toPandas().dropna()
    for key, part in data.groupby("k"):
        for name, p in levels.items():
            assert got[key][name] == pytest.approx(np.quantile(part["v"], p))


def test_gates_split(rows):
    kw = dict(target=0.0, tolerance=1.0)
    a = gates.stable_gate(rows, SERIES, "t", "v", required_s=3.0, rows_per_chunk=10**9, **kw)
    b = gates.stable_gate(rows, SERIES, "t", "v", required_s=3.0, rows_per_chunk=40, **kw)
    same(a, b)
    a = gates.cycle_count(rows, SERIES, "v", close=-1.0, reopen=1.0, rows_per_chunk=10**9)
    same(a, gates.cycle_count(rows, SERIES, "v", close=-1.0, reopen=1.0, rows_per_chunk=33))


def test_average_rank_split(rows):
    known = rows.filter("v is not null")
    a = windows.average_rank(known, ["k"], "v", rows_per_chunk=10**9)
    same(a, windows.average_rank(known, ["k"], "v", rows_per_chunk=3))


def test_asof_ties(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 7.0), (1, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 5.0, "a"), (1, 6.0, "b")], "k int, t double, v string")
    at = lambda strict: {
        r["t"]: r["v"] for r in asof_pairs(left, right, ["k"], "t", ["v"], inclusive=not strict, rows_per_chunk=2).collect()
    }
    assert at(False) == {5.0: "a", 7.0: "b", 1.0: None}
    assert at(True) == {5.0: None, 7.0: "b", 1.0: None}


def test_interval_join_brute_force(spark):
    rng = random.Random(1)
    points = [(0, i, rng.random() * 100) for i in range(200)]
    spans = [(0, n, a, a + rng.random() * 20) for n, a in ((n, rng.random() * 100) for n in range(15))]
    rows = spark.createDataFrame(points, "k int, id int, at double")
    windows_ = spark.createDataFrame(spans, "k int, rank int, start double, end double")
    got = {r["id"]: r["rank"] for r in interval_join(rows, windows_, ["k"], "at", bucket=7.0, row_id=["id"], rank="rank").collect()}
    want = {}
    for _, i, t in points:
        hits = [n for _, n, a, b in spans if a <= t <= b]
        if hits:
            want[i] = min(hits)
    assert got == want


def test_longest_prefix(spark):
    files = spark.createDataFrame([("a_b.csv",), ("a_b_c.png",), ("ab.csv",), ("a",)], "name string")
    rules = spark.createDataFrame([("a", "g1", 1), ("a_b", "g2", 3)], "prefix string, group string, group_rank int")
    got = {r["name"]: r["group"] for r in longest_prefix(files, rules, "name").collect()}
    assert got == {"a_b.csv": "g2", "a_b_c.png": "g2", "ab.csv": None, "a": "g1"}


def test_lag_scan_split(rows):
    df = rows.filter("v is not null").withColumn("p", F.col("id") % 7 + 0.0)
    a = statistics.pooled_lag_scan(df, SERIES, "p", "v", max_lag=3, rows_per_chunk=10**9)
    b = statistics.pooled_lag_scan(df, SERIES, "p", "v", max_lag=3, rows_per_chunk=25)
    left = {r["lag"]: r for r in a.collect()}
    for r in b.collect():
        assert r["pair_count"] == left[r["lag"]]["pair_count"]
        assert r["pooled_pearson"] == pytest.approx(left[r["lag"]]["pooled_pearson"])


def test_p_value():
    # Two-sided p of r = 0.5 with 10 pairs, from tables of the t distribution: t = 1.633, p = 0.1411.
    r, n = 0.5, 10
    t2 = r * r * (n - 2) / (1 - r * r)
    assert statistics.regularised_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2)) == pytest.approx(0.14111, abs=1e-4)
