"""Edge values and null keys give the same rows in the plain and in the split form."""

import math

import pytest

from emberframe.operators.ordered import Series, previous, row_index, running_sum, scan, split_evenly
from emberframe.operators.quantiles import exact_quantiles
from emberframe.operators.windows import average_rank
from pyspark.sql import functions as F

INF, NAN = math.inf, math.nan
WANTED = {"low": 0.05, "mid": 0.5, "high": 0.95}


def _rows(df):
    """Rows as text; the two zeros are equal, NaN is NaN."""
    return sorted(str(tuple(x + 0.0 if isinstance(x, float) else x for x in r)) for r in df.collect())


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, 3.0, NAN, NAN],
        [1.0, 2.0, INF],
        [-INF, -INF, 5.0, INF, INF],
        [-0.0, 0.0, -1.0, 1e308, -1e308],
        [NAN],
        [None, 4.0, None],
    ],
)
def test_quantiles_of_edge_values(spark, values):
    df = spark.createDataFrame([("a", v) for v in values] + [(None, v) for v in values], "k string, v double")
    plain = exact_quantiles(df, ["k"], "v", WANTED, split=False)
    assert plain.count() == 2
    assert _rows(exact_quantiles(df, ["k"], "v", WANTED, split=True)) == _rows(plain)


def test_scan_with_null_keys(spark):
    rows = [(k, i, i * i) for k in ("a", None) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    steps = {"index": row_index(), "total": running_sum(F.col("v")), "before": previous(F.col("v"))}
    series = Series(("k",), ("t",))
    assert _rows(scan(df, series, steps, rows_per_chunk=3)) == _rows(scan(df, series, steps))


def test_ranks_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 2.0), (None, 5.0)], "k string, v double")
    for size in (None, 2):
        got = {(r.k, r.v, r["rank"]) for r in average_rank(df, ["k"], "v", rows_per_chunk=size).collect()}
        assert got == {("a", 1.0, 0.0), (None, 2.0, 0.5), (None, 5.0, 2.0)}


def test_null_values_have_no_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), (None, None)], "k string, v double")
    for size in (None, 1):
        got = {(r.k, r.v, r["rank"]) for r in average_rank(df, ["k"], "v", rows_per_chunk=size).collect()}
        assert got == {("a", 1.0, 0.0), ("a", None, None), ("a", 3.0, 1.0), (None, None, None)}


CLOCKS = {
    "log-normal": "exp(3 * (rand(1) + rand(2) + rand(3) + rand(4) + rand(5) + rand(6) - 3))",
    "one outlier": "case when id = 7 then 1e15 else rand(1) end",
    "narrow": "100 + rand(1) / 1000000",
    "two scales": "case when id % 2 = 0 then rand(1) * 1e-9 else 1e9 + rand(2) end",
}


@pytest.mark.parametrize("clock", sorted(CLOCKS))
def test_chunks_are_even_whatever_the_clock(spark, clock):
    rows, wish = 40_000, 500
    hot = spark.range(rows).selectExpr("case when id % 10 < 8 then 'hot' else concat('cold', id % 100) end as k", f"{CLOCKS[clock]} as t")
    sizes = split_evenly(hot, ["k"], F.col("t"), wish).groupBy("k", "_chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 4 * wish
    assert sum(r["count"] for r in sizes) == rows
    assert all(r["_chunk"] == 0 for r in sizes if r.k != "hot") and len([r for r in sizes if r.k == "hot"]) >= rows * 0.8 / wish / 2


def test_chunks_follow_the_clock(spark):
    rows = [("a", float(v)) for v in range(100)] + [("a", None), ("a", NAN), ("a", INF), ("a", -INF)] + [("b", 1.0), ("b", 2.0)] + [("t", 5.0)] * 50
    got = split_evenly(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), 10).collect()
    own = sorted((r for r in got if r.k == "a" and r.v is not None), key=lambda r: (math.isnan(r.v), r.v))
    assert [r._chunk for r in own] == sorted(r._chunk for r in own) and own[0]._chunk == 0 and len({r._chunk for r in own}) >= 8
    assert {r._chunk for r in got if r.k == "b" or r.v is None} == {0}
    assert len({r._chunk for r in got if r.k == "t"}) == 1
    assert split_evenly(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), 1000) is None


@pytest.mark.parametrize("slices", [3, 40])
def test_quantiles_of_many_slices(spark, slices):
    df = spark.range(900).selectExpr("case when id < 700 then 'a' when id < 890 then 'b' end as k", "case when id % 50 = 0 then null when id % 3 = 0 then 7 else 100 + id / 1e9 end as v")
    plain = exact_quantiles(df, ["k"], "v", WANTED, split=False)
    assert _rows(exact_quantiles(df, ["k"], "v", WANTED, split=True, rows_per_slice=slices)) == _rows(plain)
