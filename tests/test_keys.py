"""Null keys and required arguments."""

import pytest
from pyspark.sql import functions as F

from emberframe.operators.joins import interval_join
from emberframe.operators.ordered import with_group_stats


def test_group_stats_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 5), (None, 7)], "k string, v int")
    got = with_group_stats(df, ["k"], {"top": F.max("v")}).collect()
    assert sorted(got, key=str) == sorted([("a", 1, 3), ("a", 3, 3), (None, 5, 7), (None, 7, 7)], key=str)


def test_overlapping_windows_need_an_order(spark):
    rows = spark.createDataFrame([(1, 2.0)], "k int, t double")
    windows = spark.createDataFrame([(1, 1.0, 3.0)], "k int, start double, end double")
    with pytest.raises(ValueError, match="row_id and rank"):
        interval_join(rows, windows, ["k"], "t", bucket=1.0)
    assert interval_join(rows, windows, ["k"], "t", bucket=1.0, disjoint=True).count() == 1
