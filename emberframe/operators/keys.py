"""Joins in which a null key is a key like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null, and keep the left side's key columns.

    Spark plans the null-safe comparison as an equi-join, so it shuffles and splits like any other.
    """
    own = {key: f"_same_{i}" for i, key in enumerate(keys)}
    same = [F.col(key).eqNullSafe(F.col(name)) for key, name in own.items()]
    return left.join(right.withColumnsRenamed(own), same, how).drop(*own.values())
