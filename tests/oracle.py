"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import glob
import math
import os

import duckdb

ROOT = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides give the same rows, else the first difference."""
    relation = con.execute(sql)
    columns = [d[0] for d in relation.description]
    expected = _rows(columns, relation.fetchall())
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}; {got[:2]} | {expected[:2]}"
    bad = [(a, b) for a, b in zip(got, expected) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; {sorted(columns)}\n  {bad[0][0]}\n  {bad[0][1]}"
    return None
