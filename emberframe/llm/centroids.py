"""Centroid clustering by an incremental table of exact dot products.

Each vector keeps its integer dot product with every centroid. When a centroid moves, only the components
that changed are multiplied and added; the nearest centroid then follows from the products and the
centroids' own lengths. Everything is exact in 64-bit integers, so the order of rows and tasks is no matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.settle import Generations

#: Components stay below this for vectors of 64, so that no squared distance leaves 64 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Clustering:
    """rows: vec_id, cluster, distance; centroids: one row of components each; sizes and sums by cluster."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: dict[int, int]


def whole_vectors(df: DataFrame, name: Column, vector: Column, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of exactly ``dims`` finite components, each as integer floor(scale * component).

    Others are left out: null vectors, other lengths, null, NaN or infinite components. A component of 2**27
    or more after scaling stops with an error, since distances would leave 64 bits. Repeated rows repeat.
    """
    number = lambda x: x.cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(number(x)) < float("inf"))
    too_large = F.raise_error(F.lit("component too large for exact 64-bit distances")).cast("long")
    whole = lambda x: F.when(F.abs(number(x) * scale) < LARGEST, F.floor(number(x) * scale)).otherwise(too_large)
    kept = df.select(name.alias("vec_id"), vector.alias("x")).where((F.size("x") == dims) & F.forall("x", finite))
    return kept.select("vec_id", F.transform("x", whole).alias("v"))


def hashed_start(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the least sha256 of seed:vec_id; ties by components, a null vec_id as empty text."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.select("v", order.alias("h")).orderBy("h", "v").limit(k).collect()]


def _moves(before: list[list[int]], after: list[list[int]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(centroid, places, changes) of every centroid that moved: its nonzero component changes."""
    out = []
    for j, (old, new) in enumerate(zip(before, after)):
        change = np.array(new, np.int64) - np.array(old, np.int64)
        at = np.flatnonzero(change)
        if len(at):
            out.append((j, at, change[at]))
    return out


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _assign(state: DataFrame, moves, centroids: list[list[int]]) -> DataFrame:
    """Products brought up to date by ``moves``, and the nearest centroid; of equally near ones the first."""
    k, dims = len(centroids), len(centroids[0])
    lengths = np.array([sum(x * x for x in c) for c in centroids], np.int64)
    known = "dots" in state.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _flat(batch.column(1), dims)
            dots = _flat(batch.column(2), k).copy() if known else np.zeros((len(v), k), np.int64)
            for j, at, change in moves:
                dots[:, j] += v[:, at] @ change
            score = lengths - 2 * dots
            nearest = score.argmin(axis=1)
            distance = score[np.arange(len(v)), nearest] + (v * v).sum(axis=1)
            columns = [batch.column(0), batch.column(1), _lists(dots), pa.array(nearest.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "dots", "cluster", "distance"])

    kind = state.schema["vec_id"].dataType.simpleString()
    columns = ["vec_id", "v", "dots"] if known else ["vec_id", "v"]
    return state.select(*columns).mapInArrow(assign, f"vec_id {kind}, v array<long>, dots array<long>, cluster int, distance long")


def _means(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floor of the mean of every cluster; an empty one stays. One row a cluster comes to the driver."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    moved = [list(c) for c in centroids]
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        moved[row.cluster] = [row[f"s{i}"] // row.n for i in range(len(centroids[0]))]
    return moved


def cluster(vectors: DataFrame, start: list[list[int]], rounds: int) -> Clustering:
    """Vectors (vec_id, v) by nearest centroid after ``rounds`` rounds of assigning and averaging.

    Distances are squared Euclidean; of equally near centroids the smaller number wins. A round replaces each
    non-empty centroid by the floor of its vectors' mean; a last assignment follows. Rounds end early only
    where no centroid moved, which later rounds would repeat. Null and repeated vec_ids are rows like any
    other; without vectors or centroids the result is empty; other columns are ignored.

    The state (vector and its products) is written each round and the one before it deleted; no rows are
    shuffled but one partial sum a task and cluster, so a cluster with most of the vectors is no hot task.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not start:
        return Clustering(spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), [], {})
    kept = Generations(spark)
    nowhere = [[0] * len(start[0])] * len(start)
    centroids = start
    state = kept.put(_assign(vectors, _moves(nowhere, start), start))
    for _ in range(rounds):
        moved = _means(state, centroids)
        moves = _moves(centroids, moved)
        if not moves:
            break
        centroids = moved
        state = kept.put(_assign(state, moves, centroids))
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    return Clustering(state.select("vec_id", "cluster", "distance"), centroids, {r.cluster: int(r.s) for r in sums})
