"""Vector best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.tokens import encoder
from emberframe.operators.settle import settle


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence: tokens, documents, and attention cost (the sum of squared lengths).

    ``score`` chooses among the sequences that hold a piece under every capacity: "norm" the one whose
    weighted residual after it is smallest, "dot" the one with the largest weighted product of the piece's
    needs and the residual. Needs and residuals count as shares of the capacities.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    score: str = "norm"

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def plan(counts: dict[int, int], limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """(length, first, end, sequence, offset): pieces first..end of a length go to sequences from ``sequence`` on.

    Pieces of one length have equal needs, so best fit, longest first, runs over lengths with counts and over
    groups of sequences with equal residuals: the work depends on the capacity alone, not on the number of
    pieces. A piece goes to the group with the best score that holds it; none: to new sequences.
    """
    capacity = limits.capacity()
    weights = np.array(limits.weights) / capacity
    groups: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)  # residual -> ranges of sequences
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > capacity).any():
            raise ValueError(f"a piece of {length} tokens is over the capacities")
        while left:
            keys = np.array(list(groups), np.int64).reshape(-1, 3)
            fits = np.flatnonzero((keys >= need).all(axis=1))
            if len(fits):
                rest = keys[fits]
                score = ((rest - need) * weights) ** 2 if limits.score == "norm" else -(rest * weights) * (need * weights)
                at = tuple(int(x) for x in rest[int(np.argmin(score.sum(axis=1)))])
                start, size = groups[at].pop()
                if not groups[at]:
                    del groups[at]
            else:
                fill = int((capacity // need).min())
                at, start, size = tuple(int(x) for x in capacity), opened, -(-left // fill)
                opened += size
            n = min(left, size)
            rows.append((length, first, first + n, start, int(capacity[0]) - at[0]))
            groups[tuple(int(x) for x in np.array(at) - need)].append((start, n))
            if n < size:
                groups[at].append((start + n, size - n))
            first, left = first + n, left - n
    return rows


def _pieces(path: str, end_id: int, size: int, max_piece_attention: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows, which, starts, lengths, sums, places = [], [], [], [], [], []
            for row, own in enumerate(encode.encode_all(batch.column(1).to_pylist())):
                ids = np.append(np.frombuffer(own, encode.kind).astype("<u4"), np.array([end_id], "<u4"))
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row)
                    which.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[a:b].tobytes()))
                    places.append(seen[b - a])
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(which, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array([part] * len(rows), pa.int32()),
                    pa.array(places, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
            )

    return pieces


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place in a sequence.

    A document is its token ids and then ``end_id``; a null or empty text is ``end_id`` alone. A longer one
    than the token capacity is cut into pieces of that size, the first taking what is over. Sequences are
    filled without gaps. Repeated rows are packed each; other columns are ignored; an empty table gives an
    empty result.

    Tokens are made in one pass without a shuffle. A piece's number among those of its length is its place in
    its task plus the counts of the tasks before, so a length that a third of all pieces share is no single
    task. The counts by length, as many as the token capacity at most, go to the driver, which plans the
    sequences by count; the plan goes back to the tasks, and its size depends on the capacity alone.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = limits.tokens
    if limits.attention:
        size = min(size, int(limits.attention**0.5))
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long"
    pieces = settle(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, end_id, size, 0), schema))
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(counts, limits)
    table = defaultdict(list)
    for length, first, end, sequence, offset in rows:
        table[length].append((first, end, sequence, offset))
    shared = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in table.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                ranges = own[int(length[at[0]])]
                row = ranges[np.searchsorted(ranges[:, 0], number[at], side="right") - 1]
                sequence[at] = row[:, 2] + number[at] - row[:, 0]
                offset[at] = row[:, 3]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = pieces.join(bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("number")
    )
    return numbered.mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
