"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.operators.settle import settle

WHITE = " \t\n\v\f\r"


def line_key(line: str, min_chars: int) -> tuple[int, int] | None:
    """128-bit key of a line without outer white space and with A-Z lowered; None if it is too short to judge."""
    line = line.strip(WHITE)
    if len(line) < min_chars:
        return None
    return struct.unpack("<qq", hashlib.blake2b(line.encode().lower(), digest_size=16).digest())


class LineRuns:
    """Sorted runs of (key, documents, holder), in levels.

    Batches are added from the largest document ids down. A batch is merged against the sorted runs: keys
    that no run holds (the anti join) are entered with their largest document as the holder, known keys add
    to the count alone. ``fanout`` runs of a level are compacted into one run of the next level, so a key is
    rewritten once a level and the number of runs grows with the logarithm of the batches. Every run is a
    written table.
    """

    def __init__(self, fanout: int = 2):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def add(self, lines: DataFrame) -> None:
        """Add one batch of distinct (h, g, doc_id)."""
        mine = lines.groupBy("h", "g").agg(F.count("*").alias("docs"), F.max("doc_id").alias("holder"))
        if self.levels:
            known = self._all().select("h", "g").distinct().withColumn("known", F.lit(True))
            mine = mine.join(known, ["h", "g"], "left").select(
                "h", "g", "docs", F.when(F.col("known").isNull(), F.col("holder")).alias("holder")
            )
        self._store(mine, 0)

    def totals(self) -> DataFrame:
        """(h, g, docs, holder) over all runs."""
        return self._merged(self._all())

    def _all(self) -> DataFrame:
        runs = [run for level in self.levels for run in level]
        out = runs[0]
        for run in runs[1:]:
            out = out.union(run)
        return out

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h", "g").agg(F.sum("docs").alias("docs"), F.max("holder").alias("holder"))

    def _store(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(settle(rows.sortWithinPartitions("h", "g")))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = runs[0]
            for run in runs[1:]:
                merged = merged.union(run)
            self._store(self._merged(merged), level + 1)


def _keys(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, gs = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = {line_key(line, min_chars) for line in (text or "").split("\n")}
                for key in found - {None}:
                    ids.append(row)
                    hs.append(key[0])
                    gs.append(key[1])
            rows = batch.column(0).take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(hs, pa.int64()), pa.array(gs, pa.int64())], ["doc_id", "h", "g"])

    return keys


def _rebuild(min_chars: int, names: Sequence[str]):
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, dropped = [], [], []
            n = batch.num_columns
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(n - 1).to_pylist()):
                lines = (text or "").split("\n")
                totals.append(len(lines))
                if not gone:
                    texts.append(text or "")
                    dropped.append(0)
                    continue
                gone = {(x["h"], x["g"]) for x in gone}
                kept = [x for x in lines if line_key(x, min_chars) not in gone]
                texts.append("\n".join(kept))
                dropped.append(len(lines) - len(kept))
            columns = [batch.column(0), pa.array(texts, pa.string()), *(batch.column(i) for i in range(2, n - 1))]
            columns += [pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"])

    return rebuild


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, carry: Sequence[str] = ()
) -> DataFrame:
    """Documents without the lines that ``min_docs`` documents share, but for the largest doc_id holding each.

    Returns doc_id, text (the lines that stay, joined by newline), the columns named in ``carry``, n_lines
    (before) and n_dropped. A null or empty text is one empty line. A document is a row: repeated rows count
    each, and every row with the largest doc_id keeps its lines; a null doc_id is below all others. Lines
    under ``min_chars`` code points after stripping always stay. An empty table gives an empty result. Other
    columns are ignored.

    Only 16-byte keys are grouped; texts are shuffled once, to meet their own dropped keys. A key of a third
    of all documents is summed before its shuffle, and its lines join by a join that Spark can split.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = settle(docs.select("doc_id", "text").mapInArrow(_keys(min_chars), f"doc_id {kind}, h long, g long"))
    cuts = lines.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted(set(cuts)), None]
    runs = LineRuns(fanout)
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        part = lines
        if high is not None:
            part = part.where((F.col("doc_id") <= high) if low is not None else F.col("doc_id").isNull() | (F.col("doc_id") <= high))
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        runs.add(part)
    shared = runs.totals().where(F.col("docs") >= min_docs).select("h", "g", "holder")
    gone = (
        lines.join(shared, ["h", "g"])
        .where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy(F.col("doc_id").alias("gone_id"))
        .agg(F.collect_set(F.struct("h", "g")).alias("gone"))
    )
    columns = ["doc_id", "text", *carry]
    joined = docs.select(*columns).join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").select(*columns, "gone")
    kinds = [(c, docs.schema[c].dataType.simpleString()) for c in columns]
    schema = ", ".join(f"`{c}` {k}" for c, k in [*kinds, ("n_lines", "long"), ("n_dropped", "long")])
    return joined.mapInArrow(_rebuild(min_chars, columns), schema)
