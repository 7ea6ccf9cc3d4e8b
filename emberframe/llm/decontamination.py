"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.words import ALPHANUMERIC, each_words, shingles
from emberframe.operators.settle import settle

#: Shingle hashes of one block of items that goes to every task: 16 MB. More items make more blocks.
BLOCK_SHINGLES = 2_000_000


def _lowered(texts: list[str | None]) -> list[bytes]:
    return [(x or "").lower().encode("utf-8", "replace") for x in texts]


def _item_sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, widths, grams = [], [], []
            for row, words in enumerate(each_words(_lowered(batch.column(1).to_pylist()), ALPHANUMERIC)):
                if len(words):
                    rows.append(row)
                    widths.append(min(width, len(words)))
                    grams.append(np.unique(shingles(words, width)).view(np.int64))
            bounds = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(widths, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                ],
                ["item_id", "width", "grams"],
            )

    return sets


class ItemIndex:
    """MinHash index of one block of items, in partitions by size.

    Items of a partition have up to ``most`` shingles and are kept by their ``k`` smallest hash values, with
    k one more than the shingles that a document containing the least share may lack. Such a document holds
    at least one of the k, so the search loses nothing; what it finds is verified on all shingles.
    """

    def __init__(self, rows: list, percent: int):
        self.ids = [r.item_id for r in rows]
        self.sets = [np.array(r.grams, np.int64).view(np.uint64) for r in rows]
        self.need = np.array([(len(s) * percent + 99) // 100 for s in self.sets], np.int64)
        self.partitions = []
        for width in sorted({r.width for r in rows}):
            group = [i for i, r in enumerate(rows) if r.width == width]
            for bits in sorted({len(self.sets[i]).bit_length() for i in group}):
                own = [i for i in group if len(self.sets[i]).bit_length() == bits]
                k = max(len(self.sets[i]) - self.need[i] + 1 for i in own)
                keys = np.concatenate([self.sets[i][:k] for i in own])
                items = np.concatenate([np.full(min(k, len(self.sets[i])), i) for i in own])
                order = np.argsort(keys, kind="stable")
                self.partitions.append((width, keys[order], items[order]))
        self.widths = sorted({w for w, _, _ in self.partitions})

    def found(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, shared shingles) of each item that the document with these words contains."""
        for width in self.widths:
            if len(words) < width:
                continue
            own = np.unique(shingles(words, width))
            for w, keys, items in self.partitions:
                if w != width:
                    continue
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
                hit = np.flatnonzero(high > low)
                for i in sorted({int(x) for h in hit for x in items[low[h] : high[h]]}):
                    shared = len(np.intersect1d(own, self.sets[i], assume_unique=True))
                    if shared >= self.need[i]:
                        yield i, shared


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each document that holds ``percent`` of an item.

    docs has doc_id, text; items has item_id, text. Texts are compared in lower case as runs of letters and
    digits, by distinct shingles of ``width`` words; an item of fewer words is one shingle of its own length.
    Null and wordless texts hold nothing and are held by nothing. Repeated rows repeat their pairs; other
    columns are ignored; an empty side gives an empty result.

    Whole documents are read once for each block of items, in tasks of any size, with no shuffle. A block is
    at most ``BLOCK_SHINGLES`` hashes; a larger benchmark is worked off in more blocks.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    sets = settle(
        items.select("item_id", "text")
        .mapInArrow(_item_sets(width), f"item_id {item_kind.simpleString()}, width int, grams array<long>")
        .orderBy("item_id")
    )
    schema = f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, n_shared long, n_item long"
    out, block, size = None, [], 0
    empty = spark.createDataFrame([], schema)

    def searched(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(ItemIndex(rows, percent))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                at, found, counts = [], [], []
                for row, words in enumerate(each_words(_lowered(batch.column(1).to_pylist()), ALPHANUMERIC)):
                    for item, n in index.found(words):
                        at.append(row)
                        found.append(item)
                        counts.append(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array([index.ids[i] for i in found]).cast(item_type) if found else pa.array([], item_type),
                        pa.array(counts, pa.int64()),
                        pa.array([len(index.sets[i]) for i in found], pa.int64()),
                    ],
                    ["doc_id", "item_id", "n_shared", "n_item"],
                )

        return docs.select("doc_id", "text").mapInArrow(search, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(item_kind)
    for row in sets.toLocalIterator():
        if block and size + len(row.grams) > BLOCK_SHINGLES:
            part = searched(block)
            out, block, size = part if out is None else out.union(part), [], 0
        block.append(row)
        size += len(row.grams)
    if block:
        part = searched(block)
        out = part if out is None else out.union(part)
    return (empty if out is None else out).withColumn("containment", F.col("n_shared") / F.col("n_item"))
