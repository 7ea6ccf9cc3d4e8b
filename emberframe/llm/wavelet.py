"""Token ids as wavelet matrices: one compressed image a shard, with access, rank and select."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.tokens import encoder
from emberframe.operators.settle import settle

#: Format, fixed values: the mark, then little-endian number of tokens, bits and documents, then one compressed
#: body of document ends (u8 each) and, from the highest bit down, each plane's ones before every BLOCK
#: bits (u4 each) and its bits (first bit lowest).
MAGIC = b"EFWM1\0\0\0"
HEAD = struct.Struct("<QII")
BLOCK = 512
#: A task closes a shard once it holds so many tokens, so its memory does not depend on its share of the rows.
SHARD_TOKENS = 1 << 21


class WaveletMatrix:
    """Bit-planes of a sequence of ids; each plane holds one bit of every id, ids being dealt zeros first between planes."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], ends: np.ndarray):
        self.n, self.planes, self.ranks, self.ends = n, planes, ranks, ends
        self.zeros = [n - self._ones(k, n) for k in range(len(planes))]

    @classmethod
    def build(cls, ids: np.ndarray, ends: np.ndarray) -> WaveletMatrix:
        """From ids (non-negative) and the end of each document among them."""
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, ranks = [], []
        for k in range(bits - 1, -1, -1):
            bit = (ids >> ids.dtype.type(k)) & ids.dtype.type(1) != 0
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8))
            ones = np.bitwise_count(packed.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
            planes.append(packed)
            ranks.append(np.concatenate(([0], np.cumsum(ones))).astype("<u4"))
            ids = np.concatenate((ids.take(np.flatnonzero(~bit)), ids.take(np.flatnonzero(bit))))
        return cls(len(bit) if bits else 0, planes, ranks, ends)

    def image(self) -> bytes:
        """The file image."""
        body = [self.ends.astype("<u8").tobytes()]
        for rank, plane in zip(self.ranks, self.planes):
            body += (rank.tobytes(), plane.tobytes())
        packed = zstandard.ZstdCompressor(level=1).compress(b"".join(body))
        return MAGIC + HEAD.pack(self.n, len(self.planes), len(self.ends)) + packed

    @classmethod
    def read(cls, image: bytes) -> WaveletMatrix:
        """From a file image; anything else is an error."""
        if image[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet image")
        n, bits, docs = HEAD.unpack_from(image, len(MAGIC))
        body = zstandard.ZstdDecompressor().decompress(image[len(MAGIC) + HEAD.size :])
        ends = np.frombuffer(body, "<u8", docs)
        at, blocks = 8 * docs, -(-n // BLOCK)
        planes, ranks = [], []
        for _ in range(bits):
            ranks.append(np.frombuffer(body, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
            planes.append(np.frombuffer(body, np.uint8, blocks * BLOCK // 8, at))
            at += blocks * BLOCK // 8
        return cls(n, planes, ranks, ends)

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        block = i // BLOCK
        out, at = int(self.ranks[k][block]), block * BLOCK // 8
        out += int(np.bitwise_count(self.planes[k][at : i // 8]).sum())
        if i % 8:
            out += (int(self.planes[k][i // 8]) & ((1 << i % 8) - 1)).bit_count()
        return out

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, i), self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the ids equal to ``token`` among the first ``end`` lie under the last plane."""
        low, high = 0, end
        if token >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._ones(k, low), self._ones(k, high)
            if token >> (len(self.planes) - 1 - k) & 1:
                low, high = self.zeros[k] + a, self.zeros[k] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` occurs before place ``end``."""
        low, high = self._range(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, number: int) -> int:
        """The place of occurrence ``number`` (from 0) of ``token``."""
        low, high = self._range(token, self.n)
        if not 0 <= number < high - low:
            raise IndexError(number)
        i = low + number
        for k in range(len(self.planes) - 1, -1, -1):
            one = i >= self.zeros[k]
            i = self._find(k, i - self.zeros[k] if one else i, one)
        return i

    def _find(self, k: int, number: int, one: bool) -> int:
        """The place of bit ``number`` (from 0) of the wanted kind in plane k."""
        rank = self.ranks[k].astype(np.int64)
        if not one:
            rank = np.arange(len(rank)) * BLOCK - rank
        block = int(np.searchsorted(rank, number, side="right")) - 1
        part = np.unpackbits(self.planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == one)[number - int(rank[block])])

    def ids(self) -> np.ndarray:
        """All ids in order: the deals between the planes are undone from the last up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~bit)] = out[: self.zeros[k]]
            up[np.flatnonzero(bit)] = out[self.zeros[k] :] | kind(1 << (len(self.planes) - 1 - k))
            out = up
        return out


def _shards(path: str, end_id: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        ids, docs, ends, n, number, kind = [], [], [], 0, 0, None

        def closed() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(ids), encode.kind)
            image = WaveletMatrix.build(whole, np.array(ends, np.uint64)).image()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([n], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(docs, kind)),
                    pa.array([image], pa.binary()),
                ],
                ["part", "shard", "n_tokens", "docs", "image"],
            )

        last = np.array([end_id], encode.kind).tobytes()
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, own in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1).to_pylist())):
                own += last
                ids.append(own)
                docs.append(doc_id)
                n += len(own) // encode.kind.itemsize
                ends.append(n)
                if n >= SHARD_TOKENS:
                    yield closed()
                    ids, docs, ends, n, number = [], [], [], 0, number + 1
        if docs:
            yield closed()

    return shards


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """(part, shard, n_tokens, docs, image): the written table of wavelet images, in ascending doc_id order.

    Every document's ids and ``end_id`` follow those of the documents before; null texts are ``end_id``
    alone, null doc_ids come first, rows that share a doc_id follow in the order of their text hash. One
    image, a file in the format above, holds whole documents up to about ``SHARD_TOKENS``. Spark's writer
    commits the images, so a lost executor costs its tasks and leaves no half file.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64("text")
    ordered = (
        docs.select("doc_id", "text", key.alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return settle(
        ordered.mapInArrow(
            _shards(tokenizer_path, end_id), f"part int, shard int, n_tokens long, docs array<{kind}>, image binary"
        )
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            matrix = WaveletMatrix.read(batch.column(2)[row].as_py())
            ids = matrix.ids().astype("<u4")
            ends = matrix.ends.astype(np.int64)
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            raw = memoryview(ids).cast("B")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(row, 1).flatten(),
                    pa.array(starts + batch.column(0)[row].as_py()),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the images.

    start is the number of ids before it over all shards: a sum over the tasks' totals and one within each
    task's shards, so neither sum runs over documents.
    """
    kind = shards.schema["docs"].dataType.elementType.simpleString()
    so_far = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    bases = totals.select("part", so_far(Window.orderBy("part")).alias("base"))
    inner = shards.select("part", "shard", so_far(Window.partitionBy("part").orderBy("shard")).alias("own"))
    placed = (
        inner.join(bases, "part")
        .select("part", "shard", (F.col("base") + F.col("own")).alias("start"))
        .join(shards.select("part", "shard", "docs", "image"), ["part", "shard"])
        .select("start", "docs", "image")
    )
    return placed.mapInArrow(_read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
