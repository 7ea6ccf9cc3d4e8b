"""Exact substring dedup by a distributed difference-cover comparison of suffixes.

Suffixes at places 1 and 2 modulo 3 (the cover) are named by triples of names, five times over, so that a name
stands for 243 bytes and two overlapping names for COVERED bytes. All names meet in sorted order; suffixes with
equal names are neighbours there, and only what is left of the 400 bytes, at most 2 bytes before and 4 after,
is compared. Any two places reach the cover together within 2 steps, so the places between the sampled ones
are decided by the same comparison. Names are 64-bit fingerprints of triples, not ranks: equal prefixes are
adjacent all the same, and a level of names costs no pass over the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.words import STEP, _powers, mixed
from emberframe.operators.settle import settle

#: Length of a string that counts as repeated; what two names together stand for.
SPAN, COVERED = 400, 396
#: An anchor is a GRAM-byte string with the least hash of the REACH that a SPAN-byte string holds.
GRAM = 200
REACH = SPAN - GRAM + 1
#: The filter of repeated anchors: bits for each of them, bits that each sets, and the distance of those in its hash.
#: It grows with them up to MOST bits (128 MB) and lets more places through as it fills beyond that, never fewer.
BITS, SETS, APART, LEAST, MOST = 16, 4, 9, 1 << 20, 1 << 30
#: Bits of the filter that Spark gathers in one row.
ROW = 1 << 15
#: Places sampled for each anchor: of 202 places two hold an anchor, on average, and two in three are sampled.
SAMPLED = 67
#: Records that a bucket of the sort holds at most, about, a task holding one at a time; texts that make a block, in
#: bytes; rows that are cut at once.
BUCKET, BLOCK, ROWS = 500_000, 3 << 20, 512
#: Bits of a name that choose its bucket: 8 at least, so that NAME bytes hold the others.
FEWEST, MANY, NAME = 8, 15, 7
#: Bytes of a record that are left to compare; they are packed plane by plane, since text packs well and names don't.
REST, CODEC = 7, "zstd"
KNOWN = 65535


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest value of every window, from running values within and across cuts of that width."""
    f, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    size = -(-len(x) // width) * width
    rows = np.concatenate((x, np.full(size - len(x), fill, np.uint64))).reshape(-1, width)
    ahead = f.accumulate(rows, axis=1).ravel()
    back = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: len(x) - width + 1], ahead[width - 1 : len(x)])


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of every GRAM bytes of one text."""
    values, powers, inverses = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
    return mixed((sums[GRAM:] - sums[:-GRAM]) * inverses[: len(data) - GRAM + 1])


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: every SPAN-byte string holds one, chosen by that string alone."""
    h = _grams(data)
    least = _slide(h, REACH, True)
    edge = np.zeros(REACH - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((edge, least, edge)), REACH, False) == h)
    return at, h[at]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """(md5, bytes) of the distinct long enough texts of a task: a copy of one has nothing to add."""
    seen: set[bytes] = set()
    for batch in batches:
        column = batch.column(0).cast(pa.binary())
        for row in range(len(column)):
            raw = column[row].as_py()
            if raw is None or len(raw) < SPAN:
                continue
            mark = hashlib.md5(raw).digest()
            if mark not in seen:
                seen.add(mark)
                yield mark, raw


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    for _, raw in _texts(batches):
        held.append(_anchors(np.frombuffer(raw, np.uint8))[1])
        size += len(held[-1])
        if size > 500_000:
            yield rows()
            held, size = [], 0
    if held:
        yield rows()


def _names(data: np.ndarray) -> np.ndarray:
    """Name of the COVERED bytes from each place: triples of bytes, then triples of names, then two that overlap."""
    name, reach = mixed(data.astype(np.uint64) + np.uint64(1)), 1
    for _ in range(5):
        n = len(name) - 2 * reach
        name = mixed((name[:n] * STEP + name[reach : reach + n]) * STEP + name[2 * reach : 2 * reach + n])
        reach *= 3
    gap = COVERED - reach
    return mixed(name[:-gap] * STEP + name[gap:])


def _known(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the filter has all bits of each hash; it has them for every repeated one."""
    found = np.ones(len(h), bool)
    for k in range(SETS):
        cell = ((h >> np.uint64(APART * k)) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
        found &= bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 != 0
    return found


def _filter(repeated: DataFrame, cells: int) -> np.ndarray:
    """The filter of the hashes h, gathered by Spark: nothing but its bits comes to the driver."""
    own = F.array(*[F.shiftrightunsigned("h", APART * k).bitwiseAND(F.lit(cells - 1)) for k in range(SETS)])
    cell = repeated.select(F.explode(own).alias("cell"))
    rows = (
        cell.select((F.col("cell") / ROW).cast("int").alias("row"), F.col("cell").bitwiseAND(F.lit(ROW - 1)).alias("bit"))
        .repartition("row").groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    )
    bits = np.zeros((cells // ROW, ROW // 8), np.uint8)
    for row, own_bits in zip(rows.column("row").to_pylist(), rows.column("bits")):
        bits[row] = np.frombuffer(own_bits.as_buffer(), np.uint8)
    return bits.ravel()


def _records(raw: bytes, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled places of a text that may begin a repeat or follow its beginning, their names, and what is left to compare.

    The rest of a record: 2 bytes before, 4 after the covered ones, and which of the three starts fit the text.
    """
    data = np.frombuffer(raw, np.uint8)
    at, h = _anchors(data)
    at = at[_known(h, bits)]
    starts = len(data) - SPAN + 1
    turns = np.zeros(starts + 1, np.int32)
    np.add.at(turns, np.clip(at - REACH + 1, 0, starts), 1)
    np.add.at(turns, np.clip(at + 1, 0, starts), -1)
    may = np.cumsum(turns)[:starts] > 0
    near = np.zeros(starts + 2, bool)
    for d in range(3):
        near[d : d + starts] |= may
    s = np.flatnonzero(near)
    s = s[s % 3 != 0]
    if not len(s):
        return s, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.concatenate((np.zeros(2, np.uint8), data, np.zeros(4, np.uint8))).astype(np.uint64)
    rest = np.zeros(len(s), np.uint64)
    for k in (0, 1, COVERED + 2, COVERED + 3, COVERED + 4, COVERED + 5):
        rest = rest << np.uint64(8) | padded[np.minimum(s + k, len(padded) - 1)]
    for d in range(3):
        fits = (s - d >= 0) & (s - d < starts)
        rest |= fits.astype(np.uint64) << np.uint64(48 + d)
    return s, _names(data)[s], rest


def _blocks(batches: Iterator[pa.RecordBatch], bits: np.ndarray, chosen: int) -> Iterator[tuple]:
    """(block, md5s, sampled places, names, rests, buckets) for each block of a task's texts, the same whenever run."""
    part, number = TaskContext.get().partitionId(), 0
    marks, found, size = [], [], 0

    def block():
        places = [f[0].astype(np.int32) for f in found]
        names, rests = (np.concatenate([f[k] for f in found]) for k in (1, 2))
        found.clear()
        to = (names >> np.uint64(64 - chosen)).astype(np.uint16)
        both = mixed(names ^ rests * STEP)
        order = np.argsort(both, kind="stable")
        again = np.zeros(len(both), bool)
        again[order[1:]] = both[order[1:]] == both[order[:-1]]
        first = order[:-1][again[order[1:]] & ~again[order[:-1]]] if len(order) else order
        return f"{part}-{number}", marks, places, names, rests, to, again, first

    for mark, raw in _texts(batches):
        own = _records(raw, bits)
        if len(own[0]):
            marks.append(mark)
            found.append(own)
            size += len(raw)
        if size > BLOCK:
            yield block()
            marks, found, size, number = [], [], 0, number + 1
    if found:
        yield block()


def _meta(wanted: Broadcast, chosen: int):
    """A row a block: its texts, their sampled places as runs, and the bucket that each record goes to.

    A record seen before in its block goes nowhere (KNOWN): it and the first such one are repeats already.
    """

    def row(name, marks, places, _names, _rests, to, again, first) -> pa.RecordBatch:
        sent = np.where(again, KNOWN, to).astype("<u2")
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name]),
                pa.array([b"".join(marks)], pa.binary()),
                pa.array([np.array([len(p) for p in places], "<u4").tobytes()], pa.binary()),
                pa.array([np.diff(np.concatenate(places), prepend=0).astype("<i4").tobytes()], pa.binary()),
                pa.array([sent.tobytes()], pa.binary()),
                pa.array([first.astype("<u4").tobytes()], pa.binary()),
                pa.array([len(sent)], pa.int64()),
            ],
            ["block", "marks", "counts", "places", "sent", "first", "n"],
        )

    # mapped, so that nothing of a block is held while the next one is made
    return lambda batches: map(lambda block: row(*block), _blocks(batches, wanted.value, chosen))


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of 64-bit values, a row each."""
    return np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width])


def _payload(wanted: Broadcast, chosen: int):
    def rows(name, _marks, _places, names, rests, to, again, _first) -> pa.RecordBatch:
        go = np.flatnonzero(~again)
        go = go[np.argsort(to[go], kind="stable")]
        cuts = np.flatnonzero(np.diff(to[go])) + 1
        which = to[go][np.concatenate(([0], cuts))]
        left = np.split(_packed(rests[go], REST), cuts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(which)),
                pa.array(which.astype(np.int32)),
                pa.array([x.tobytes() for x in np.split(_packed(names[go], NAME), cuts)], pa.binary()),
                pa.array([pa.compress(np.ascontiguousarray(x.T), CODEC, asbytes=True) for x in left], pa.binary()),
            ],
            ["block", "bucket", "names", "rests"],
        )

    return lambda batches: map(lambda block: rows(*block), _blocks(batches, wanted.value, chosen))


def _repeats(names: np.ndarray, rests: np.ndarray) -> np.ndarray:
    """Three bits a record: whether the SPAN bytes from 0, 1 and 2 places before it begin anywhere else among them."""
    flags = np.zeros(len(names), np.uint8)
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    shared = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(order) else order
    for d in range(3):
        fits = shared[rests[shared] >> np.uint64(48 + d) & np.uint64(1) != 0]
        left = (rests[fits] >> np.uint64(8 * d)) & np.uint64(2**32 - 1)
        order = np.lexsort((left, names[fits]))
        n, w = names[fits][order], left[order]
        same = (n[1:] == n[:-1]) & (w[1:] == w[:-1])
        hit = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(order) else np.zeros(0, bool)
        flags[fits[order[hit]]] |= 1 << d
    return flags


def _sorted(table: pa.Table) -> pa.Table:
    """One bucket: all records in the order of their names, and each block's answers in the order it sent them."""
    parts = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, NAME) for x in table.column("names")]  # no copies
    ends = np.cumsum([len(p) for p in parts])
    names, rests = np.zeros((ends[-1], 8), np.uint8), np.zeros((ends[-1], 8), np.uint8)
    for part, end, x in zip(parts, ends, table.column("rests")):
        left = pa.decompress(x.as_buffer(), REST * len(part), CODEC)
        names[end - len(part) : end, :NAME] = part
        rests[end - len(part) : end, :REST] = np.frombuffer(left, np.uint8).reshape(REST, -1).T
    flags = _repeats(names.view("<u8").ravel(), rests.view("<u8").ravel())
    answers = [x.tobytes() for x in np.split(flags, ends[:-1])]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "flags": pa.array(answers, pa.binary())})


def _answered(meta: pa.Table, answers: pa.Table) -> pa.Table:
    """Removed runs of each text of a block."""
    row = meta.to_pylist()[0]
    sent = np.frombuffer(row["sent"], "<u2")
    flags = np.zeros(len(sent), np.uint8)
    back = {b: np.frombuffer(f, np.uint8) for b, f in zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist())}
    go = np.flatnonzero(sent != KNOWN)
    order = go[np.argsort(sent[go], kind="stable")]
    if len(order):
        flags[order] = np.concatenate([back[b] for b in sorted(back)])
    flags[sent == KNOWN] = 7
    flags[np.frombuffer(row["first"], "<u4")] = 7
    counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
    places = np.cumsum(np.frombuffer(row["places"], "<i4").astype(np.int64))
    marks, runs, ends = [], [], np.cumsum(counts)
    for k, (a, b) in enumerate(zip(ends - counts, ends)):
        at, own = places[a:b], flags[a:b]
        starts = np.unique(np.concatenate([at[own >> d & 1 != 0] - d for d in range(3)]))
        starts = starts[starts >= 0]
        if not len(starts):
            continue
        new = np.concatenate(([True], starts[1:] > starts[:-1] + SPAN))
        last = np.concatenate((new[1:], [True]))
        marks.append(row["marks"][16 * k : 16 * k + 16].hex())
        runs.append(np.stack((starts[new], starts[last] + SPAN), axis=1).ravel().tolist())
    return pa.table({"mark": pa.array(marks, pa.string()), "runs": pa.array(runs, pa.list_(pa.int64()))})


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        column = batch.column(1).cast(pa.binary())
        for row, (copies, runs) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            raw = column[row].as_py() or b""
            if len(raw) >= SPAN and (copies or 0) > 1:
                runs = [0, len(raw)]
            runs = [min(x, len(raw)) for x in runs or []]
            cut = [0, *runs, len(raw)]
            left = b"".join(raw[a:b] for a, b in zip(cut[::2], cut[1::2]))
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(left))
            n_spans.append(len(runs) // 2)
            kept.append(left)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def drop_repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: its UTF-8 bytes without those in repeated strings.

    A byte goes if a string of SPAN bytes over it begins anywhere else, in the same text or another; strings
    are judged on the input. kept is binary, since a cut may fall inside a sign. Null texts are empty; repeated
    rows are copies of each other and so lose all if they have SPAN bytes; other columns are ignored; an empty
    table gives an empty result.

    Copies of whole texts are counted by digest and lose everything, and enter the comparison once a task.
    What can begin a repeat is narrowed by anchors: every SPAN-byte string holds one that depends on that
    string alone, so a string that comes twice has an anchor that comes twice. Records go to buckets by name,
    packed by block; one that repeats within its block is settled there, so no name brings more than one
    record a block to its bucket. Answers are three bits a record.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    anchors = texts.mapInArrow(_anchor_rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = settle(anchors)
    distinct, found = repeated.agg(F.count("h"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = _filter(repeated, min(MOST, max(LEAST, 1 << (BITS * distinct).bit_length())))
    wanted = spark.sparkContext.broadcast(bits)
    mark = F.md5(F.coalesce("text", F.lit("")))
    total = (docs.select(F.sum(F.octet_length("text"))).first()[0] or 0) * 2 // 3
    chosen = min(MANY, max(FEWEST, (min(total, SAMPLED * found) // BUCKET).bit_length()))
    meta = settle(
        texts.mapInArrow(
            _meta(wanted, chosen), "block string, marks binary, counts binary, places binary, sent binary, first binary, n long"
        )
    )
    answers = settle(
        texts.mapInArrow(_payload(wanted, chosen), "block string, bucket int, names binary, rests binary")
        .groupBy("bucket")
        .applyInArrow(_sorted, "block string, bucket int, flags binary")
    )
    runs = (
        meta.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda m, a: _answered(m, a), "mark string, runs array<long>")
    )
    copies = docs.select(mark.alias("mark")).groupBy("mark").agg(F.count("*").alias("copies"))
    single = copies.join(runs, "mark", "left").where("copies > 1 or runs is not null").select("mark", "copies", "runs").groupBy("mark").agg(
        F.max("copies").alias("copies"), F.first("runs").alias("runs")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text", mark.alias("mark"))
        .join(single, "mark", "left")
        .select("doc_id", "text", "copies", "runs")
        .mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    )
