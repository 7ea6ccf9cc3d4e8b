"""Exact Jaccard join of documents on word shingles, by rare-first prefix filtering."""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.components import connected_components
from emberframe.llm.words import SPACED, each_set
from emberframe.operators.settle import settle

#: Cells of the frequency table that orders shingles: a fixed 16 MB whatever the input. A cell's level is
#: the bit length of its count, 0 below FREQUENT; any such table gives the same links, only not as fast.
CELLS = 1 << 24
FREQUENT = 4
#: Parts of the suffix filter: the overlap of two sets is at most the sum over parts of the lesser count.
PARTS = 128
#: Cells of the parity filter, a multiple of PARTS: two sets differ in at least as many shingles as cells hold
#: an odd number of one and an even number of the other.
PARITY = 512
#: Bits of the filter that says which documents' whole sets are wanted: a fixed 2 MB. It lets more through
#: as it fills, and what it lets through is matched exactly afterwards.
WANTED = 1 << 24
#: Orders in which buckets choose their pivot in a round, so many different pivots a class meets at most.
PIVOTS = 8
#: Rounds of pivots go on while at least one try in so many links. Any number gives the same groups.
WORTHWHILE = 10
#: A group of linked classes is cut into blocks of about so many classes and shingles; blocks meet pairwise.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1 << 20
#: Cells of the 0/1 matrix of a block that is multiplied at once: a fixed 16 MB.
MATRIX = 1 << 22
#: A bucket is cut into blocks of about so many classes, which meet pairwise; texts that are hashed at once.
BUCKET_CLASSES, TEXTS = 2048, 512
#: First buckets of a class that go along with it, so a pair is a row in the first one it shares, not in each.
FIRST = 32


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    """Texts as UTF-8 with A-Z lowered."""
    return [None if x is None else x.lower() for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most TEXTS rows, so what a worker holds beside a batch does not grow with it."""
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield batch.slice(at, TEXTS)


def _sign(grams: np.ndarray) -> int:
    return struct.unpack("<q", hashlib.blake2b(grams.tobytes(), digest_size=8).digest())[0]


def _prefix_length(n: int, percent: int) -> int:
    """So many first shingles, in any fixed order, two linked sets cannot both avoid sharing."""
    return n - (n * percent + 99) // 100 + 1


def _ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles of a set, those of rare cells first, then by hash."""
    level = levels[(grams & np.uint64(CELLS - 1)).astype(np.int64)]
    return grams[np.argsort(level, kind="stable")]


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts) if parts else np.zeros(0, kind)))


def _members(width: int, percent: int):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, signs, cells, parts, parity = [], [], [], [], []
            for grams in each_set(_texts(batch, 1), width, SPACED):
                sizes.append(len(grams))
                signs.append(_sign(grams) if len(grams) else None)
                first = grams[: _prefix_length(len(grams), percent)] if len(grams) else grams
                cells.append((first & np.uint64(CELLS - 1)).astype(np.int32))
                held = np.bincount((grams % np.uint64(PARITY)).astype(np.int64), minlength=PARITY).astype(np.int32)
                parts.append(held.reshape(-1, PARTS).sum(axis=0, dtype=np.int32))
                parity.append(np.packbits(held & 1).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(signs, pa.int64()), _lists(cells, np.int32), _lists(parts, np.int32),
                    pa.array(parity, pa.binary()),
                ],
                ["doc_id", "n", "sign", "cells", "parts", "parity"],
            )

    return members


def _entries(width: int, percent: int, levels: Broadcast):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a class enters once a task: its copies would enter the same
        for batch in _slices(batches):
            grams_out, signs, sizes, at = [], [], [], []
            for grams in each_set(_texts(batch, 0), width, SPACED):
                if not len(grams) or (sign := _sign(grams)) in seen:
                    continue
                seen.add(sign)
                k = _prefix_length(len(grams), percent)
                grams_out.append(_ordered(grams, levels.value)[:k].view(np.int64))
                signs.append(np.full(k, sign, np.int64))
                sizes.append(np.full(k, len(grams), np.int32))
                at.append(np.arange(k, dtype=np.int32))
            columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((grams_out, np.int64), (signs, np.int64), (sizes, np.int32), (at, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["gram", "sign", "n", "at"])

    return entries


def _sets(width: int, wanted: Broadcast):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in _slices(batches):
            signs, keys, sets = [], [], []
            for key, grams in zip(batch.column(0).to_pylist(), each_set(_texts(batch, 1), width, SPACED)):
                if not len(grams):
                    continue
                sign = _sign(grams)
                cell = (sign ^ key) & (WANTED - 1)
                if bits[cell >> 3] >> (cell & 7) & 1:
                    signs.append(sign)
                    keys.append(key)
                    sets.append(grams.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signs, pa.int64()), pa.array(keys, pa.int64()), _lists(sets, np.int64)], ["sign", "key", "grams"]
            )

    return sets


def _levels(members: DataFrame) -> np.ndarray:
    """Frequency level of each cell, from the provisional prefixes of all documents; at most CELLS rows arrive."""
    counts = (
        members.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    )
    mean = members.agg(F.sum(F.size("cells"))).first()[0] or 0
    found = counts.where(F.col("n") >= 4 * mean / CELLS).toArrow()
    levels = np.zeros(CELLS, np.uint8)
    n = found.column("n").to_numpy().astype(np.float64)
    levels[found.column("cell").to_numpy()] = np.frexp(n)[1]
    return levels


def _may_link(n_a: Column, n_b: Column, at_a: Column, at_b: Column, percent: int) -> Column:
    """Length filter, and positional filter: what can still follow must reach the overlap that a link needs."""
    low, high = F.least(n_a, n_b).cast("long"), F.greatest(n_a, n_b).cast("long")
    left = F.lit(1) + F.least(n_a - at_a - 1, n_b - at_b - 1)
    return (low * 100 >= high * percent) & (left.cast("long") * (100 + percent) >= (n_a.cast("long") + n_b) * percent)


def _other(number: int, percent: int) -> Column:
    """The class of another group in its bucket that a class is tried against in a round: a pivot, else the one before it.

    Buckets order their classes by one of PIVOTS hashes, other ones each round, so a class that shares many
    buckets with its group meets several pivots, not the same one everywhere.
    """
    seed = F.pmod("gram", F.lit(PIVOTS)) + number * PIVOTS
    order = Window.partitionBy("gram").orderBy(F.xxhash64("sign", seed), "sign")

    def tried(turned: Callable[[str], Column]) -> Column:
        may = _may_link(F.col("n"), turned("n").over(order), F.col("at"), turned("at").over(order), percent)
        return F.when(may & (F.col("grp") != turned("grp").over(order)), turned("sign").over(order))

    return F.coalesce(tried(F.first), tried(F.lag))


def _candidates(percent: int):
    """Pairs of classes of different groups that share a bucket and may still link, from blocks of buckets in order.

    Rows are compared with those 1, 2, 3 ... places on in their job, all jobs of a batch at once. Length, positional and
    parity filter come before a pair is a row; a pair whose classes share an earlier bucket is left to that one.
    """

    def elsewhere(one: np.ndarray, two: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Whether the first bucket that both lists name is another one than this."""
        shared = ((one[:, :, None] == two[:, None, :]) & (one != 0)[:, :, None]).any(axis=2)
        return shared.any(axis=1) & (one[np.arange(len(one)), shared.argmax(axis=1)] != gram)

    def pairs_of(rows: dict[str, np.ndarray]) -> np.ndarray:
        job = (rows[c] for c in ("gram", "one", "two", "sign"))
        again = np.logical_and.reduce([x[1:] == x[:-1] for x in job])  # copies of a class in other tasks
        rows = {c: x[np.concatenate(([True], ~again))] for c, x in rows.items()}
        gram, one, two, block, sign, n, at, grp, parity, first = rows.values()
        kept, left, d = [np.zeros((0, 2), np.int64)], np.arange(len(gram)), 0
        while True:
            d += 1
            left = left[left + d < len(gram)]
            to = left + d
            here = (gram[left] == gram[to]) & (one[left] == one[to]) & (two[left] == two[to])
            left, to = left[here], to[here]
            if not len(left):
                break
            may = (grp[left] != grp[to]) & (sign[left] != sign[to]) & ((block[left] != block[to]) | (one[left] == two[left]))
            a, b = left[may], to[may]
            low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            follow = 1 + np.minimum(n[a] - at[a] - 1, n[b] - at[b] - 1)
            may = (low * 100 >= high * percent) & (follow * (100 + percent) >= (n[a] + n[b]) * percent)
            a, b = a[may], b[may]
            differ = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
            may = (n[a] + n[b] - differ) * (100 + percent) >= 2 * (n[a] + n[b]) * percent
            a, b = a[may], b[may]
            may = ~elsewhere(first[a], first[b], gram[a])
            a, b = sign[a[may]], sign[b[may]]
            kept.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))
        return np.unique(np.concatenate(kept), axis=0)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def out(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            found = pairs_of(rows)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "one", "two", "block", "sign", "n", "at", "grp")}
            rows |= {c: rows[c].astype(np.int64) for c in ("n", "at")}
            rows["parity"] = np.frombuffer(b"".join(batch.column("parity").to_pylist()), np.uint64).reshape(len(batch), -1)
            lists = batch.column("first")
            rows["first"] = np.zeros((len(batch), FIRST), np.int64)
            rows["first"][np.arange(FIRST) < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy()
            if held is not None:
                rows = {c: np.concatenate((held[c], x)) for c, x in rows.items()}
            last = (rows["gram"] == rows["gram"][-1]) & (rows["one"] == rows["one"][-1]) & (rows["two"] == rows["two"][-1])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0  # the last job may go on
            if cut:
                yield out({c: x[:cut] for c, x in rows.items()})
            held = {c: x[cut:].copy() for c, x in rows.items()}
        if held is not None:
            yield out(held)

    return candidates


def _across(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes of different groups that share one of these buckets, without those that filters rule out.

    A bucket is cut by hash into blocks, and each pair of blocks is one job, so a hot bucket is many even jobs and only
    the pairs that pass the filters are rows.
    """
    first = buckets.groupBy("sign").agg(F.array_sort(F.collect_set(F.struct("at", "gram")))["gram"].alias("first"))
    sizes = buckets.groupBy("gram").agg(F.ceil(F.count("*") / BUCKET_CLASSES).cast("int").alias("blocks"))
    placed = (
        buckets.select("gram", "sign", "n", "at", "grp")
        .join(classes.select("sign", "parity").join(first.select("sign", F.slice("first", 1, FIRST).alias("first")), "sign"), "sign")
        .join(sizes, "gram")
        .withColumn("block", F.pmod(F.xxhash64("sign"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    jobs = (
        placed.select("gram", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "sign", "n", "at", "grp", "parity", "first")
        .repartition("gram", "one", "two")
        .sortWithinPartitions("gram", "one", "two", "sign")
    )
    return jobs.mapInArrow(_candidates(percent), "a long, b long").distinct()


def _shared(sets: list[np.ndarray], second: int) -> np.ndarray:
    """Shared shingles of each set before ``second`` with each set from there on; of all with all if it is 0."""
    lengths = [len(x) for x in sets]
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    split = second or len(sets)
    out = np.zeros((split, len(sets) - second), np.int64)
    width = max(1, MATRIX // len(sets))
    for low in range(0, len(names), width):
        part = slice(*np.searchsorted(at, (low, low + width)))
        held = np.zeros((len(sets), min(width, len(names) - low)), np.float32)
        held[row[part], at[part] - low] = 1
        out += (held[:split] @ held[second:].T).astype(np.int64)
    return out


def _degrees(percent: int):
    """Links of each class within its job: the pairs of one block, or those between two."""

    def of_job(one: int, two: int, rows: dict[int, tuple[int, np.ndarray]]) -> tuple[list[int], np.ndarray]:
        signs = sorted(rows, key=lambda s: rows[s][0] != one)
        sets = [rows[s][1] for s in signs]
        second = sum(rows[s][0] == one for s in signs) if one != two else 0
        if one != two and not 0 < second < len(signs):
            return [], np.zeros(0, np.int64)
        n = np.array([len(x) for x in sets], np.int64)
        shared = _shared(sets, second)
        split = second or len(sets)
        linked = shared * 100 >= (n[:split, None] + n[None, second:] - shared) * percent
        if one != two:
            return signs, np.concatenate([linked.sum(1), linked.sum(0)])
        np.fill_diagonal(linked, False)
        return signs, linked.sum(1)

    def degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, rows = None, {}

        def out() -> pa.RecordBatch:
            signs, links = of_job(job[1], job[2], rows)
            return pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), pa.array(links, pa.int64())], ["sign", "links"])

        for batch in batches:
            grp, one, two, block, sign = (batch.column(k).to_pylist() for k in range(5))
            sets = batch.column(5)
            values, bounds = sets.values.to_numpy(), sets.offsets.to_numpy()
            for k in range(len(batch)):
                if (grp[k], one[k], two[k]) != job:
                    if rows:
                        yield out()
                    job, rows = (grp[k], one[k], two[k]), {}
                rows[sign[k]] = block[k], values[bounds[k] : bounds[k + 1]].copy()  # rows that repeat a class are one
        if rows:
            yield out()

    return degrees


def _links(docs: DataFrame, classes: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """(sign, links) of the classes of groups of two or more, every pair within a group counted on the whole sets.

    Groups are complete, so no link leaves one. A group of two is one link. A larger one is cut by hash into blocks, and
    each pair of blocks is one job with both blocks' sets at hand, so a hot group is many even jobs and no pair is a row.
    """
    grouped = classes.join(groups.select(F.col("node").alias("sign"), F.col("component").alias("grp")), "sign").select("sign", "key", "n", "grp")
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_CLASSES, F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = settle(
        grouped.join(sizes, "grp").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sign"), "blocks").cast("int"))
    )
    two = placed.where("m = 2").select("sign", F.lit(1).cast("long").alias("links"))
    larger = placed.where("m > 2").select("sign", "key", "grp", "block", "blocks")
    sets = _whole_sets(docs, larger.select("sign", "key"), width)
    if sets is None:
        return two
    jobs = (
        larger.join(sets, ["sign", "key"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("grp", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "sign", "grams")
        .repartition("grp", "one", "two")
        .sortWithinPartitions("grp", "one", "two")
    )
    counted = jobs.mapInArrow(_degrees(percent), "sign long, links long").groupBy("sign").agg(F.sum("links").alias("links"))
    return two.union(counted)


def _whole_sets(docs: DataFrame, ends: DataFrame, width: int) -> DataFrame | None:
    """The written (sign, key, grams) of those classes, and some more, from the texts of one document each; None of none.

    A filter of fixed size finds the documents without a join on texts.
    """
    cells = ends.select(F.col("sign").bitwiseXOR(F.col("key")).bitwiseAND(WANTED - 1).cast("int").alias("cell")).distinct().toArrow()
    bits = np.zeros(WANTED, bool)
    bits[cells.column(0).to_numpy()] = True
    if not bits.any():
        return None
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
    return settle(
        docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(_sets(width, wanted), "sign long, key long, grams array<long>")
    )


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The written (a, b) of those pairs of classes whose sets meet the similarity.

    The suffix filter on part counts comes first. The whole sets of the classes in what is left are made
    anew.
    """
    side = lambda c: classes.select(*(F.col(x).alias(f"{x}_{c}") for x in ("sign", "key", "n", "parts")))
    near = settle(
        pairs.join(side("a"), F.col("a") == F.col("sign_a"))
        .join(side("b"), F.col("b") == F.col("sign_b"))
        .where(
            F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x).cast("long")
            * (100 + percent)
            >= (F.col("n_a") + F.col("n_b")) * percent
        )
        .select("a", "key_a", "b", "key_b")
    )
    sets = _whole_sets(docs, near.select(F.col("a").alias("sign"), F.col("key_a").alias("key")).union(near.select("b", "key_b")), width)
    if sets is None:
        return near.select("a", "b")
    both = near.join(sets.toDF("a", "key_a", "grams_a"), ["a", "key_a"]).join(sets.toDF("b", "key_b", "grams_b"), ["b", "key_b"])
    shared = F.size(F.array_intersect("grams_a", "grams_b")).cast("long")
    return settle(
        both.select("a", "b", (F.size("grams_a").cast("long") + F.size("grams_b")).alias("n"), shared.alias("shared"))
        .where(f"shared * 100 >= (n - shared) * {percent}")
        .select("a", "b")
        .distinct()
    )


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document under Jaccard links of shingle sets.

    Two documents link when 100 * shared >= percent * united distinct shingles of ``width`` words (A-Z
    lowered, split at white space). Fewer words are one shingle; without words or text a document has no
    shingle and no link. component_id is the smallest doc_id reachable; a null doc_id is in no order and
    never names a group unless alone in it. n_links counts the other classes that a document's class links
    to, all of them, each verified on the whole sets. Rows repeat as they come; other columns are ignored; an empty
    table gives an empty result. Without ``count_links`` the groups are the same and n_links is left out, for callers
    that only keep one document a group.

    Documents with equal sets are one class. Classes meet in buckets of their prefix shingles, rare cells
    first. In each bucket every class is tried against one pivot of another group, in linear number; groups
    found so far are contracted, and rounds with other pivots follow while they find links often enough.
    Then only classes of different groups that still share a bucket are tried against each other, the buckets'
    blocks meeting in tasks (see ``_across``). So no link between groups is lost, and every link lies within a group. The links are counted last: in groups of
    more than two classes every pair is verified, blocks of classes meeting as matrices (see ``_links``).
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    members = settle(
        docs.select("doc_id", "text").mapInArrow(_members(width, percent), f"doc_id {kind}, n long, sign long, cells array<int>, parts array<int>, parity binary")
    )
    classes = settle(
        members.where("sign is not null")
        .groupBy("sign")
        .agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("parts").alias("parts"), F.first("parity").alias("parity"))
        .withColumn("key", F.xxhash64("low"))
    )
    levels = spark.sparkContext.broadcast(_levels(members))
    entries = docs.select("text").mapInArrow(_entries(width, percent, levels), "gram long, sign long, n int, at int")
    any_order = Window.partitionBy("gram").orderBy("sign")
    beside = F.coalesce(F.lag("sign").over(any_order), F.lead("sign").over(any_order))
    buckets = open_ = settle(
        entries.select("*", F.col("sign").alias("grp"), beside.alias("beside"))
        .where("beside is not null")
        .select("gram", "sign", "n", "at", "grp", _other(0, percent).alias("other"))
    )
    links = first = None
    for number in itertools.count(1):
        tries = (
            open_.where("other <> sign").select(F.least("sign", "other").alias("a"), F.greatest("sign", "other").alias("b")).distinct()
        )
        tries = settle(tries if first is None else tries.join(first, ["a", "b"], "left_anti"))
        found = _verified(docs, tries, classes, width, percent)
        first, links = (tries, found) if first is None else (first.union(tries), links.union(found))
        groups = connected_components(links)
        named = buckets.select("gram", "sign", "n", "at").join(
            groups.select(F.col("node").alias("sign"), "component"), "sign", "left"
        ).select("gram", "sign", "n", "at", F.coalesce("component", "sign").alias("grp"))
        split = named.groupBy("gram").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("gram")
        open_ = settle(named.join(split, "gram", "left_semi").select("*", _other(number, percent).alias("other")))
        if found.count() * WORTHWHILE <= tries.count():
            break
    rest = _across(open_, classes, percent).join(first, ["a", "b"], "left_anti")
    more = _verified(docs, rest, classes, width, percent)
    every = links.union(more)
    groups = settle(connected_components(every))
    classes = classes.join(groups.select(F.col("node").alias("sign"), "component"), "sign", "left")
    if count_links:
        classes = classes.join(_links(docs, classes, groups, width, percent), "sign", "left")
    else:
        classes = classes.withColumn("links", F.lit(0))
    classes = classes.select("sign", "low", F.coalesce("component", "sign").alias("grp"), F.coalesce("links", F.lit(0)).alias("links"))
    lowest = classes.groupBy("grp").agg(F.min("low").alias("component_id"))
    named_classes = classes.join(lowest, "grp").select("sign", "component_id", "links")
    found = members.select("doc_id", "n", "sign").join(named_classes, "sign", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )
    return found if count_links else found.drop("n_links")
