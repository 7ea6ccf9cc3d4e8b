"""Alignment of streams: positional, by frame, by interval, as-of and by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.numbers import all_reasons, limit_exceeded
from emberframe.operators.ordered import Series, last_known, row_index, scan


def positional_join(left: DataFrame, right: DataFrame, series: Series) -> DataFrame:
    """Row i of one stream with row i of the other; a side without partner stays, flagged.

    Both frames carry the series columns; the other columns must differ.
    """
    keys = list(series.keys)
    a = scan(left, series, {"row": row_index()})
    b = scan(right, series, {"row": row_index()}).drop(*series.order)
    a = a.withColumn("_in_left", F.lit(True))
    b = b.withColumn("_in_right", F.lit(True))
    both = F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull()
    joined = a.join(b, [*keys, "row"], "full")
    return joined.withColumn("matched", both).drop("_in_left", "_in_right")


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Keep the last row of each key; an aggregate, so duplicates combine map-side."""
    fields = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*fields), order)
    return df.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    fields = [c for c in df.columns if c not in keys]
    oldest = F.min_by(F.struct(*fields), order)
    return df.groupBy(*keys).agg(oldest.alias("_r")).select(*keys, "_r.*")


def frame_join(left: DataFrame, right: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Join on the frame id where the last duplicate on the right wins."""
    return left.join(last_per_key(right, keys, order), keys)


def without_invalid_actions(rows: DataFrame, events: DataFrame, action: list[str]) -> DataFrame:
    """Drop rows whose action has an ``invalid`` event."""
    bad = events.filter(F.col("event_type") == "invalid").select(*action).distinct()
    return rows.join(bad, action, "left_anti")


def interval_join(
    rows: DataFrame,
    windows: DataFrame,
    keys: list[str],
    at: str,
    *,
    start: str = "start",
    end: str = "end",
    bucket: float,
    disjoint: bool = False,
    row_id: list[str] | None = None,
    rank: str | None = None,
) -> DataFrame:
    """Attach the window with ``start <= at <= end``.

    Windows are cut into time buckets so the join is an equi join on (keys,
    bucket) that spreads a hot key over its buckets. With overlapping windows the
    one of lowest ``rank`` wins per ``row_id``; both must then be given.
    """
    if not disjoint and (row_id is None or rank is None):
        raise ValueError("overlapping windows need row_id and rank")
    tile = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("long")
    tiled = windows.withColumn("_tile", F.explode(F.sequence(tile(start), tile(end))))
    placed = rows.withColumn("_tile", tile(at))
    hit = placed.join(tiled, [*keys, "_tile"]).filter(
        (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    )
    hit = hit.drop("_tile")
    if disjoint:
        return hit
    return first_per_key(hit, [*keys, *row_id], F.col(rank))


def asof_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    at: str,
    carried: list[str],
    *,
    inclusive: bool = True,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Each left row with the newest right row at or before it (or strictly before).

    ``carried`` columns come from the right, together with ``right_<at>``. A
    union and one carry-forward pass: no pairs are formed.
    """
    mark = f"right_{at}"
    source = right.select(
        *keys, at, F.struct(F.col(at).alias(mark), *carried).alias("_seen"),
        F.lit(0 if inclusive else 2).alias("_side"),
    )
    target = left.withColumns({"_seen": F.lit(None).cast(source.schema["_seen"].dataType), "_side": F.lit(1)})
    merged = target.unionByName(source, allowMissingColumns=True)
    series = Series(tuple(keys), (at, "_side"))
    seen = scan(merged, series, {"_last": last_known(F.col("_seen"))}, rows_per_chunk=rows_per_chunk)
    return (
        seen.filter(F.col("_side") == 1)
        .select(*left.columns, "_last.*")
    )


def pairing_verdict(
    now: Column,
    first: Column,
    second: Column,
    *,
    max_first_age: float,
    max_second_age: float,
    max_skew: float,
) -> dict[str, Column]:
    """Ages, skew and the list of reasons against pairing two host-time stamps."""
    newer, older = F.greatest(first, second), F.least(first, second)
    reasons = all_reasons(
        (first.isNull() | second.isNull(), "sample_missing"),
        ((now - first < 0) | limit_exceeded(now, first, max_first_age), "first_stale"),
        ((now - second < 0) | limit_exceeded(now, second, max_second_age), "second_stale"),
        (limit_exceeded(newer, older, max_skew), "skew_exceeded"),
    )
    return {
        "first_age_s": now - first,
        "second_age_s": now - second,
        "worst_age_s": F.greatest(now - first, now - second),
        "sensor_skew_s": F.abs(first - second),
        "reasons": reasons,
    }


def stream_counts(streams: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows per key and stream, absent streams as zero, with why they disagree."""
    counted = [
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}")) for name, df in streams.items()
    ]
    joined = reduce(lambda a, b: a.join(b, keys, "full"), counted)
    names = [f"n_{name}" for name in streams]
    filled = joined.select(*keys, *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])
    reference = F.col(names[0])
    reason = F.coalesce(
        F.when(reference == 0, F.lit(f"missing_{names[0][2:]}")),
        *[F.when(F.col(n) == 0, F.lit(f"missing_{n[2:]}")) for n in names[1:]],
        *[F.when(F.col(n) != reference, F.lit(f"count_mismatch_{n[2:]}")) for n in names[1:]],
    )
    return filled.withColumn("reason", reason)


def pair_by_number(left: DataFrame, right: DataFrame, name: str, pattern: str = r"(\d+)") -> DataFrame:
    """Files of two streams that share the first number in their name; the last name wins."""

    def numbered(df: DataFrame, side: str) -> DataFrame:
        found = F.regexp_extract(name, pattern, 1)
        rows = df.filter(found != "").withColumn("number", found.cast("long"))
        fields = [c for c in df.columns]
        newest = F.max_by(F.struct(*fields), F.col(name)).alias("_r")
        grouped = rows.groupBy("number").agg(newest)
        return grouped.select("number", *[F.col(f"_r.{c}").alias(f"{side}_{c}") for c in fields])

    return numbered(left, "left").join(numbered(right, "right"), "number")


def longest_prefix(
    files: DataFrame, rules: DataFrame, name: str, *, separators: tuple[str, ...] = (".", "_")
) -> DataFrame:
    """Route names to the group of the longest rule that is the name or starts it.

    A rule matches when the name equals it or continues with a separator. Every
    candidate prefix of a name ends just before a separator (or is the whole
    name), so names are expanded to those and joined by equality.
    """
    cuts = "|".join(f"\\{s}" for s in separators)
    pieces = F.split(F.col(name), f"(?={cuts})")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, 1, i), "")
    )
    expanded = files.withColumn("_prefix", F.explode(prefixes))
    hit = expanded.join(rules.withColumnRenamed("prefix", "_prefix"), "_prefix")
    best = hit.groupBy(name).agg(
        F.max_by("group", F.struct("group_rank", F.length("_prefix"))).alias("group"),
    )
    return files.join(best, name, "left")


def artifact_kind(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return (
        F.when(suffix == ".csv", "csv")
        .when(suffix == ".png", "figures")
        .when(suffix.isin(".md", ".txt"), "reports")
        .when(suffix == ".json", "metadata")
        .otherwise("other")
    )


def routing_manifest(routed: DataFrame, name: str) -> DataFrame:
    """Per group and kind: number of files, first and last name; files of no rule are the group ``unmatched``.

    ``routed`` comes from ``longest_prefix``. The names themselves stay rows of ``routed``; a group that takes most
    files is summed before the shuffle.
    """
    group = F.coalesce("group", F.lit("unmatched"))
    return routed.groupBy(group.alias("group"), F.col("group").isNotNull().alias("matched"), artifact_kind(F.col(name)).alias("kind")).agg(
        F.count(F.lit(1)).alias("files"), F.min(name).alias("first_name"), F.max(name).alias("last_name")
    )
