"""Identifiers, label strings, paths and region texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def unicode_slug(text: Column) -> Column:
    """Like ``slug`` but keeps letters and digits of every script."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""
    )


def repetition_tag(rep: Column) -> Column:
    return F.format_string("rep%02d", rep.cast("int"))


def trial_identifier(*parts: Column, rep: Column, warmed: Column | None = None) -> Column:
    """``part_part_repNN`` with ``_warmed`` appended for warmed trials."""
    base = F.concat_ws("_", *[slug(p) for p in parts], repetition_tag(rep))
    if warmed is None:
        return base
    return F.when(warmed, F.concat(base, F.lit("_warmed"))).otherwise(base)


def repetition_number(stored: Column, identifier: Column) -> Column:
    """The stored repetition, else the digits after a trailing ``_rep``."""
    found = F.regexp_extract(identifier, r"_rep(\d+)$", 1)
    return F.coalesce(stored, F.when(found != "", found).try_cast("int"))


def safe_relative_path(path: Column) -> Column:
    """True for a relative path that cannot leave its root."""
    return F.coalesce(
        (path != "")
        & ~path.rlike("^/")
        & ~path.rlike(r"(^|/)\.\.(/|$)")
        & ~path.contains("\\"),
        F.lit(False),
    )


def parse_region(text: Column) -> Column:
    """``x,y,w,h`` text to a struct; null unless four integers with positive size."""
    parts = F.split(text, ",")
    number = [F.trim(F.get(parts, i)).try_cast("int") for i in range(4)]
    good = (F.size(parts) == 4) & (number[0] >= 0) & (number[1] >= 0)
    good = good & (number[2] > 0) & (number[3] > 0)
    names = ("x", "y", "width", "height")
    return F.when(good, F.struct(*[n.alias(name) for n, name in zip(number, names)]))


def format_region(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in (x, y, width, height)])


def labelled_values(label: Column, value: Column) -> Column:
    """Aggregate: ``label:0.123;label:0.456`` ordered by label.

    For roll-ups with a few labels per group (repetitions of one study).
    """
    entry = F.struct(label.alias("label"), value.alias("value"))
    pairs = F.array_sort(F.collect_list(entry))
    return F.array_join(
        F.transform(pairs, lambda p: F.format_string("%s:%.3f", p["label"], p["value"])), ";"
    )


def parse_labelled_values(text: Column) -> Column:
    """The inverse of ``labelled_values``: array of (label, value), bad numbers null."""
    parts = F.filter(F.split(text, ";"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.substring_index(p, ":", 1).alias("label"),
            F.substring_index(p, ":", -1).try_cast("double").alias("value"),
        ),
    )
