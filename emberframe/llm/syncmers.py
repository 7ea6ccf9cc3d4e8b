"""Document fingerprints from closed syncmers, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.settle import settle

#: Units are words between white space; a word of more than LONG characters is all its runs of GRAM characters
#: instead. A k-mer is K units, its inner substrings are INNER units.
K, INNER = 4, 2
LONG, GRAM = 16, 8
#: Matches one unit at a time: a short word, or one character of a long word with the gram that begins there.
_SHORT = rf"(?<!\S)\S{{1,{LONG}}}(?!\S)"
_UNIT = rf"(?=({_SHORT}|\S{{{GRAM}}}))(?:{_SHORT}|\S)"
#: Texts with so few anchors or fewer are compared by hashes alone: too few to be lined up.
FEW = 3


def _let(value: Column, use) -> Column:
    """``use`` over a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def units(text: Column) -> Column:
    """The words of a text, in order; long ones, such as text written without spaces, as overlapping grams."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return F.when(text.rlike(rf"\S{{{LONG + 1}}}"), F.regexp_extract_all(text, F.lit(_UNIT), F.lit(1))).otherwise(words)


def anchors(text: Column) -> Column:
    """Array of (hash, place) of all closed syncmers of a whole text, by place.

    A k-mer is chosen if the smallest of its inner substrings (by hash) is its first or its last, which no
    text around it can change. place is the number of the unit it begins at; one that comes again has every
    place. The anchors of a text of fewer than K units are its units; without units there is none.
    """

    def chosen(w: Column) -> Column:
        inner = F.zip_with(
            F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
            F.slice(w, 2, F.greatest(F.size(w), F.lit(1))),
            lambda a, b: F.xxhash64(a, b),
        )

        def picked(h: Column) -> Column:
            n = F.greatest(F.size(h) - 2, F.lit(0))
            mers = F.transform(
                F.arrays_zip(
                    F.slice(h, 1, n).alias("first"), F.slice(h, 2, n).alias("middle"), F.slice(h, 3, F.greatest(n, F.lit(1))).alias("last")
                ),
                lambda z, i: F.struct(
                    F.when(
                        ~((z["middle"] < z["first"]) & (z["middle"] < z["last"])), F.xxhash64(z["first"], z["last"])
                    ).alias("hash"),
                    i.alias("place"),
                ),
            )
            return F.filter(mers, lambda m: m["hash"].isNotNull())

        few = F.transform(w, lambda x, i: F.struct(F.xxhash64(x).alias("hash"), i.alias("place")))
        return F.when(F.size(w) < K, few).otherwise(_let(inner, picked))

    return _let(units(text), chosen)


def fingerprint(found: Column) -> Column:
    """Anchors as text: place-hash by place, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws("-", x["place"], F.lower(F.hex(x["hash"])))), ",")


def _lined_up(found: Column) -> Column:
    """A hash for each two anchors side by side: both hashes and the offset between their places."""
    n = F.greatest(F.size(found) - 1, F.lit(0))
    return F.zip_with(
        F.slice(found, 1, n), F.slice(found, 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a["hash"], b["hash"], b["place"] - a["place"])
    )


def likeness(one: Column, two: Column) -> Column:
    """Jaccard of all anchors of both sides, lined up by offset, each as often as it comes; 1 if both are empty.

    Two anchors side by side count as shared if the other side has the same two side by side at the same
    offset from each other, so both lie at one offset between the texts, wherever that is. If a side has at most
    FEW anchors, the hashes of both are compared without places.
    """

    def shared(a: Column, b: Column) -> Column:
        side = lambda x, bit: F.transform(x, lambda h: h.bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.lit(bit).cast("long")))
        key = lambda x: x.bitwiseAND(F.lit(-2).cast("long"))

        def step(s: Column, x: Column) -> Column:
            # of equal keys the first side's come first: left are those without a partner yet
            same, first = key(x) == s["key"], x.bitwiseAND(F.lit(1).cast("long")) == 0
            left = F.when(same, s["left"]).otherwise(0)
            return F.struct(
                key(x).alias("key"),
                F.when(first, left + 1).otherwise(F.greatest(left - 1, F.lit(0))).alias("left"),
                F.when(~first & (left > 0), s["both"] + 1).otherwise(s["both"]).alias("both"),
            )

        start = F.struct(F.lit(1).cast("long").alias("key"), F.lit(0).alias("left"), F.lit(0).alias("both"))  # no key is odd
        both = F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, step, lambda s: s["both"])
        return _let(both, lambda n: n / (F.size(a) + F.size(b) - n))

    hashes = lambda c: F.transform(c, lambda x: x["hash"])
    compared = F.when(F.least(F.size(one), F.size(two)) <= FEW, F.struct(hashes(one).alias("a"), hashes(two).alias("b"))).otherwise(
        F.struct(_lined_up(one).alias("a"), _lined_up(two).alias("b"))
    )
    return F.when(F.greatest(F.size(one), F.size(two)) == 0, 1.0).otherwise(_let(compared, lambda c: shared(c["a"], c["b"])))


#: Bytes of text that a range of doc_ids holds, about, and most ranges; beyond, ranges grow and their sorts spill.
RANGE, RANGES = 16 << 20, 20_000


def ranges(docs: DataFrame) -> DataFrame:
    """docs with range: the number of the doc_id's range, ascending; equal ids share one, null ids are in range 0."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(int(size // RANGE) + 1, RANGES)
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    bounds = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<double>")
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))))
    return docs.withColumn("range", at.cast("int"))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document, in descending doc_id.

    The edited text has its last third of code points replaced by the first as many (or all) of the next
    document's text. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts are empty. Rows that share a doc_id have one place in the order, and the one with
    the smallest text hash stands for it as the next; every row is returned. A null doc_id is below all
    others. Other columns are ignored; an empty table gives an empty result; a single document is its own next.

    Texts are shuffled once, to their range of doc_ids, and in order there; the next document is the row
    before. One row a range crosses to the range above, found by the ranges' own table.
    """
    rows = ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    tops = settle(
        rows.groupBy("range").agg(
            F.max_by(F.struct("doc_id", "text"), F.struct(F.col("doc_id").isNotNull(), "doc_id", -(F.xxhash64("text") / 2))).alias("top")
        )
    )
    numbers = Window.orderBy("range")
    highest = F.max("range").over(numbers.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    below = (
        tops.select("range", F.coalesce(F.lag("range").over(numbers), highest).alias("other"))
        .join(tops.select(F.col("range").alias("other"), F.col("top.text").alias("below")), "other")
        .select("range", "below")
    )
    tie = (F.xxhash64("text") / 2).alias("tie")
    dealt = rows.select("doc_id", "text", "range", tie).repartition("range").withColumn("found", anchors(F.col("text")))
    order = (F.col("doc_id").asc_nulls_first(), F.col("tie").desc())
    before = F.lag(F.struct("text", "found")).over(Window.partitionBy("range").orderBy(*order))
    first = F.first("before").over(Window.partitionBy("range", "doc_id").orderBy(F.col("tie").desc()))
    third = F.floor(F.length("text") / 3).cast("int")
    front = F.substring(F.coalesce(F.col("after.text"), F.col("below")), F.lit(1), third)
    texts = (
        dealt.withColumn("before", before)
        .withColumn("after", first)
        .join(below, "range")
        .select(
            "doc_id",
            "found",
            F.length("text").cast("long").alias("n_chars"),
            F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), front).alias("edited"),
            F.when(F.col("after").isNotNull(), F.col("after.found")).otherwise(anchors(F.col("below"))).alias("next_found"),
        )
    )
    found = texts.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "found", anchors(F.col("edited")).alias("edited_found"), "next_found"
    )
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("found")).alias("fingerprint"),
        fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )
