"""Secret scans: Boolean trigram queries from each rule's expression over an inverted index, then verification."""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.settle import settle


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what matches, which group counts, and how long it is at least."""

    kind: str
    pattern: str
    group: int
    at_least: int


#: Fixed rules. hex: a run of 24 or more is found as such, since runs are maximal either way.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Most alternative spellings of a literal run that are followed up before a trigram query is cut short.
SPELLINGS = 64


def _spellings(tree) -> list[list[str | None]]:
    """Alternatives of an expression as lists of literals in lower case; None stands for anything."""
    out: list[list[str | None]] = [[]]
    for op, value in tree:
        if op is kinds.LITERAL:
            step = [[chr(value).lower()]]
        elif op is kinds.SUBPATTERN:
            step = _spellings(value[3])
        elif op is kinds.BRANCH:
            step = [x for part in value[1] for x in _spellings(part)]
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, part = value
            inner = _spellings(part)
            if (low, high) == (0, 1):
                step = [[], *inner]
            elif low:
                step = [[*x, *([None] if high != 1 else [])] for x in inner]
            else:
                step = [[None]]
        elif op is kinds.AT:
            step = [[]]
        else:
            step = [[None]]
        if len(out) * len(step) > SPELLINGS:
            step = [[None]]
        out = [a + b for a, b in product(out, step)]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """A match needs all trigrams of one of these sets; empty if some match needs none, so all must be read."""
    clauses = set()
    for spelling in _spellings(parser.parse(pattern)):
        runs = "".join("\0" if c is None else c for c in spelling).split("\0")
        own = frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))
        if not own:
            return []
        clauses.add(own)
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The written postings (trigram, doc_id) of the trigrams that the rules ask for, over whole texts in lower case."""
    wanted = sorted({t for rule in rules for clause in trigram_query(rule.pattern) for t in clause})
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not wanted:
        return docs.sparkSession.createDataFrame([], f"trigram string, doc_id {kind}")
    low = docs.where("text is not null").select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.col("low").contains(t), t) for t in wanted)))
    return settle(low.select("doc_id", F.explode(held).alias("trigram")).select("trigram", "doc_id").distinct())


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds) of documents whose postings meet a rule's query; rules without one are not here."""
    rows = [
        (rule.kind, n, len(clause), t)
        for rule in rules
        for n, clause in enumerate(trigram_query(rule.pattern))
        for t in sorted(clause)
    ]
    clauses = index.sparkSession.createDataFrame(rows, "kind string, clause int, size int, trigram string")
    met = (
        index.join(F.broadcast(clauses), "trigram")  # as many rows as the rules' own trigrams
        .groupBy("doc_id", "kind", "clause", "size")
        .agg(F.count("*").alias("n"))
        .where("n = size")
    )
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule) -> Column:
    """Spans (start, end) in code points of all leftmost non-overlapping matches that are long enough.

    Cutting the text at the matches gives the gaps between them; starts are running sums of gaps and matches.
    """
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group) if rule.group else found
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(found)),
        F.arrays_zip(found.alias("m"), counted.alias("g")),
        lambda gap, x: F.struct(
            F.length(gap).alias("gap"), F.length(x["m"]).alias("n"), (F.length(x["g"]) >= rule.at_least).alias("ok")
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,ok:boolean>>").alias("spans"))
    walked = F.aggregate(
        steps,
        start,
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(
                s["spans"],
                F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["n"]).alias("end"), x["ok"].alias("ok"))),
            ).alias("spans"),
        ),
    )
    return F.filter(walked["spans"], lambda x: x["ok"])


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found) of every row: found is the array of (start, rank, kind, end) by start, then rule order.

    Starts and ends are code points, end exclusive. Null and empty texts have no finding; repeated rows
    repeat; a null doc_id is verified without the index; other columns are ignored; an empty table gives an
    empty result. The index finds the documents that a rule's trigram query admits; those alone are verified
    with its expression. A rule without mandatory trigrams is matched against every text.
    """
    own = candidates(build_index(docs, rules), rules).withColumnRenamed("doc_id", "own_id")
    rows = docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("own_id"), "left")
    parts = []
    for rank, rule in enumerate(rules):
        found = _named(_spans(F.col("text"), rule), rank, rule.kind)
        asked = F.col("text").isNotNull()
        if trigram_query(rule.pattern):
            asked &= F.array_contains("kinds", rule.kind) | F.col("doc_id").isNull()
        empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
        parts.append(F.when(asked & F.col("text").rlike(rule.pattern), found).otherwise(empty).alias(f"f{rank}"))
    return rows.select("doc_id", *parts).select("doc_id", F.array_sort(F.concat(*(f"f{k}" for k in range(len(rules))))).alias("found"))


def digest(found: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
