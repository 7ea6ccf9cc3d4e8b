"""URL verdicts by host and path rules, carried to aliases over redirect and canonical-link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A canonical link, a refresh to another page; the target is group 1. Fixed forms of HTML.
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lowered; empty for null or without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): each page's url and the absolute target of its canonical link or refresh; none give no edge."""
    targets = F.array(F.regexp_extract("html", CANONICAL, 1), F.regexp_extract("html", REFRESH, 1))
    return (
        pages.where("html is not null and url is not null")
        .where(F.col("html").ilike("%canonical%") | F.col("html").ilike("%refresh%"))
        .select(F.col("url").alias("a"), F.explode(targets).alias("b"))
        .where(F.col("b").contains("://"))
        .select("a", F.replace("b", F.lit("&amp;"), F.lit("&")).alias("b"))
    )


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (column url, distinct) with host, path, rule and ruling; the last two null where no rule fits.

    rules has host, path, verdict. A rule fits its host and all subdomains if the path starts with its path.
    The longest rule text wins; of equal ones allow.
    """
    parsed = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    own = rules.select(
        F.col("host").alias("suffix"),
        F.col("path").alias("start"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("ruling"),
    )
    fitting = (
        parsed.select("url", "path", F.explode(suffixes).alias("suffix"))
        .join(own, "suffix")
        .where(F.col("path").startswith(F.col("start")))
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("ruling") == "allow").alias("allow"), "rule", "ruling")).alias("best"))
    )
    return parsed.join(fitting, "url", "left").select("url", "host", "path", "best.rule", "best.ruling")


def verdicts(pages: DataFrame, rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, via) of every row of ``pages`` (page_id, url).

    A url with a rule has the rule's verdict. Any other takes that of its component over ``edges`` (a, b;
    directions and repeats do not matter): allow if a rule allows any alias, else block if a rule blocks any,
    else allow. via says which: rule, alias, default. Edge ends that are no page count as aliases too. Null
    urls and such without :// have an empty host and path, fit no rule and have no alias; repeated rows
    repeat; other columns are ignored; empty tables give an empty result.

    Urls are judged once each. Components come from star contractions, so neither a redirect hub nor a long
    chain is gathered in one task; the verdict of a component is a sum over its members, combined before the
    shuffle.
    """
    rows = pages.select("page_id", "url")
    edges = edges.where("a is not null and b is not null and a <> b")
    names = connected_components(edges.select(F.sha2("a", 256).alias("a"), F.sha2("b", 256).alias("b")))
    urls = rows.select("url").union(edges.select("a")).union(edges.select("b")).where("url is not null").distinct()
    judged = ruled(urls, rules).withColumn("node", F.sha2("url", 256))
    placed = judged.join(names, "node", "left")
    allow, block = F.max((F.col("ruling") == "allow").cast("int")), F.max((F.col("ruling") == "block").cast("int"))
    groups = (
        placed.where("component is not null and ruling is not null")
        .groupBy("component")
        .agg(F.when(allow == 1, "allow").when(block == 1, "block").alias("alias"))
    )
    done = placed.join(groups, "component", "left").select("url", "rule", "ruling", "alias")
    return rows.join(done, "url", "left").select(
        "page_id",
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        "rule",
        F.coalesce("ruling", "alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("ruling").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default").alias("via"),
    )
