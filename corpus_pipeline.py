"""A corpus pipeline over documents: language ID, line dedup, near duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import decontamination, language_id, line_runs, ngram_join, packing, tokens
from emberframe.operators.settle import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts: null, letterless and unsure texts go."""
    model = language_id.train(docs)
    return language_id.identify(docs, model, ("text", *(c for c in COLUMNS if c != "text"))).where("not rejected").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three documents share, but for the largest doc_id with each line."""
    kept = line_runs.drop_repeated_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; wordless ones all stay."""
    groups = ngram_join.similar_groups(docs, width=5, percent=80, count_links=False)
    lost = groups.where("doc_id <> component_id").select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontamination.contained_items(docs, items).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document that is left, with its sequence and place there."""
    return packing.pack(docs, tokens.default_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier and a tokenizer decide the rows, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
