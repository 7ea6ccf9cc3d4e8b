"""Trial folders, session logs, documents and sample files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe import schema as layouts
from emberframe.functions.numbers import lenient_number
from emberframe.functions.text import safe_relative_path

CORRUPT = "_corrupt_record"


def trial_of(path: Column) -> Column:
    """Folder name below ``trials``."""
    return F.regexp_extract(path, r"/trials/([^/]+)/", 1)


def scan_trials(spark: SparkSession, root: str, name: str, columns: tuple[str, ...], glob: str = "*") -> DataFrame:
    """One header CSV of every matching trial, in one read, tagged with its trial.

    Values stay text; ``typed`` turns chosen columns into numbers.
    """
    rows = (
        spark.read.schema(layouts.text_columns(*columns))
        .option("header", True)
        .option("enforceSchema", False)
        .csv(f"{root}/trials/{glob}/{name}")
    )
    return rows.withColumn("trial", trial_of(F.col("_metadata.file_path")))


def typed(rows: DataFrame, numbers: list[str]) -> DataFrame:
    """Text to numbers; unparsable and non-finite become null."""
    return rows.withColumns({n: lenient_number(F.col(n)) for n in numbers})


def scan_metadata(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    rows = spark.read.schema(layouts.TRIAL_METADATA).option("multiLine", True).json(
        f"{root}/trials/{glob}/metadata.json"
    )
    return rows.withColumn("trial", trial_of(F.col("_metadata.file_path")))


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and their number in it, from 1.

    Files are read in splits. A split's lines are counted where they are read; the lines of the splits before it in
    the file, one row a split, are added. So a large file is neither read by one task nor sorted.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = None, 0
        for batch in batches:
            at = []
            for split in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own, n = split, n + 1 if split == own else 1
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["value", "file", "_block", "_n"])

    lines = read.mapInArrow(number, "value string, file string, _block long, _n long")
    sizes = read.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", "_block", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    return lines.join(before, ["file", "_block"]).select("value", "file", (F.col("_before") + F.col("_n")).alias("line"))


def session_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Line-by-line JSON session; blank lines are skipped, bad lines keep their text.

    Every row carries its file and line number. Use ``malformed`` to list bad lines or
    ``strict`` to stop on them.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    kept = numbered_lines(spark, path).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = kept.withColumn("_row", F.from_json("value", with_corrupt, options))
    not_object = ~F.trim("value").startswith("{")
    bad = F.when(not_object | F.col(f"_row.{CORRUPT}").isNotNull(), F.col("value"))
    return parsed.select("file", "line", *[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields], bad.alias(CORRUPT))


def malformed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(CORRUPT).isNotNull()).select("file", "line", CORRUPT)


def strict(rows: DataFrame) -> DataFrame:
    """Stop the job on a bad line, naming file, line number and text."""
    message = F.concat(F.lit("invalid session line "), F.col("line").cast("string"), F.lit(" of "), "file", F.lit(": "), F.col(CORRUPT))
    guard = F.when(F.col(CORRUPT).isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return rows.filter(guard).drop(CORRUPT)


def calibration_samples(spark: SparkSession, points_only: str | None, timed: str | None) -> DataFrame:
    """Sample files of both layouts together; the older one has no timing."""
    parts = []
    for path, names in ((points_only, layouts.SAMPLE_POINTS), (timed, (*layouts.SAMPLE_POINTS, *layouts.SAMPLE_TIMING))):
        if path is not None:
            read = spark.read.schema(layouts.text_columns(*names)).option("header", True).csv(path)
            parts.append(typed(read, list(names)))
    wanted = [*layouts.SAMPLE_POINTS, *layouts.SAMPLE_TIMING]
    merged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    missing = {n: F.lit(None).cast("double") for n in wanted if n not in merged.columns}
    return merged.withColumns(missing).select(*wanted)


def artifacts(rows: DataFrame, files: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows with the file their stored relative path names.

    Paths that would leave the session never reach the join; they and missing
    files are named in ``artifact_issue``.
    """
    safe = safe_relative_path(F.col(path))
    marked = rows.withColumn("_path", F.when(safe, F.col(path)))
    joined = marked.join(files.withColumnRenamed("path", "_path"), [*keys, "_path"], "left")
    issue = F.when(F.col(path).isNull(), "artifact_missing").when(~safe, "artifact_outside_session").when(
        F.col("content").isNull(), "artifact_not_found"
    )
    return joined.withColumn("artifact_issue", issue).drop("_path")
