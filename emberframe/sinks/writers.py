"""Writers with fixed columns, refused overwrites and JSON-safe values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe import schema as layouts
from emberframe.functions.numbers import INFINITY


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of a few output paths that already exist, on whatever file system they name."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            found.append(path)
    return found


def refuse_existing(spark: SparkSession, paths: list[str]) -> None:
    """Check all outputs before any work starts."""
    found = existing(spark, paths)
    if found:
        raise FileExistsError(found[0])


def write_features(df: DataFrame, path: str, columns: tuple[str, ...] = layouts.FEATURES, *, csv: bool = False) -> None:
    """Fixed columns in fixed order, as parquet or header CSV; never overwrites."""
    out = df.select(*columns).write.mode("errorifexists")
    if csv:
        out.option("header", True).csv(path)
    else:
        out.parquet(path)


def json_safe_column(value: Column, kind: T.DataType) -> Column:
    """NaN and infinities become null, inside structs, arrays and maps too."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != F.lit(INFINITY)), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: json_safe_column(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: json_safe_column(v, kind.valueType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[json_safe_column(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def json_safe(df: DataFrame) -> DataFrame:
    return df.select(*[json_safe_column(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def flattened(df: DataFrame) -> DataFrame:
    """Columns in sorted order, nested values as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in fields]
    )


def merged_rows(*frames: DataFrame) -> DataFrame:
    """Rows of different shapes under the union of their columns."""
    merged = frames[0]
    for df in frames[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    return merged


def write_summary(rows: DataFrame, decision: DataFrame, path: str) -> None:
    """Decision and its rows as JSON, keys sorted, one file set per part."""
    tidy = lambda df: json_safe(df.select(*sorted(df.columns)))
    tidy(decision).write.mode("errorifexists").json(f"{path}/decision")
    tidy(rows).write.mode("errorifexists").json(f"{path}/rows")


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a parquet table, refusing other columns than it has."""
    spark = df.sparkSession
    if existing(spark, [path]):
        header = spark.read.parquet(path).columns
        if header != df.columns:
            raise ValueError(f"columns must match {header}, got {df.columns}")
    df.write.mode("append").parquet(path)


def write_delta_fields(deltas: DataFrame, path: str, *kept: str) -> None:
    """Per-frame fields as float arrays, one folder per trial.

    Each task writes what it has of a trial, so a trial with most frames is written by all tasks that hold some.
    """
    floats = lambda c: F.transform(c, lambda v: v.cast("float")).alias(c)
    out = deltas.select("trial", "frame", floats("pixels"), floats("delta"), floats("baseline"), *kept)
    out.write.mode("errorifexists").partitionBy("trial").parquet(path)


def calibration_report(residual_rows: DataFrame, fitted: DataFrame, path: str) -> None:
    """Per-sample errors and the one-row decision per calibration."""
    json_safe(residual_rows).write.mode("errorifexists").json(f"{path}/samples")
    json_safe(fitted).write.mode("errorifexists").json(f"{path}/decision")


def shadow_log(path: str, version: str = "1", extra: tuple[str, ...] = (), known_extra: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer for the fixed shadow log.

    Unknown extra columns are refused when the writer is made; a batch with other
    columns than the log's stops the stream. A batch that is run again after a
    failure replaces its own folder, so no row is doubled.
    """
    unknown = set(extra) - set(known_extra)
    if unknown:
        raise ValueError(f"unsupported telemetry fields: {sorted(unknown)}")
    columns = [*layouts.SHADOW_LOG, *extra]

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("schema_version", F.lit(version))
        if set(stamped.columns) != set(columns):
            raise ValueError(f"shadow log columns must be {columns}, got {stamped.columns}")
        stamped.select(*columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
