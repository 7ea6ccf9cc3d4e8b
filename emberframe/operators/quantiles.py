"""Exact grouped quantiles that never gather a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.scale import ROWS_PER_CHUNK, ROWS_PER_CHUNK_SETTING, fits_one_task, setting
from emberframe.operators.keys import join_same
from emberframe.operators.ordered import split_evenly

def _interpolated(low: Column, high: Column, position: Column) -> Column:
    """As ``percentile`` does it: equal neighbours give their value, so infinities stay what they are."""
    between = (F.ceil(position) - position) * low + (position - F.floor(position)) * high
    return F.when(low == high, low).otherwise(between)


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
    *,
    split: bool | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """One row per group with linearly interpolated quantiles of the non-null values.

    Small inputs use the built-in ``percentile``. Larger ones count equal values, cut the
    distinct values of large groups into even slices, find the slices that hold the wanted
    ranks and rank only inside those, so the largest sort is one slice of one group.
    """
    if split is None:
        split = not fits_one_task(df)
    typed = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull()
    )
    if not split:
        levels = F.array(*[F.lit(float(p)) for p in probabilities.values()])
        packed = typed.groupBy(*keys).agg(F.percentile("_v", levels).alias("_q"))
        return packed.select(
            *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probabilities)]
        )

    values = typed.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    sliced = split_evenly(values, keys, F.col("_v"), rows_per_slice or setting(df, ROWS_PER_CHUNK_SETTING, ROWS_PER_CHUNK))
    counted = values.withColumn("_slice", F.lit(0).cast("long")) if sliced is None else sliced.withColumnRenamed("_chunk", "_slice")
    by_slice = counted.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_in_slice"))
    ordered = Window.partitionBy(*keys).orderBy("_slice")
    placed = by_slice.select(
        *keys,
        "_slice",
        F.coalesce(
            F.sum("_in_slice").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        "_in_slice",
        F.sum("_in_slice").over(Window.partitionBy(*keys)).alias("_rows"),
    )
    wanted = placed.withColumn(
        "_want",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("name"),
                        ((F.col("_rows") - 1) * F.lit(float(p))).alias("position"),
                    )
                    for name, p in probabilities.items()
                ]
            )
        ),
    ).select(
        *keys,
        "_slice",
        "_before",
        F.col("_want.name").alias("_name"),
        F.col("_want.position").alias("_position"),
        F.floor("_want.position").alias("_low"),
        F.ceil("_want.position").alias("_high"),
        "_in_slice",
    )
    end = F.col("_before") + F.col("_in_slice")
    hit = wanted.filter(
        ((F.col("_low") >= F.col("_before")) & (F.col("_low") < end))
        | ((F.col("_high") >= F.col("_before")) & (F.col("_high") < end))
    ).drop("_in_slice")
    needed = hit.select(*keys, "_slice", "_before").distinct()
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("_v")
    ranked = join_same(counted, needed, [*keys, "_slice"]).withColumn(
        "_upto",
        F.col("_before")
        + F.sum("_n").over(in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    ranked = ranked.select(
        *keys, "_slice", "_v", (F.col("_upto") - F.col("_n")).alias("_from"), "_upto"
    )
    picked = (
        join_same(hit.drop("_before"), ranked, [*keys, "_slice"])
        .groupBy(*keys, "_name")
        .agg(
            F.max("_position").alias("_position"),
            F.max(
                F.when((F.col("_low") >= F.col("_from")) & (F.col("_low") < F.col("_upto")), F.col("_v"))
            ).alias("_lo"),
            F.max(
                F.when((F.col("_high") >= F.col("_from")) & (F.col("_high") < F.col("_upto")), F.col("_v"))
            ).alias("_hi"),
        )
        .withColumn("_q", _interpolated(F.col("_lo"), F.col("_hi"), F.col("_position")))
    )
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in probabilities]
    )


def exact_median(
    df: DataFrame, keys: list[str], value: str, name: str = "median", *, split: bool | None = None
) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}, split=split)
