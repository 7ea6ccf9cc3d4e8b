"""Affine projection fits, their gates and projection-error summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.functions.numbers import all_reasons, first_reason, is_finite
from emberframe.operators.settle import settle

# Fixed values of the fit gates.
MIN_SAMPLES = 6
MAX_CONDITION = 1e6
MIN_TARGET_SPAN_PX = 2.0
_RANK_SHARE = 1e-7

_FIT = T.StructType(
    [
        T.StructField("coeff_x", T.ArrayType(T.DoubleType())),
        T.StructField("coeff_y", T.ArrayType(T.DoubleType())),
        T.StructField("condition", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ]
)
_PREDICTORS = ("x", "y", "z")


@F.pandas_udf(_FIT)
def _solve_affine(moments: pd.DataFrame) -> pd.DataFrame:
    """Solve one 4-parameter fit per row from counts, means and covariances."""
    rows = []
    for m in moments.itertuples(index=False):
        mean = np.array([m.mx, m.my, m.mz])
        cov = np.array([[m.xx, m.xy, m.xz], [m.xy, m.yy, m.yz], [m.xz, m.yz, m.zz]])
        gram = np.ones((4, 4))
        gram[0, 1:] = gram[1:, 0] = mean
        gram[1:, 1:] = cov + np.outer(mean, mean)
        sizes = np.sqrt(np.clip(np.linalg.eigvalsh(gram), 0.0, None))
        rank = int((sizes > sizes[-1] * _RANK_SHARE).sum())
        condition = float(sizes[-1] / sizes[0]) if sizes[0] > 0 else float("inf")
        if rank < 4:
            rows.append((None, None, condition, rank))
            continue
        fits = []
        for target, centre in (((m.xu, m.yu, m.zu), m.mu), ((m.xv, m.yv, m.zv), m.mv)):
            slopes = np.linalg.solve(cov, np.array(target))
            fits.append([float(centre - slopes @ mean), *map(float, slopes)])
        rows.append((*fits, condition, rank))
    return pd.DataFrame(rows, columns=["coeff_x", "coeff_y", "condition", "rank"])


def affine(coefficients: Column, x: Column, y: Column, z: Column) -> Column:
    c = lambda i: F.get(coefficients, i)
    return c(0) + c(1) * x + c(2) * y + c(3) * z


def fit_affine(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares (x, y, z) to (u, v) per group, from one pass of moments.

    Covariances are centred, so the 3x3 solve stays well conditioned; a group of
    any size reduces to one row before Python sees it. Groups that fail a gate
    keep their reason and no coefficients.
    """
    x, y, z, u, v = (F.col(c).cast("double") for c in ("x", "y", "z", "u", "v"))
    pairs = {
        "xx": (x, x), "xy": (x, y), "xz": (x, z), "yy": (y, y), "yz": (y, z), "zz": (z, z),
        "xu": (x, u), "yu": (y, u), "zu": (z, u), "xv": (x, v), "yv": (y, v), "zv": (z, v),
    }
    moments = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[F.avg(c).alias(f"m{n}") for n, c in zip("xyzuv", (x, y, z, u, v))],
        *[F.covar_pop(a, b).alias(n) for n, (a, b) in pairs.items()],
        (F.max(u) - F.min(u)).alias("span_u"),
        (F.max(v) - F.min(v)).alias("span_v"),
    )
    names = [f"m{n}" for n in "xyzuv"] + list(pairs)
    solved = moments.withColumn("_fit", _solve_affine(F.struct(*names)))
    reason = first_reason(
        (F.col("sample_count") < MIN_SAMPLES, "too_few_samples"),
        (F.col("_fit.rank") < 4, "rank_deficient"),
        (F.col("_fit.condition") > MAX_CONDITION, "ill_conditioned"),
        (
            (F.col("span_u") < MIN_TARGET_SPAN_PX) | (F.col("span_v") < MIN_TARGET_SPAN_PX),
            "target_spread_too_small",
        ),
    )
    fitted = solved.select(
        *keys, "sample_count", F.col("_fit.condition").alias("condition"), reason.alias("reason"),
        F.when(reason.isNull(), F.col("_fit.coeff_x")).alias("coeff_x"),
        F.when(reason.isNull(), F.col("_fit.coeff_y")).alias("coeff_y"),
    )
    # one row a group, its size known: few groups are sent to the samples, which then stay where they are
    fitted = settle(fitted)
    errors = residuals(samples, fitted, keys).groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("error_px") * F.col("error_px"))).alias("rms_error_px"),
        F.max("error_px").alias("max_error_px"),
    )
    return fitted.join(errors, keys, "left")


def residuals(samples: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted point and distance to the target for every sample."""
    coefficients = fitted.select(*keys, "coeff_x", "coeff_y")
    joined = samples.join(coefficients, keys)
    at = [F.col(c) for c in _PREDICTORS]
    pu, pv = affine(F.col("coeff_x"), *at), affine(F.col("coeff_y"), *at)
    return joined.withColumns({"predicted_u": pu, "predicted_v": pv}).withColumn(
        "error_px", F.hypot(F.col("predicted_u") - F.col("u"), F.col("predicted_v") - F.col("v"))
    ).drop("coeff_x", "coeff_y")


def project_affine(points: DataFrame, fitted: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Apply a fit; points outside the image or not finite are invalid, never clipped."""
    joined = points.join(fitted.select(*keys, "coeff_x", "coeff_y"), keys)
    at = [F.col(c) for c in _PREDICTORS]
    out = joined.withColumns(
        {"ir_x": affine(F.col("coeff_x"), *at), "ir_y": affine(F.col("coeff_y"), *at)}
    ).drop("coeff_x", "coeff_y")
    status = F.when(
        is_finite(F.col("ir_x")) & is_finite(F.col("ir_y"))
        & (F.col("ir_x") >= 0) & (F.col("ir_x") < width) & (F.col("ir_y") >= 0) & (F.col("ir_y") < height),
        "ok",
    ).otherwise("projection_out_of_fov")
    return out.withColumn("status", status)


def calibration_issues(
    *, min_samples: int = MIN_SAMPLES, max_rms: float | None = None, max_error: float | None = None,
    image_size: tuple[int, int] | None = None,
) -> Column:
    """Failed checks of a stored calibration row (coefficients, residuals, counts, size)."""

    def bad_coefficients(name: str) -> Column:
        finite = F.forall(F.col(name), is_finite)
        return ~F.coalesce((F.size(name) == 4) & finite, F.lit(False))

    rms, top = F.col("rms_error_px"), F.col("max_error_px")
    cases = [
        (bad_coefficients("coeff_x"), "coeff_x"),
        (bad_coefficients("coeff_y"), "coeff_y"),
        (~(is_finite(rms) & is_finite(top) & (rms >= 0) & (top >= 0)), "residuals_not_finite"),
        (top < rms, "max_below_rms"),
        (F.col("sample_count") < min_samples, "too_few_samples"),
    ]
    if image_size is not None:
        wanted = F.array(*[F.lit(v) for v in image_size])
        cases.append((~F.coalesce(F.col("image_size") == wanted, F.lit(False)), "image_size"))
    if max_rms is not None:
        cases.append((rms > max_rms, "rms_above_limit"))
    if max_error is not None:
        cases.append((top > max_error, "max_above_limit"))
    return all_reasons(*cases)


def fit_decision(fitted: DataFrame, gate_px: float) -> DataFrame:
    """GO when both residual figures are inside the gate, else ESCALATE."""
    accepted = (F.col("rms_error_px") <= gate_px) & (F.col("max_error_px") <= gate_px)
    accepted = F.coalesce(accepted, F.lit(False))
    return fitted.withColumns(
        {"accepted": accepted, "decision": F.when(accepted, "GO").otherwise("ESCALATE")}
    )


def projection_errors(points: DataFrame, keys: list[str], image: str) -> DataFrame:
    """Per image: points, largest error and squared-error sum of projected vs detected."""
    error = F.hypot(F.col("projected_u") - F.col("detected_u"), F.col("projected_v") - F.col("detected_v"))
    return points.withColumn("_e", error).groupBy(*keys, image).agg(
        F.count(F.lit(1)).alias("point_count"),
        F.max("_e").alias("max_error_px"),
        F.sum(F.col("_e") * F.col("_e")).alias("squared_error"),
    )


def projection_verdict(
    per_image: DataFrame, keys: list[str], *, images: int, points_per_image: int, limit_px: float
) -> DataFrame:
    """Whole-set error and the gate: exact image and point counts, largest error in limit."""
    whole = per_image.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("image_count"),
        F.sum("point_count").alias("point_count"),
        F.max("max_error_px").alias("global_max_error_px"),
        F.sqrt(F.try_divide(F.sum("squared_error"), F.sum("point_count").cast("double"))).alias("rms_error_px"),
        F.bool_and(F.col("point_count") == points_per_image).alias("_full"),
    )
    passed = (
        (F.col("image_count") == images) & F.col("_full")
        & is_finite(F.col("global_max_error_px")) & is_finite(F.col("rms_error_px"))
        & (F.col("global_max_error_px") <= limit_px)
    )
    return whole.withColumn("status", F.when(passed, "pass").otherwise("fail")).drop("_full")


def epipolar_distance(
    points: DataFrame, keys: list[str], essential: list[list[float]], focal_px: float
) -> DataFrame:
    """Symmetric epipolar distance per pair, the better of the two point orders.

    ``points`` has normalised colour (cx, cy) and thermal (tx, ty) coordinates per
    (keys, ordering, point); distances come back in colour pixels.
    """
    e = essential
    c = (F.col("cx"), F.col("cy"), F.lit(1.0))
    t = (F.col("tx"), F.col("ty"), F.lit(1.0))
    et = [sum(e[i][j] * t[j] for j in range(3)) for i in range(3)]
    ec = [sum(e[j][i] * c[j] for j in range(3)) for i in range(3)]
    numerator = F.pow(sum(c[i] * et[i] for i in range(3)), 2)
    denominator = F.greatest(et[0] * et[0] + et[1] * et[1] + ec[0] * ec[0] + ec[1] * ec[1], F.lit(1e-12))
    distance = F.sqrt(numerator / denominator) * F.lit(focal_px)
    each = points.withColumn("_d", distance).groupBy(*keys, "ordering").agg(
        F.avg("_d").alias("mean_px"), F.max("_d").alias("max_px")
    )
    best = F.min(F.struct("mean_px", "ordering", "max_px"))
    return each.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
