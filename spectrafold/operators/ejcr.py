"""Elliptical joint confidence region of predicted-versus-reference lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ejcr(df: DataFrame, y: str, yhat: str, levels=(0.95,), by: list[str] | None = None) -> DataFrame:
    """Slope, intercept and the test of (1, 0) per level, from one aggregation.

    F(2, ν) quantiles have the closed form (ν/2)((1-P)^(-2/ν) - 1).
    """
    by = by or []
    fit = df.groupBy(*by).agg(
        F.regr_count(yhat, y).alias("n"), F.regr_slope(yhat, y).alias("slope"),
        F.regr_intercept(yhat, y).alias("intercept"), F.avg(y).alias("_my"),
        (F.regr_sxx(yhat, y) + F.regr_count(yhat, y) * F.avg(y) * F.avg(y)).alias("sum_y2"),
        (F.avg(y) * F.regr_count(yhat, y)).alias("sum_y"),
        (F.regr_syy(yhat, y) - F.regr_sxy(yhat, y) * F.regr_sxy(yhat, y) / F.regr_sxx(yhat, y)).alias("_sse"))
    fit = fit.withColumn("s2", F.greatest("_sse", F.lit(0.0)) / (F.col("n") - 2))
    out = fit.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    nu = F.col("n") - 2
    quantile = nu / 2 * (F.pow(1 - F.col("level"), -2 / nu) - 1)
    a = 1 - F.col("slope")
    b = -F.col("intercept")
    out = out.withColumn("limit", 2 * F.col("s2") * quantile)
    out = out.withColumn("distance", a * a * F.col("sum_y2") + 2 * a * b * F.col("sum_y") + b * b * F.col("n"))
    return (out.withColumn("unbiased", F.col("distance") <= F.col("limit"))
            .select(*by, "level", "n", "slope", "intercept", "s2", "sum_y", "sum_y2", "limit", "distance", "unbiased"))


def ejcr_boundary(regions: DataFrame, points: int = 200) -> DataFrame:
    """Points of each region's boundary around (slope, intercept)."""
    # the form [sum_y2, sum_y; sum_y, n] factors as L Lᵀ; the boundary is L⁻ᵀ of a circle
    l11 = F.sqrt("sum_y2")
    l21 = F.col("sum_y") / l11
    l22 = F.sqrt(F.col("n") - l21 * l21)
    angle = F.col("k") * (2 * math.pi / (points - 1))
    radius = F.sqrt("limit")
    v = radius * F.sin(angle) / l22
    u = (radius * F.cos(angle) - l21 * v) / l11
    return (regions.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumn("slope_at", F.col("slope") + u).withColumn("intercept_at", F.col("intercept") + v))
