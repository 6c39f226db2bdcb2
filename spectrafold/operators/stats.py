"""Per-variable statistics, exact quantiles, histograms, correlation and ellipses."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import block, lists, sum_blocks
from . import ranks
from .moments import Moments, moments

_SMALL_GROUP = 200_000   # values one aggregation buffer may hold


def to_long(df: DataFrame, x: str = "x", keep: tuple[str, ...] = ("ix",)) -> DataFrame:
    """One row per (sample, 0-based variable position)."""
    # the outer form: the plain one adds a filter that computes ``x`` a second time
    return df.select(*keep, F.posexplode_outer(x).alias("pos", "value")).filter("pos is not null")


def to_wide(df: DataFrame, key: str = "ix") -> DataFrame:
    """Back to one array per sample; a group is one sample wide."""
    return (df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_s"))
            .select(key, F.transform("_s", lambda s: s["value"]).alias("x")))


def column_extremes(df: DataFrame, x: str = "x") -> dict[str, np.ndarray]:
    """n, sum, sum of squares, min and max per variable: one partial row per task."""

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = block(batch.column(0))
            part = [np.full(z.shape[1], float(len(z))), z.sum(0), (z * z).sum(0), z.min(0), z.max(0)]
            held = part if held is None else [held[0] + part[0], held[1] + part[1], held[2] + part[2],
                                              np.minimum(held[3], part[3]), np.maximum(held[4], part[4])]
        if held is not None:
            yield pa.RecordBatch.from_arrays([lists(h[None, :]) for h in held],
                                             names=["n", "s", "ss", "lo", "hi"])

    parts = df.select(x).mapInArrow(run, ", ".join(f"{c} array<double>" for c in ("n", "s", "ss", "lo", "hi")))
    zipped = parts.select(F.posexplode(F.arrays_zip("n", "s", "ss", "lo", "hi")).alias("pos", "v"))
    rows = (zipped.groupBy("pos").agg(F.sum("v.n").alias("n"), F.sum("v.s").alias("s"),
                                      F.sum("v.ss").alias("ss"), F.min("v.lo").alias("lo"),
                                      F.max("v.hi").alias("hi")).orderBy("pos").collect())
    return {c: np.array([r[c] for r in rows]) for c in ("n", "s", "ss", "lo", "hi")}


def nan_means(df: DataFrame, x: str = "x") -> DataFrame:
    """Mean per variable over the values that are present."""
    return (to_long(df, x, ()).groupBy("pos")
            .agg(F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("mean")))


def exact_quantiles(long: DataFrame, probs: list[float], keys: tuple[str, ...] = ("pos",),
                    value: str = "value") -> dict[tuple, list[float]]:
    """Linear-interpolated quantiles per key, exact at any size.

    Small groups use the built-in exact percentile, whose buffer the counted size bounds.
    Larger ones go through radix selection. The number of keys (variables) is what reaches the driver.
    """
    long = long.filter(F.col(value).isNotNull() & ~F.isnan(value))
    stats = long.groupBy(*keys).agg(F.count("*").alias("_n")).collect()
    if not stats:
        return {}
    if max(r["_n"] for r in stats) <= _SMALL_GROUP:
        rows = long.groupBy(*keys).agg(
            F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("_q")).collect()
        return {tuple(r[k] for k in keys): list(r["_q"]) for r in rows}
    # a number for each key; keys may hold NULL or NaN only where the caller wants them as a group
    types = dict(long.dtypes)
    schema = ", ".join([f"_k{i} {types[k]}" for i, k in enumerate(keys)] + ["_key int"])
    named = long.sparkSession.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(stats)], schema)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = long.join(F.broadcast(named), same).select("_key", F.col(value).cast("double").alias("_value"))

    def by_key(b):
        order = np.argsort(b["_key"], kind="stable")
        key, v = b["_key"][order], b["_value"][order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return dict(zip(key[cut].tolist(), np.split(v, cut[1:])))

    targets = {(i, rank) for i, r in enumerate(stats) for rank in ranks.wanted(r["_n"], probs)}
    found = ranks.select(rows, ["_key", "_value"], by_key, targets, few=False)
    return {tuple(r[k] for k in keys): ranks.interpolated(r["_n"], probs, lambda rank: found[i, rank]) for i, r in enumerate(stats)}


def array_quantiles(df: DataFrame, probs: list[float], x: str = "x") -> np.ndarray:
    """Quantiles per variable, shape (len(probs), variables); missing values are left out.

    The arrays stay whole: one scan counts the values, the others are those of the radix selection.
    """
    rows = df.select(x).filter(F.col(x).isNotNull()).persist()
    try:
        n = sum_blocks(rows, [x], lambda b: (~np.isnan(b[x])).sum(axis=0).astype(float))
        if n is None:
            return np.empty((0, len(probs))).T
        targets = {(j, rank) for j, m in enumerate(n) if m for rank in ranks.wanted(int(m), probs)}
        found = ranks.select(rows, [x], lambda b: np.ascontiguousarray(b[x].T), targets)
    finally:
        rows.unpersist()
    return np.array([ranks.interpolated(int(m), probs, lambda rank: found[j, rank]) if m else [np.nan] * len(probs) for j, m in enumerate(n)]).T


def correlation(df: DataFrame, x="x", width=None) -> np.ndarray:
    """Pearson correlation of the variables; a constant variable gives NaN, as it must."""
    m = moments(df, x, width=width)[""]
    spread = np.sqrt(np.diag(m.xx))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m.xx / np.outer(spread, spread)


def matrix_rows(spark, matrix, names, value: str) -> DataFrame:
    """A small named matrix as (row, col, value) rows."""
    rows = [(names[i], names[j], float(matrix[i, j]))
            for i in range(len(names)) for j in range(len(names))]
    return spark.createDataFrame(rows, f"row string, col string, {value} double")


def looks_autoscaled(m: Moments) -> bool:
    """95th percentile of |mean| at most 0.15 and of |std - 1| at most 0.20."""
    return bool(np.percentile(np.abs(m.x_mean), 95) <= 0.15
                and np.percentile(np.abs(m.std() - 1), 95) <= 0.20)


def histogram(df: DataFrame, value: str, bins: int = 30, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the extremes; the last bin includes the maximum."""
    by = by or []
    if by:
        # one row per group; whether it is broadcast is the planner's choice
        joined = df.join(df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")), by)
    else:
        ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        joined = df.withColumn("_lo", F.lit(ends["lo"])).withColumn("_hi", F.lit(ends["hi"]))
    span = F.col("_hi") - F.col("_lo")
    place = F.when(span > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / span * bins),
                                     F.lit(bins - 1))).otherwise(0)
    return (joined.groupBy(*by, place.cast("int").alias("bin"))
            .agg(F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
            .withColumn("low", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / bins)
            .drop("_lo", "_hi"))


def confidence_ellipse(df: DataFrame, a: str, b: str, by: str, confidence: float = 0.95) -> DataFrame:
    """Per group: centre, half axes and angle (degrees) of the normal confidence ellipse."""
    scale = -2 * math.log(1 - confidence)  # chi-squared quantile with 2 degrees of freedom
    agg = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(a).alias("center_a"), F.avg(b).alias("center_b"),
                             F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"),
                             F.covar_samp(a, b).alias("_c"))
    half = (F.col("_va") + F.col("_vb")) / 2
    root = F.sqrt(F.pow((F.col("_va") - F.col("_vb")) / 2, 2) + F.col("_c") * F.col("_c"))
    return (agg.withColumn("major", F.sqrt(F.greatest(half + root, F.lit(0.0)) * scale))
            .withColumn("minor", F.sqrt(F.greatest(half - root, F.lit(0.0)) * scale))
            .withColumn("angle", F.degrees(F.atan2(2 * F.col("_c"), F.col("_va") - F.col("_vb")) / 2))
            .drop("_va", "_vb", "_c"))


def cosine_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine similarity of the rows of two small factor matrices."""
    na = np.linalg.norm(a, axis=1, keepdims=True)
    nb = np.linalg.norm(b, axis=1, keepdims=True)
    return (a / np.where(na > 0, na, 1)) @ (b / np.where(nb > 0, nb, 1)).T
