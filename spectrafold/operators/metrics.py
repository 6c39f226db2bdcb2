"""Regression and classification metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: list[str] | None = None,
                       eps: float = 0.0) -> DataFrame:
    """RMSE, MSE, MAE, R², bias (predicted - true) and SEP per group, in one aggregation.

    The residual of the calibration report has the other sign: ``residual_diagnostics``.
    """
    e = F.col(yhat) - F.col(y)
    n = F.count(e)
    sst = F.var_pop(F.when(e.isNotNull(), F.col(y))) * n
    sse = F.sum(e * e)
    return df.groupBy(*(by or [])).agg(
        n.alias("n"), F.sqrt(sse / n).alias("rmse"), (sse / n).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.when(sst + eps > 0, 1 - sse / (sst + eps)).alias("r2"), F.avg(e).alias("bias"),
        F.stddev_pop(e).alias("sep"))


def overall_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """RMSE and R² over all responses of long rows (response, y, yhat)."""
    per = df.groupBy("response").agg(F.count("*").alias("n"), F.sum(F.pow(F.col(y) - F.col(yhat), 2)).alias("sse"),
                                     (F.var_pop(y) * F.count("*")).alias("sst"))
    return per.agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"),
                   F.when(F.sum("sst") > 0, 1 - F.sum("sse") / F.sum("sst")).alias("r2"))


def fold_summary(folds: DataFrame, metrics=("rmse", "mse", "mae", "r2", "bias", "sep")) -> DataFrame:
    """mean / std (population) / min / max over folds, one row per metric."""
    rows = folds.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"))
                                            for m in metrics])).alias("s")).select("s.*")
    return rows.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
                                      F.min("v").alias("min"), F.max("v").alias("max"))


def residual_diagnostics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: list[str] | None = None) -> DataFrame:
    e = F.col(y) - F.col(yhat)
    return df.groupBy(*(by or [])).agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"),
                                       F.max(F.abs(e)).alias("max_abs"))


def confusion(df: DataFrame, y: str = "label", yhat: str = "pred", labels: list | None = None) -> DataFrame:
    """Counts per (true, predicted) pair of labels, zero pairs included."""
    counts = df.groupBy(F.col(y).alias("true"), F.col(yhat).alias("pred")).agg(F.count("*").alias("n"))
    if labels is None:
        names = (counts.select("true").union(counts.select("pred")).distinct()
                 .agg(F.array_sort(F.collect_set("true")).alias("names")))
        # label × label cells of a one-row label list
        cells = names.select(F.explode("names").alias("true"), "names").select("true", F.explode("names").alias("pred"))
    else:
        spark = df.sparkSession
        cells = spark.createDataFrame([(a, b) for a in labels for b in labels], counts.select("true", "pred").schema)
    return cells.join(counts, ["true", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_report(df: DataFrame, y: str = "label", yhat: str = "pred") -> DataFrame:
    """Precision, recall and F1 per label; an undefined ratio is 0."""
    counts = df.groupBy(F.col(y).alias("t"), F.col(yhat).alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).cast("long").alias("hit")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"),
                                      F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.withColumn("precision", ratio(F.col("hit"), F.col("called"))) \
        .withColumn("recall", ratio(F.col("hit"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_metrics(df: DataFrame, y: str = "label", yhat: str = "pred") -> DataFrame:
    """Accuracy and macro averages over the labels present in truth or prediction."""
    return class_report(df, y, yhat).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def simple_ols(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """Slope, intercept, R² (guarded denominator) and RMSE of y on x over finite pairs."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    good = df.filter(finite(y) & finite(x))
    sse = F.regr_syy(y, x) - F.when(F.regr_sxx(y, x) > 0,
                                    F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)).otherwise(0.0)
    return good.groupBy(*(by or [])).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        (1 - sse / (F.regr_syy(y, x) + 1e-12)).alias("r2"),
        F.sqrt(F.greatest(sse, F.lit(0.0)) / F.regr_count(y, x)).alias("rmsep"))


def best_pairing(pairs: DataFrame, component: str = "component", response: str = "response") -> DataFrame:
    """The response each component explains best (R², then response order).

    ``pairs`` holds one row per (component, response): small next to the samples.
    """
    from pyspark.sql import Window as W
    w = W.partitionBy(component).orderBy(F.col("r2").desc(), F.col(response))
    return pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def best_candidate(df: DataFrame, score: str, candidate: str, order: str, mode: str = "min") -> DataFrame:
    """First candidate with the best score."""
    key = F.struct(F.col(score) if mode == "min" else -F.col(score), F.col(order))
    return df.agg(F.min_by(candidate, key).alias("best"),
                  (F.min(score) if mode == "min" else F.max(score)).alias("score"))


def inlier_rate(df: DataFrame, flag: str = "inlier") -> Column:
    return df.agg(F.avg((F.col(flag) == 1).cast("int")).alias("inlier_rate"))


def figure_ranges(runs: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Least and greatest value of each figure of merit over the models of ``runs``."""
    ends = [fn(c).alias(f"{c}_{name}") for c in columns for name, fn in (("min", F.min), ("max", F.max))]
    return runs.groupBy(*(by or [])).agg(*ends)
