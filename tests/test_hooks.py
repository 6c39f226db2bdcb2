import numpy as np
from pyspark.sql import functions as F

from helpers import samples, wide
from spectrafold.operators import linear, metrics, selection
from spectrafold.operators.calibration import Calibration
from spectrafold.operators.folds import CV, cross_validate


def test_user_hook_equals_the_moment_route(spark):
    x = np.random.default_rng(0).normal(size=(30, 3))
    ds = samples(spark, x, x @ [1.0, 2.0, 3.0] + np.random.default_rng(1).normal(size=30))
    cv = CV("venetian_blinds", 3)
    fit = lambda rows: Calibration("ridge", 0.5).fit(ds.with_df(rows, scaled=True))
    held = cross_validate(ds.df, cv, fit, lambda model, rows: model.predict(rows))
    want = linear.cross_predict(ds.df, "ridge", [0.5], cv, 3)
    assert np.allclose(wide(held, "yhat"), wide(want, "yhat")) and held.select("fold").distinct().count() == 3


def test_masked_samples_are_cut_to_the_common_length(spark):
    x = np.arange(24.0).reshape(3, 8)
    ds = samples(spark, x, shape=(4, 2))
    seen = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i < F.when(F.col("ix") == 0, 6).when(F.col("ix") == 1, 8).otherwise(0))
    out = selection.trim_masked(ds.with_df(ds.df.withColumn("mask", seen)))
    assert out.shape == (3, 2) and np.allclose(wide(out.df, "x"), x[:2, :6])


def test_figure_ranges(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 5.0), (2, 1.0)], "component int, lod double")
    rows = {r["component"]: (r["lod_min"], r["lod_max"]) for r in metrics.figure_ranges(df, ["lod"], ["component"]).collect()}
    assert rows == {1: (2.0, 5.0), 2: (1.0, 1.0)}


def test_best_candidate_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.4)], "c int, rmse double")
    assert metrics.best_candidate(df, "rmse", "c", "c").first()["best"] == 2
