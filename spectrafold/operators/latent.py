"""Principal components of first-order or unfolded data, with metrics and cross-validation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import map_blocks
from ..dataset import Dataset
from .folds import CV, assign, test_rows, training_rows
from .linear import left_out_axes, pieces, principal_axes
from .moments import Moments, moments, total
from .stats import column_extremes


@dataclass(frozen=True)
class PCAModel:
    mean: np.ndarray
    loadings: np.ndarray      # variables × components
    eigenvalues: np.ndarray
    total_variance: float
    n: float

    def explained(self, spark) -> DataFrame:
        """Variance, percent and cumulative percent per component (rows = components)."""
        percent = 100 * self.eigenvalues / self.total_variance if self.total_variance > 0 \
            else 0 * self.eigenvalues
        rows = [(a + 1, float(v), float(p), float(c)) for a, (v, p, c)
                in enumerate(zip(self.eigenvalues, percent, np.cumsum(percent)))]
        return spark.createDataFrame(rows, "component int, variance double, percent double, cumulative double")

    def transform(self, df: DataFrame) -> DataFrame:
        """Scores, T² (calibration eigenvalues) and Q per sample."""
        mean, loadings, eigen = self.mean, self.loadings, self.eigenvalues

        def run(c):
            z = c["x"] - mean
            t = z @ loadings
            rest = z - t @ loadings.T
            return {"scores": t, "q": (rest * rest).sum(1),
                    "t2": (t * t / np.where(eigen > 0, eigen, np.inf)).sum(1)}

        keep = [c for c in df.columns if c != "x"]
        return map_blocks(df, run, [("scores", "array<double>"), ("t2", "double"), ("q", "double")], ["x"], keep)

    def leverage(self, scored: DataFrame) -> DataFrame:
        """diag(T (TᵀT)⁺ Tᵀ) from the set's own scores."""
        a = len(self.eigenvalues)
        power = score_products(scored, a)
        inverse = np.linalg.pinv(power)
        return map_blocks(scored, lambda c: {"leverage": np.einsum("ij,jk,ik->i", c["scores"], inverse, c["scores"])},
                          [("leverage", "double")], ["scores"], scored.columns)

    def metrics(self, df: DataFrame) -> dict:
        """Explained variance, percentages and reconstruction RMSE for 1..A of any set of rows."""
        residual = map_blocks(df, lambda c: {"v": _losses(c["x"] - self.mean, self.loadings)},
                              [("v", "array<double>")], ["x"], [])
        sums = column_extremes(residual, "v")
        n, p, a = sums["n"][0], len(self.mean), len(self.eigenvalues)
        left, squares = sums["s"][:a], sums["s"][a:2 * a]
        own = moments(df, "x", width=p)[""]
        variance = squares / (n - 1) if n > 1 else 0 * squares
        whole = np.trace(own.xx) / (n - 1) if n > 1 else 0.0
        percent = 100 * variance / whole if whole > 0 else 0 * variance
        return {"n": int(n), "explained_variance": variance, "percent": percent, "cumulative": np.cumsum(percent),
                "total_variance": whole, "reconstruction_rmse": np.sqrt(left / (n * p))}


def _losses(z: np.ndarray, loadings: np.ndarray) -> np.ndarray:
    """Residual squares after 1..A components, then squared scores."""
    t2 = (z @ loadings) ** 2
    # orthonormal loadings: every component removes exactly its squared score
    left = (z * z).sum(axis=1, keepdims=True) - np.cumsum(t2, axis=1)
    return np.hstack([np.maximum(left, 0), t2])


def score_products(scored: DataFrame, a: int) -> np.ndarray:
    m = moments(scored, "scores", width=a)[""]
    return m.xx + m.n * np.outer(m.x_mean, m.x_mean)


def fit_moments(m: Moments, components: int) -> PCAModel:
    values, axes = principal_axes(m, components)
    return PCAModel(m.x_mean, axes, values, float(np.trace(m.xx) / (m.n - 1)), m.n)


def pca(ds: Dataset, components: int = 2) -> PCAModel:
    return fit_moments(moments(ds.cal, "x", width=ds.width)[""], components)


def pca_cv(ds: Dataset, components: int, cv: CV, n: int | None = None):
    """Fold models from subtracted moments.

    Returns the projected scores (ix, fold, scores), the RMSE curve of 1..A components, and
    the loadings per fold as rows.
    """
    assigned = assign(ds.cal.select("ix", "x", *[c for c in ("classes", "y") if c in ds.df.columns]), cv, n)
    if cv.strategy == "loocv":
        whole = moments(assigned, "x", width=ds.width)[""]
        axes = fit_moments(whole, components).loadings.shape[1]

        def own(c):
            losses, scores = np.zeros((len(c["x"]), axes)), np.zeros((len(c["x"]), axes))
            used = max(1, min(components, whole.p, int(whole.n - 1)))
            for at in pieces(len(c["x"]), 3 * whole.p ** 2):
                d = c["x"][at] - whole.x_mean
                z = d * (whole.n / max(whole.n - 1, 1))
                scores[at, :used] = np.einsum("ip,ipa->ia", z, left_out_axes(whole, d)[1][:, :, :used])
                left = (z * z).sum(axis=1, keepdims=True) - np.cumsum(scores[at, :used] ** 2, axis=1)
                losses[at, :used] = np.maximum(left, 0)
            losses[:, used:] = losses[:, used - 1:used]  # no axis is left to lower it
            return {"scores": scores, "_v": losses}

        scored = map_blocks(assigned, own, [("scores", "array<double>"), ("_v", "array<double>")], ["x"],
                            ["ix", "fold"])
        models: dict[int, PCAModel] = {}
    else:
        if cv.partitions:
            parts = moments(assigned, "x", key="fold", width=ds.width)
            whole = total(parts.values())
            models = {int(f): fit_moments(whole - part, components) for f, part in parts.items()}
            rows = assigned
        else:
            parts = moments(training_rows(assigned), "x", key="fold", weight="weight", width=ds.width)
            models = {int(f): fit_moments(part, components) for f, part in parts.items()}
            rows = test_rows(assigned)

        def run(c):
            folds = c["fold"].astype(int)
            a = min(m.loadings.shape[1] for m in models.values())
            scores, losses = np.empty((len(folds), a)), np.empty((len(folds), a))
            for f in np.unique(folds):
                at = folds == f
                z = c["x"][at] - models[f].mean
                scores[at] = z @ models[f].loadings[:, :a]
                losses[at] = _losses(z, models[f].loadings[:, :a])[:, :a]
            return {"scores": scores, "_v": losses}

        scored = map_blocks(rows, run, [("scores", "array<double>"), ("_v", "array<double>")], ["x", "fold"],
                            ["ix", "fold"])
    spark = ds.df.sparkSession
    curve = (scored.select(F.posexplode("_v").alias("pos", "v"))
             .groupBy("pos").agg(F.sqrt(F.avg("v") / ds.width).alias("rmse_cv"))
             .select((F.col("pos") + 1).alias("component"), "rmse_cv"))
    loads = [(f, a + 1, j, float(m.loadings[j, a])) for f, m in sorted(models.items())
             for a in range(m.loadings.shape[1]) for j in range(ds.width)]
    loadings = spark.createDataFrame(loads, "fold int, component int, pos int, loading double") if loads else None
    return scored.drop("_v"), curve, loadings
