"""Multiway regression: U-PLS and N-PLS from moments, residual bi-/trilinearisation per sample.

Both models are linear in the flattened tensor, so scores, loadings and residuals of any number
of components follow from one scan's XᵀX and Xᵀy. Only the correction of unexpected components
works sample by sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import map_blocks, sum_blocks
from ..dataset import Dataset
from ..functions.distributions import normal_quantile, t_quantile
from .linear import pls
from .moments import Moments, moments


@dataclass(frozen=True)
class Target:
    """One response: x ≈ P t, t = Rᵀ(x - mean), y = ȳ + v·t."""

    loadings: np.ndarray     # P
    rotations: np.ndarray    # R
    v: np.ndarray
    y_mean: float
    y_squares: float         # Σ(y - ȳ)²
    y_residual: float        # Σ of squared calibration residuals
    x_residual: float
    x_percent: np.ndarray
    y_percent: np.ndarray
    scores_inverse: np.ndarray   # (TᵀT)⁻¹


@dataclass(frozen=True)
class NPLSModel:
    method: str
    shape: tuple[int, ...]
    x_mean: np.ndarray
    targets: list[Target]
    n: int
    y_names: tuple[str, ...] = ()
    info: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, interferents: int = 0, max_iter: int = 50) -> DataFrame:
        """yhat per response, the uncorrected yhat_base, and residual norms before and after.

        ``interferents`` > 0 removes that many unexpected components per sample.
        """
        model = self

        def run(c):
            out = {k: np.zeros((len(c["x"]), len(model.targets))) for k in _OUTPUTS}
            for j, t in enumerate(model.targets):
                z = c["x"] - model.x_mean
                beta = z @ t.rotations
                rest = z - beta @ t.loadings.T
                out["yhat_base"][:, j] = t.y_mean + beta @ t.v
                out["norm_before"][:, j] = np.linalg.norm(rest, axis=1)
                if interferents > 0:
                    for i in range(len(z)):
                        b, left, _ = correct_sample(z[i], t.loadings, beta[i], model.shape, interferents, max_iter)
                        beta[i] = b
                        out["norm_after"][i, j] = np.linalg.norm(left)
                else:
                    out["norm_after"][:, j] = out["norm_before"][:, j]
                out["yhat"][:, j] = t.y_mean + beta @ t.v
                out["leverage"][:, j] = np.einsum("ij,jk,ik->i", beta, t.scores_inverse, beta) + 1 / model.n
            return out

        return map_blocks(df, run, [(k, "array<double>") for k in _OUTPUTS], ["x"],
                          [c for c in df.columns if c != "x"])

    def explained(self, spark) -> DataFrame:
        rows = [(j, a + 1, float(x), float(y)) for j, t in enumerate(self.targets)
                for a, (x, y) in enumerate(zip(t.x_percent, t.y_percent))]
        return spark.createDataFrame(rows, "response int, component int, x_percent double, y_percent double")

    def figures(self, predicted: DataFrame, cal: DataFrame, interferents: int = 0, confidence: float = 0.95,
                distribution: str = "student", profiles: list[np.ndarray] | None = None) -> DataFrame:
        """Sensitivity, concentration sd, LOD and LOQ ranges per sample and response.

        ``profiles`` are the mode factors of the interferents, projected out of the loadings.
        """
        p, n = int(np.prod(self.shape)), self.n
        a = self.targets[0].loadings.shape[1]
        before = max(1, p - a)
        after = max(1, int(np.prod([max(1, s - interferents) for s in self.shape])) - a) if interferents else before
        factor = 2 * (t_quantile(confidence, n - 1) if distribution == "student" else normal_quantile(confidence))
        high = self._highest_leverage(cal)
        facts = []
        for j, t in enumerate(self.targets):
            sen = sensitivity(t.loadings, t.v, self.shape, profiles if interferents else None)
            uni = t.y_mean ** 2 / (t.y_squares + 1e-12) if abs(t.y_mean) > 1e-12 else 0.0
            facts.append(F.struct(F.lit(j).alias("response"), F.lit(sen).alias("sensitivity"),
                                  F.lit(float(np.sqrt(t.y_residual / n))).alias("s_c"),
                                  F.lit(1 / n + uni).alias("h_min"), F.lit(1 / n + high[j]).alias("h_max")))
        long = predicted.select("ix", "leverage", "norm_after", F.explode(F.array(*facts)).alias("f"))
        s_r = F.get("norm_after", F.col("f.response")) / float(np.sqrt(after))
        sen = F.greatest(F.abs("f.sensitivity"), F.lit(1e-12))
        h = F.get("leverage", F.col("f.response"))
        noise = (s_r / sen) * (s_r / sen)
        limit = lambda hh: factor * F.sqrt(noise * (1 + hh) + hh * F.col("f.s_c") * F.col("f.s_c"))
        return long.select(
            "ix", F.col("f.response").alias("response"), F.col("f.sensitivity").alias("sensitivity"),
            F.sqrt(F.greatest(F.lit(0.0), h * F.col("f.s_c") * F.col("f.s_c") + noise * (1 + h))).alias("sd"),
            h.alias("leverage"), limit(F.col("f.h_min")).alias("lod_min"), limit(F.col("f.h_max")).alias("lod_max"),
            (factor * limit(F.col("f.h_min"))).alias("loq_min"), (factor * limit(F.col("f.h_max"))).alias("loq_max"))

    def _highest_leverage(self, cal: DataFrame) -> np.ndarray:
        """Largest calibration leverage per response, corrected towards the univariate one."""
        def run(c):
            out = []
            for j, t in enumerate(self.targets):
                beta = (c["x"] - self.x_mean) @ t.rotations
                h = np.einsum("ij,jk,ik->i", beta, t.scores_inverse, beta)
                if abs(t.y_mean) > 1e-12:
                    uni = t.y_mean ** 2 / (t.y_squares + 1e-12)
                    h = h + uni * (1 - ((c["y"][:, j] - t.y_mean) / t.y_mean) ** 2)
                out.append(-h.max())
            return np.array(out)

        return -sum_blocks(cal, ["x", "y"], run, lowest=True)


_OUTPUTS = ("yhat", "yhat_base", "norm_before", "norm_after", "leverage")


def npls(ds: Dataset, components: int, method: str = "n_pls") -> NPLSModel:
    """Fit one model per response from a single scan."""
    if method not in ("n_pls", "u_pls"):
        raise ValueError("method is n_pls or u_pls")
    m = moments(ds.cal, "x", "y", width=ds.width)[""]
    targets = []
    for j in range(len(m.y_mean)):
        pick = np.r_[np.arange(m.p), m.p + j]
        one = Moments(m.n, m.mean[pick], m.m2[np.ix_(pick, pick)], m.p)
        targets.append(_unfolded(one, components) if method == "u_pls" else _trilinear(one, components, ds.shape))
    return NPLSModel(method, ds.shape, m.x_mean, targets, int(m.n), ds.y_names)


def _unfolded(m: Moments, components: int) -> Target:
    fit = pls(m, components)
    v = fit.y_loadings[0]
    x_parts = (fit.loadings ** 2).sum(axis=0) * fit.score_squares
    y_parts = v ** 2 * fit.score_squares
    xx, yy = np.trace(m.xx), m.yy[0, 0]
    return Target(fit.loadings, fit.rotations, v, float(m.y_mean[0]), float(yy), float(max(yy - y_parts.sum(), 0)),
                  float(max(xx - x_parts.sum(), 0)), 100 * x_parts / (xx + 1e-12), 100 * y_parts / (yy + 1e-12),
                  np.diag(1 / fit.score_squares))


def rank_one(z: np.ndarray, iterations: int = 100) -> np.ndarray:
    """Flattened unit rank-one direction nearest to a tensor."""
    if z.ndim == 1:
        return z / max(np.linalg.norm(z), 1e-300)
    if z.ndim == 2:
        u, _, vt = np.linalg.svd(z, full_matrices=False)
        w = np.outer(u[:, 0], vt[0]).ravel()
    else:
        vectors = [np.linalg.svd(np.moveaxis(z, i, 0).reshape(z.shape[i], -1), full_matrices=False)[0][:, 0]
                   for i in range(z.ndim)]
        for _ in range(iterations):
            old = [v.copy() for v in vectors]
            for i in range(z.ndim):
                t = z
                for k in reversed([k for k in range(z.ndim) if k != i]):
                    t = np.tensordot(t, vectors[k], axes=(k, 0))
                vectors[i] = t / max(np.linalg.norm(t), 1e-300)
            if max(np.abs(a - b).max() for a, b in zip(old, vectors)) < 1e-12:
                break
        w = vectors[0]
        for v in vectors[1:]:
            w = np.outer(w, v).ravel()
    return w if w @ z.ravel() >= 0 else -w


def _trilinear(m: Moments, components: int, shape) -> Target:
    """Weights are rank-one tensors; X is deflated by t wᵀ, y by its regression on all scores."""
    ws, rs, xs, ys = [], [], [], []
    xx, xy, yy = m.xx, m.xy[:, 0], m.yy[0, 0]
    b = np.zeros(0)
    for _ in range(max(1, min(components, m.p, int(m.n)))):
        left = xy - (xx @ np.array(rs).T @ b if rs else 0)   # Xᵀ(y - Tb)
        for w, r in zip(ws, rs):
            left = left - w * (r @ (xy - (xx @ np.array(rs).T @ b)))
        if np.linalg.norm(left) <= 1e-13 * max(np.linalg.norm(xy), 1e-300):
            break
        w = rank_one(left.reshape(shape))
        r = w - sum((r_old * (w_old @ w) for w_old, r_old in zip(ws, rs)), np.zeros_like(w))
        ws.append(w)
        rs.append(r)
        rot, load = np.array(rs).T, np.array(ws).T
        tt = rot.T @ xx @ rot
        b = np.linalg.pinv(tt, hermitian=True) @ (rot.T @ xy)
        xs.append(np.trace(xx) - 2 * np.trace(load.T @ xx @ rot) + np.trace(tt @ load.T @ load))
        ys.append(yy - 2 * b @ (rot.T @ xy) + b @ tt @ b)
    total = np.trace(xx)
    percent = lambda left, whole: 100 * -np.diff(np.r_[whole, left]) / (whole + 1e-12)
    return Target(load, rot, b, float(m.y_mean[0]), float(yy), float(max(ys[-1], 0)), float(max(xs[-1], 0)),
                  percent(xs, total), percent(ys, yy), np.linalg.pinv(tt, hermitian=True))


# --- residual bi-/trilinearisation --------------------------------------------------------

def low_rank(e: np.ndarray, shape, rank: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nearest part of the residual with ``rank`` components per mode, and its mode factors."""
    t = e.reshape(shape)
    if t.ndim == 2:
        u, s, vt = np.linalg.svd(t, full_matrices=False)
        k = max(1, min(rank, *shape))
        return ((u[:, :k] * s[:k]) @ vt[:k]).ravel(), [u[:, :k], vt[:k].T]
    basis = [np.linalg.svd(np.moveaxis(t, i, 0).reshape(n, -1), full_matrices=False)[0][:, :max(1, min(rank, n))]
             for i, n in enumerate(shape)]
    for _ in range(20):
        for i in range(t.ndim):
            part = t
            for k, f in enumerate(basis):
                if k != i:
                    part = np.moveaxis(np.tensordot(f.T, part, axes=(1, k)), 0, k)
            u = np.linalg.svd(np.moveaxis(part, i, 0).reshape(shape[i], -1), full_matrices=False)[0]
            basis[i] = u[:, :max(1, min(rank, shape[i]))]
    out = t
    for k, f in enumerate(basis):
        out = np.moveaxis(np.tensordot(f @ f.T, out, axes=(1, k)), 0, k)
    return out.ravel(), basis


def outside(t: np.ndarray, shape, basis) -> np.ndarray:
    """Columns of ``t`` (cells × k) projected orthogonal to every mode's interferent factors."""
    x = t.reshape(*shape, -1)
    for k, f in enumerate(basis):
        x = x - np.moveaxis(np.tensordot(f @ f.T, x, axes=(1, k)), 0, k)
    return x.reshape(t.shape)


def correct_sample(x, loadings, start, shape, rank: int, max_iter: int = 50):
    """Scores that leave the least residual after a low-rank part is taken out (Gauss–Newton)."""
    beta = start.copy()

    def state(b):
        e = x - loadings @ b
        part, basis = low_rank(e, shape, rank)
        return e - part, basis

    left, basis = state(beta)
    cost = left @ left
    for _ in range(max_iter):
        step = np.linalg.lstsq(outside(loadings, shape, basis), left, rcond=None)[0]
        reach = 1.0
        while reach > 1e-4:
            trial = beta + reach * step
            new_left, new_basis = state(trial)
            if new_left @ new_left < cost:
                break
            reach /= 2
        else:
            break
        gain = cost - new_left @ new_left
        beta, left, basis, cost = trial, new_left, new_basis, new_left @ new_left
        if gain <= 1e-14 * max(cost, 1e-300):
            break
    return beta, left, basis


def sensitivity(loadings, v, shape, profiles=None) -> float:
    """1/‖pinv(P)ᵀ v‖, P without what the interferent profiles span."""
    p = loadings if profiles is None else outside(loadings, shape, profiles)
    return float(1 / (np.linalg.norm(np.linalg.pinv(p).T @ v) + 1e-12))
