"""Kernel models on explicit features: support vector machines and a Gaussian process.

Feature maps are row-local; the models are primal and fitted by L-BFGS whose gradients are sums
over the rows, one scan per step for all classes, responses and folds together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import few_tasks, map_blocks, sum_blocks
from .moments import moments
from .stats import exact_quantiles

_SMOOTH = 0.05       # width of the rounded corner of the hinge
_TUBE_SMOOTH = 0.25  # and of the ε-insensitive loss, relative to ε


@dataclass(frozen=True)
class Features:
    """linear, rbf (random Fourier) or poly (random Maclaurin) feature map with fixed draws."""

    kind: str
    weights: np.ndarray | None = None
    shift: np.ndarray | None = None
    offset: float = 0.0
    degree: int = 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "linear":
            return x
        if self.kind == "rbf":
            return np.sqrt(2.0 / self.weights.shape[1]) * np.cos(x @ self.weights + self.shift)
        lifted = np.hstack([x, np.full((len(x), 1), self.offset)])
        out = np.ones((len(x), self.weights.shape[2]))
        for w in self.weights:
            out *= lifted @ w
        return out / np.sqrt(self.weights.shape[2])


def features(kind: str, width: int, gamma: float = 1.0, size: int = 256, degree: int = 3, coef0: float = 0.0,
             seed: int = 42) -> Features:
    rng = np.random.default_rng(seed)
    if kind == "linear":
        return Features("linear")
    if kind == "rbf":
        return Features("rbf", rng.normal(scale=np.sqrt(2 * gamma), size=(width, size)),
                        rng.uniform(0, 2 * np.pi, size))
    if kind == "poly":
        signs = rng.choice([-1.0, 1.0], size=(degree, width + 1, size))
        signs[:, :width] *= np.sqrt(gamma)
        return Features("poly", signs, offset=float(np.sqrt(max(coef0, 0.0))), degree=degree)
    raise ValueError("kernel is linear, rbf or poly")


def map_features(df: DataFrame, f: Features) -> DataFrame:
    if f.kind == "linear":
        return df
    return map_blocks(df, lambda c: {"x": f(c["x"])}, [("x", "array<double>")], ["x"],
                      [c for c in df.columns if c != "x"]).select(*df.columns)


def scale_gamma(df: DataFrame, width: int) -> float:
    """1 / (variables · variance of all values)."""
    m = moments(df, "x", width=width)[""]
    n = m.n * m.p
    spread = np.trace(m.xx) + m.n * ((m.x_mean - m.x_mean.mean()) ** 2).sum()
    return float(n / (m.p * spread)) if spread > 0 else 1.0


def minimise(value_and_gradient, start: np.ndarray, max_iter: int = 100, tol: float = 1e-6) -> np.ndarray:
    """L-BFGS with Armijo steps; an evaluation is one scan."""
    w = start
    value, grad = value_and_gradient(w)
    steps, turns = [], []
    for _ in range(max_iter):
        if np.linalg.norm(grad) <= tol * max(1.0, np.linalg.norm(w)):
            break
        direction = -grad
        held = []
        for s, y in reversed(list(zip(steps, turns))):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            held.append(a)
        if steps:
            direction = direction * (steps[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
        for (s, y), a in zip(zip(steps, turns), reversed(held)):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        slope = grad @ direction
        if slope >= 0:
            direction, slope, steps, turns = -grad, -(grad @ grad), [], []
        reach = 1.0 if steps else min(1.0, 1.0 / max(np.linalg.norm(grad), 1e-12))
        for _ in range(30):
            trial, trial_grad = value_and_gradient(w + reach * direction)
            if trial <= value + 1e-4 * reach * slope:
                break
            reach /= 2
        else:
            break
        s, y = reach * direction, trial_grad - grad
        if s @ y > 1e-12 * (y @ y):
            steps, turns = (steps + [s])[-10:], (turns + [y])[-10:]
        done = value - trial <= 1e-7 * max(abs(value), 1e-12)
        w, value, grad = w + s, trial, trial_grad
        if done:
            break
    return w


def _rounded(t: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """max(0, t) with a quadratic corner, and its slope."""
    inside = np.clip(t, 0, width)
    return inside * inside / (2 * width) + np.maximum(t - width, 0), inside / width


# --- regression ---------------------------------------------------------------------------

@dataclass(frozen=True)
class KernelRegressor:
    feature: Features
    coef: np.ndarray
    intercept: np.ndarray
    covariance: np.ndarray | None = None   # weight covariance of the Gaussian process
    y_scale: np.ndarray | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """yhat and, for the Gaussian process, sd of the latent function."""
        def run(c):
            z = self.feature(c["x"])
            out = {"yhat": z @ self.coef + self.intercept}
            if self.covariance is not None:
                spread = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, self.covariance, z), 0))
                out["sd"] = spread[:, None] * self.y_scale
            return out

        fields = [("yhat", "array<double>")] + ([("sd", "array<double>")] if self.covariance is not None else [])
        return map_blocks(df, run, fields, ["x"], [c for c in df.columns if c not in ("x", "yhat", "sd")])


def svr(df: DataFrame, feature: Features, c: float = 1.0, epsilon: float = 0.1, max_iter: int = 200) -> KernelRegressor:
    """½‖w‖² + C Σ max(0, |y - f| - ε) per response, all responses in one optimisation."""
    data = map_features(df.select("x", "y"), feature).persist()
    try:
        first = data.select(F.size("x").alias("p"), F.size("y").alias("q")).first()
        p, q = first["p"], first["q"]
        width = max(epsilon, 1e-3) * _TUBE_SMOOTH
        few = few_tasks(data)

        def objective(flat):
            w = flat.reshape(p + 1, q)

            def run(cols):
                z, e = cols["x"], cols["y"] - (cols["x"] @ w[:p] + w[p])
                loss, slope = _rounded(np.abs(e) - epsilon, width)
                g = -np.sign(e) * slope
                return np.concatenate([[loss.sum()], np.vstack([z.T @ g, g.sum(0)]).ravel()])

            out = sum_blocks(data, ["x", "y"], run, few)
            grad = c * out[1:].reshape(p + 1, q)
            grad[:p] += w[:p]
            return c * out[0] + 0.5 * (w[:p] ** 2).sum(), grad.ravel()

        start = np.zeros((p + 1, q))
        start[p] = sum_blocks(data, ["y"], lambda cols: np.r_[cols["y"].sum(0), len(cols["y"])], few)[:q] / \
            max(data.count(), 1)
        w = minimise(objective, start.ravel(), max_iter).reshape(p + 1, q)
        return KernelRegressor(feature, w[:p], w[p])
    finally:
        data.unpersist()


def gaussian_process(df: DataFrame, feature: Features, alpha: float = 1e-2, constant: float = 1.0,
                     normalize_y: bool = False) -> KernelRegressor:
    """Bayesian ridge on random Fourier features: mean and sd from one scan of moments."""
    mapped = map_features(df.select("x", "y"), feature)
    m = moments(mapped, "x", "y")[""]
    scale = np.where(m.yy.diagonal() > 0, np.sqrt(m.yy.diagonal() / m.n), 1.0) if normalize_y else np.ones(len(m.y_mean))
    shift = m.y_mean if normalize_y else np.zeros(len(m.y_mean))
    gram = constant * (m.xx + m.n * np.outer(m.x_mean, m.x_mean))
    cross = np.sqrt(constant) * (m.xy + m.n * np.outer(m.x_mean, m.y_mean - shift)) / scale
    inverse = np.linalg.inv(gram + alpha * np.eye(m.p))
    coef = np.sqrt(constant) * (inverse @ cross) * scale
    return KernelRegressor(feature, coef, shift, alpha * constant * inverse, scale)


# --- classification -----------------------------------------------------------------------

@dataclass(frozen=True)
class MarginClassifier:
    feature: Features
    classes: tuple[str, ...]
    coef: np.ndarray
    intercept: np.ndarray
    platt: np.ndarray      # (a, b) per class

    def predict(self, df: DataFrame) -> DataFrame:
        names = np.array(self.classes)

        def run(c):
            margin = self.feature(c["x"]) @ self.coef + self.intercept
            p = 1 / (1 + np.exp(np.clip(self.platt[0] * margin + self.platt[1], -40, 40)))
            size = p.sum(axis=1, keepdims=True)
            return {"pred": pa.array(names[margin.argmax(1)].tolist()), "decision": margin,
                    "proba": p / np.where(size > 0, size, 1)}

        return map_blocks(df, run, [("pred", "string"), ("decision", "array<double>"), ("proba", "array<double>")],
                          ["x"], [c for c in df.columns if c not in ("x", "pred", "decision", "proba")])


def svc(df: DataFrame, label: str, feature: Features, c: float = 1.0, balanced: bool = False, folds: int = 5,
        max_iter: int = 100) -> MarginClassifier:
    """One-vs-rest hinge machines with probabilities from out-of-fold margins (Platt).

    The full model and the fold models are columns of one weight matrix, so every step of the
    optimisation scans the data once.
    """
    named = df.select("ix", F.col(label).cast("string").alias("k"), "x")
    counts = {r["k"]: r["count"] for r in named.groupBy("k").count().collect()}
    names = sorted(counts)
    n = sum(counts.values())
    weight = {k: n / (len(names) * counts[k]) if balanced else 1.0 for k in names}
    data = map_features(named, feature).withColumn("fold", F.pmod(F.xxhash64("ix"), F.lit(folds)).cast("int"))
    code = F.array_position(F.array(*[F.lit(k) for k in names]), F.col("k")).cast("int") - 1
    data = data.withColumn("code", code).select("x", "code", "fold").persist()
    try:
        p = data.select(F.size("x").alias("p")).first()["p"]
        q, per_class = len(names), np.array([weight[k] for k in names])
        few = few_tasks(data)

        def run_for(w):
            def run(cols):
                z, code, fold = cols["x"], cols["code"].astype(int), cols["fold"].astype(int)
                y = np.where(code[:, None] == np.arange(q), 1.0, -1.0)
                margin = np.einsum("np,pqf->nqf", z, w[:p]) + w[p]
                loss, slope = _rounded(1 - y[:, :, None] * margin, _SMOOTH)
                own = per_class[code][:, None, None] * np.concatenate(
                    [np.ones((len(z), 1)), (fold[:, None] != np.arange(folds))], axis=1)[:, None, :]
                g = -y[:, :, None] * slope * own
                return np.concatenate([[(loss * own).sum()], np.einsum("np,nqf->pqf", z, g).ravel(), g.sum(0).ravel()])

            return run

        def objective(flat):
            w = flat.reshape(p + 1, q, folds + 1)
            out = sum_blocks(data, ["x", "code", "fold"], run_for(w), few)
            grad = c * out[1:].reshape(p + 1, q, folds + 1)
            grad[:p] += w[:p]
            return c * out[0] + 0.5 * (w[:p] ** 2).sum(), grad.ravel()

        w = minimise(objective, np.zeros((p + 1) * q * (folds + 1)), max_iter).reshape(p + 1, q, folds + 1)

        def held_out(cols):
            """Out-of-fold margins and ±1 targets of a block."""
            fold = cols["fold"].astype(int)
            margin = np.empty((len(fold), q))
            for f in np.unique(fold):
                at = fold == f
                margin[at] = cols["x"][at] @ w[:p, :, f + 1] + w[p, :, f + 1]
            return margin, (cols["code"].astype(int)[:, None] == np.arange(q)).astype(float)

        positive = np.array([counts[k] for k in names], dtype=float)
        high, low = (positive + 1) / (positive + 2), 1 / (n - positive + 2)

        def likelihood(flat):
            a, b = flat.reshape(2, q)

            def run(cols):
                margin, hit = held_out(cols)
                target = np.where(hit > 0, high, low)
                t = np.clip(a * margin + b, -40, 40)
                prob = 1 / (1 + np.exp(t))
                loss = -(target * np.log(prob) + (1 - target) * np.log1p(-prob)).sum()
                g = target - prob
                return np.concatenate([[loss], (g * margin).sum(0), g.sum(0)])

            out = sum_blocks(data, ["x", "code", "fold"], run, few)
            return out[0] / n, out[1:] / n

        begin = np.vstack([-np.ones(q), np.log((n - positive + 1) / (positive + 1))])
        platt = minimise(likelihood, begin.ravel(), 50, 1e-7).reshape(2, q)
        return MarginClassifier(feature, tuple(names), w[:p, :, 0], w[p, :, 0], platt)
    finally:
        data.unpersist()


# --- one-class ----------------------------------------------------------------------------

@dataclass(frozen=True)
class OneClassMachine:
    feature: Features
    coef: np.ndarray
    rho: float

    def score(self, df: DataFrame) -> DataFrame:
        return map_blocks(df, lambda c: {"score": self.feature(c["x"]) @ self.coef - self.rho},
                          [("score", "double")], ["x"], [c for c in df.columns if c not in ("x", "score")])


def one_class_svm(df: DataFrame, feature: Features, nu: float = 0.1, max_iter: int = 100) -> OneClassMachine:
    """½‖w‖² - ρ + Σ max(0, ρ - w·z)/(νn); ρ is then the exact ν quantile of the margins."""
    data = map_features(df.select("x"), feature).persist()
    try:
        p = data.select(F.size("x").alias("p")).first()["p"]
        few = few_tasks(data)
        base = sum_blocks(data, ["x"], lambda c: np.r_[c["x"].sum(0), len(c["x"])], few)
        n, mean = base[-1], base[:-1] / base[-1]
        scale = max(float(mean @ mean), 1e-12)
        width = _SMOOTH * scale

        def objective(flat):
            w, rho = flat[:p], flat[p]

            def run(c):
                loss, slope = _rounded(rho - c["x"] @ w, width)
                return np.concatenate([[loss.sum()], -(c["x"].T @ slope), [slope.sum()]])

            out = sum_blocks(data, ["x"], run, few) / (nu * n)
            return out[0] + 0.5 * (w @ w) - rho, np.r_[out[1:-1] + w, out[-1] - 1.0]

        flat = minimise(objective, np.r_[mean, scale], max_iter)
        w = flat[:p]
        margins = map_blocks(data, lambda c: {"value": c["x"] @ w}, [("value", "double")], ["x"], [])
        rho = exact_quantiles(margins.select(F.lit(0).alias("pos"), "value"), [nu])[(0,)][0]
        return OneClassMachine(feature, w, float(rho))
    finally:
        data.unpersist()


