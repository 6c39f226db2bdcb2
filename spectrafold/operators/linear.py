"""Linear calibration models solved from moments: OLS, ridge, lasso, elastic net, PLS, PCR.

A fit never touches the rows again: every candidate of every fold is a small solve on the
driver, so tuning takes two scans whatever the grid.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import map_blocks
from ..dataset import Dataset
from .folds import CV, assign, test_rows, training_rows
from .moments import Moments, moments, total

PATH_KINDS = ("ols", "ridge", "lasso", "elastic_net", "pls", "pcr")


@dataclass(frozen=True)
class LinearFit:
    kind: str
    value: float
    coef: np.ndarray        # variables × responses
    intercept: np.ndarray
    parts: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, x: str = "x", name: str = "yhat") -> DataFrame:
        coef, intercept = self.coef, self.intercept
        return map_blocks(df, lambda c: {name: c[x] @ coef + intercept}, [(name, "array<double>")], [x],
                          [c for c in df.columns if c != name])


@dataclass(frozen=True)
class Projection:
    """Latent directions in (scaled) x: t = ((x - mean)/scale) R, x ≈ t Pᵀ."""

    mean: np.ndarray
    scale: np.ndarray
    rotations: np.ndarray
    loadings: np.ndarray
    weights: np.ndarray
    y_loadings: np.ndarray
    score_squares: np.ndarray   # Σ t² per component
    n: float


def ols(m: Moments) -> LinearFit:
    if m.n <= m.p:
        raise ValueError("OLS needs more samples than variables")
    coef = np.linalg.lstsq(m.xx, m.xy, rcond=None)[0]
    return LinearFit("ols", 0.0, coef, m.y_mean - m.x_mean @ coef)


def ridge(m: Moments, alpha: float) -> LinearFit:
    coef = np.linalg.solve(m.xx + alpha * np.eye(m.p), m.xy)
    return LinearFit("ridge", alpha, coef, m.y_mean - m.x_mean @ coef, {"alpha": alpha})


def elastic_net(m: Moments, alpha: float, l1_ratio: float = 1.0, max_iter: int = 1000,
                tol: float = 1e-8, start: np.ndarray | None = None) -> LinearFit:
    """Coordinate descent on the Gram matrix; several responses share a row-wise penalty.

    Minimises ‖Y - XB‖²/(2n) + alpha·l1_ratio·Σ‖b_j‖ + alpha(1 - l1_ratio)/2·‖B‖².
    """
    gram, cross = m.xx / m.n, m.xy / m.n
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    coef = np.zeros_like(cross) if start is None else start.copy()
    grad = gram @ coef
    curvature = np.diag(gram)
    for _ in range(max(1000, max_iter)):
        largest = 0.0
        for j in range(m.p):
            if curvature[j] <= 0:
                continue
            old = coef[j].copy()
            rho = cross[j] - grad[j] + curvature[j] * old
            size = np.linalg.norm(rho)
            coef[j] = rho * max(0.0, 1 - l1 / size) / (curvature[j] + l2) if size > 0 else 0.0
            step = coef[j] - old
            if np.any(step):
                grad += np.outer(gram[:, j], step)
                largest = max(largest, np.abs(step).max())
        if largest <= tol * max(np.abs(coef).max(), 1e-12):
            break
    return LinearFit("elastic_net", alpha, coef, m.y_mean - m.x_mean @ coef,
                     {"alpha": alpha, "l1_ratio": l1_ratio, "nonzero": int(np.count_nonzero(coef))})


def pls(m: Moments, components: int, scale: bool = False) -> Projection:
    """PLS from cross products (Dayal and MacGregor 1997); one run holds all 1..A models."""
    sx = m.std(1) if scale else np.ones(m.p)
    sy = np.sqrt(np.diag(m.yy) / (m.n - 1)) if scale else np.ones(len(m.y_mean))
    sx, sy = np.where(sx > 0, sx, 1.0), np.where(sy > 0, sy, 1.0)
    gram = m.xx / np.outer(sx, sx)
    cross = m.xy / np.outer(sx, sy)
    size0 = np.linalg.norm(cross)
    ws, rs, ps, qs, taus = [], [], [], [], []
    for _ in range(max(1, min(components, m.p, int(m.n)))):
        if np.linalg.norm(cross) <= 1e-14 * max(size0, 1e-300):
            break
        if cross.shape[1] == 1:
            w = cross[:, 0]
        else:
            _, vectors = np.linalg.eigh(cross.T @ cross)
            w = cross @ vectors[:, -1]
        w = w / np.linalg.norm(w)
        if w[np.argmax(np.abs(w))] < 0:
            w = -w
        r = w.copy()
        for p_old, r_old in zip(ps, rs):
            r -= (p_old @ w) * r_old
        gr = gram @ r
        tau = r @ gr
        if tau <= 1e-14 * np.trace(gram):
            break
        p = gr / tau
        q = cross.T @ r / tau
        cross = cross - np.outer(p, q) * tau
        for store, item in zip((ws, rs, ps, qs, taus), (w, r, p, q, tau)):
            store.append(item)
    if not ws:  # nothing to explain: one null direction keeps shapes usable
        zero = np.zeros(m.p)
        ws, rs, ps, qs, taus = [zero], [zero], [zero], [np.zeros(len(sy))], [1.0]
    return Projection(m.x_mean, sx, np.array(rs).T, np.array(ps).T, np.array(ws).T,
                      np.array(qs).T * sy[:, None], np.array(taus), m.n)


def pls_coefficients(fit: Projection, m: Moments, components: int) -> LinearFit:
    a = min(components, fit.rotations.shape[1])
    coef = (fit.rotations[:, :a] @ fit.y_loadings[:, :a].T) / fit.scale[:, None]
    return LinearFit("pls", components, coef, m.y_mean - m.x_mean @ coef, {"projection": fit, "used": a})


def principal_axes(m: Moments, components: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (n-1) and axes of the covariance; the largest |loading| is positive."""
    values, vectors = np.linalg.eigh(m.xx / (m.n - 1))
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    flip = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(values))])
    vectors = vectors * np.where(flip == 0, 1, flip)
    a = len(values) if components is None else max(1, min(components, m.p, int(m.n)))
    return values[:a], vectors[:, :a]


def pcr_coefficients(m: Moments, components: int, axes=None) -> LinearFit:
    values, vectors = axes or principal_axes(m, components)
    a = min(components, len(values))
    power = values[:a] * (m.n - 1)
    inverse = np.where(power > 1e-12 * max(power.max(), 1e-300), 1 / np.where(power > 0, power, 1), 0)
    q = inverse[:, None] * (vectors[:, :a].T @ m.xy)
    coef = vectors[:, :a] @ q
    fit = Projection(m.x_mean, np.ones(m.p), vectors[:, :a], vectors[:, :a], vectors[:, :a], q.T, power, m.n)
    return LinearFit("pcr", components, coef, m.y_mean - m.x_mean @ coef, {"projection": fit, "used": a})


def path(kind: str, m: Moments, values: list, **hp) -> list[LinearFit]:
    """The fits of all candidates from one set of moments."""
    if kind == "ols":
        return [ols(m) for _ in values]
    if kind == "ridge":
        return [ridge(m, float(v)) for v in values]
    if kind in ("lasso", "elastic_net"):
        ratio = 1.0 if kind == "lasso" else float(hp.get("l1_ratio", 0.5))
        done, start = {}, None
        for v in sorted(values, reverse=True):  # warm start from the strongest penalty
            done[v] = elastic_net(m, float(v), ratio, hp.get("max_iter", 1000), start=start)
            start = done[v].coef
        return [done[v] for v in values]
    if kind == "pls":
        fit = pls(m, int(max(values)), bool(hp.get("scale", False)))
        return [pls_coefficients(fit, m, int(v)) for v in values]
    if kind == "pcr":
        axes = principal_axes(m, int(max(values)))
        return [pcr_coefficients(m, int(v), axes) for v in values]
    raise ValueError(f"unknown linear model {kind}")


def _stack(fits: list[LinearFit]) -> tuple[np.ndarray, np.ndarray]:
    return np.hstack([f.coef for f in fits]), np.concatenate([f.intercept for f in fits])


def predict_path(df: DataFrame, fits: list[LinearFit], name: str = "yhat") -> DataFrame:
    """All candidates at once; value c·q + j is candidate c, response j."""
    coef, intercept = _stack(fits)
    return map_blocks(df, lambda c: {name: c["x"] @ coef + intercept}, [(name, "array<double>")], ["x"],
                      [c for c in df.columns if c not in ("x", name)])


def cross_predict(df: DataFrame, kind: str, values: list, cv: CV, width: int, n: int | None = None,
                  **hp) -> DataFrame:
    """Out-of-fold predictions (ix, fold, y, yhat) of every candidate, in two scans.

    ``df`` holds (ix, x, y) with dense ``ix``. Rows no fold tests are absent; strategies that
    test a row several times give several rows.
    """
    assigned = assign(df.select("ix", "x", "y", *[c for c in ("classes",) if c in df.columns]), cv, n)
    if cv.strategy == "loocv":
        whole = moments(assigned, "x", "y", width=width)[""]
        if kind in ("ols", "ridge"):
            own = _left_out(whole, [0.0 if kind == "ols" else float(v) for v in values])
            return map_blocks(assigned, own, [("yhat", "array<double>")], ["x", "y"], ["ix", "fold", "y"])
        if kind in ("pls", "pcr") and whole.n > 2:
            counts = [int(v) for v in values]
            own = _left_out_pls(whole, counts, bool(hp.get("scale", False))) if kind == "pls" else _left_out_pcr(whole, counts)
            return map_blocks(assigned, own, [("yhat", "array<double>")], ["x", "y"], ["ix", "fold", "y"])

        def own(c):
            out = []
            for x, y in zip(c["x"], c["y"]):
                one = Moments(1.0, np.concatenate([x, y]), np.zeros_like(whole.m2), whole.p)
                coef, intercept = _stack(path(kind, whole - one, values, **hp))
                out.append(x @ coef + intercept)
            return {"yhat": np.array(out)}

        return map_blocks(assigned, own, [("yhat", "array<double>")], ["x", "y"], ["ix", "fold", "y"])
    if cv.partitions:
        parts = moments(assigned, "x", "y", key="fold", width=width)
        whole = total(parts.values())
        models = {int(f): _stack(path(kind, whole - part, values, **hp)) for f, part in parts.items()}
        rows = assigned
    else:
        parts = moments(training_rows(assigned), "x", "y", key="fold", weight="weight", width=width)
        models = {int(f): _stack(path(kind, part, values, **hp)) for f, part in parts.items()}
        rows = test_rows(assigned)

    def fold_models(c):
        folds = c["fold"].astype(int)
        out = np.empty((len(folds), next(iter(models.values()))[0].shape[1]))
        for f in np.unique(folds):
            coef, intercept = models[f]
            out[folds == f] = c["x"][folds == f] @ coef + intercept
        return {"yhat": out}

    return map_blocks(rows, fold_models, [("yhat", "array<double>")], ["x", "fold"], ["ix", "fold", "y"])


def _left_out(m: Moments, penalties: list[float]):
    """Leave-one-out predictions of ridge fits: y - e / (1 - h), the exact shortcut of a linear
    smoother, for a whole block of rows at once."""
    parts = []
    for alpha in penalties:
        inverse = np.linalg.pinv(m.xx + alpha * np.eye(m.p), hermitian=True)
        parts.append((inverse, inverse @ m.xy))

    def run(c):
        z = c["x"] - m.x_mean
        out = []
        for inverse, coef in parts:
            h = 1 / m.n + np.einsum("ij,jk,ik->i", z, inverse, z)
            e = c["y"] - m.y_mean - z @ coef
            out.append(c["y"] - e / (1 - h)[:, None])
        return {"yhat": np.hstack(out)}

    return run


def pieces(rows: int, numbers: int):
    """Slices of a block whose work arrays hold about 4 million numbers at ``numbers`` a row."""
    step = max(1, (1 << 22) // max(numbers, 1))
    return [slice(a, a + step) for a in range(0, max(rows, 1), step)]


def _chosen(steps: list[np.ndarray], counts: list[int]) -> np.ndarray:
    """Predictions of the wanted numbers of components from those of 1..A, side by side."""
    return np.hstack([steps[max(1, min(v, len(steps))) - 1] for v in counts])


def _left_out_pls(m: Moments, counts: list[int], scale: bool):
    """Leave-one-out predictions of PLS fits for whole blocks of rows.

    Without a row that lies d from the mean the cross products are XX - f d dᵀ, f = n / (n - 1). Products with them
    are products with XX and a rank-one correction, so no row has a matrix of its own.
    """
    xx, xy, yy, f, n = m.xx, m.xy, np.diag(m.yy), m.n / (m.n - 1), m.n - 1
    most = max(1, min(max(counts), m.p, int(n)))
    responses = xy.shape[1]

    def predict(x, y):
        d, e = x - m.x_mean, y - m.y_mean
        power = np.maximum(np.diag(xx) - f * d * d, 0)
        sx, sy = np.ones_like(d), np.ones_like(e)
        if scale:
            sx, sy = np.sqrt(power / (n - 1)), np.sqrt(np.maximum(yy - f * e * e, 0) / (n - 1))
            sx, sy = np.where(sx > 0, sx, 1.0), np.where(sy > 0, sy, 1.0)
        trace = (power / sx ** 2).sum(axis=1)
        cross = (xy - f * d[:, :, None] * e[:, None, :]) / (sx[:, :, None] * sy[:, None, :])
        z = f * d / sx  # the row itself, from the mean of the others
        yhat, alive = m.y_mean - e / n, np.ones(len(x), bool)
        size0 = np.maximum(np.linalg.norm(cross, axis=(1, 2)), 1e-300)
        steps, rotations, loadings = [], [], []
        for _ in range(most):
            alive &= np.linalg.norm(cross, axis=(1, 2)) > 1e-14 * size0
            if responses == 1:
                w = cross[:, :, 0]
            else:
                _, vectors = np.linalg.eigh(np.einsum("ipa,ipb->iab", cross, cross))
                w = np.einsum("ipa,ia->ip", cross, vectors[:, :, -1])
            norm = np.linalg.norm(w, axis=1, keepdims=True)
            w = w / np.where(norm > 0, norm, 1.0)
            r = w.copy()
            for p_old, r_old in zip(loadings, rotations):
                r -= np.einsum("ip,ip->i", p_old, w)[:, None] * r_old
            plain = r / sx
            gr = (plain @ xx - f * d * np.einsum("ip,ip->i", d, plain)[:, None]) / sx
            tau = np.einsum("ip,ip->i", r, gr)
            alive &= tau > 1e-14 * trace
            tau = np.where(alive, tau, 1.0)[:, None]
            r, load = r * alive[:, None], gr * alive[:, None] / tau  # a fit that ended gains nothing more
            q = np.einsum("ipa,ip->ia", cross, r) / tau
            cross = cross - load[:, :, None] * (q * tau)[:, None, :]
            yhat = yhat + np.einsum("ip,ip->i", z, r)[:, None] * q * sy
            steps.append(yhat)
            rotations.append(r)
            loadings.append(load)
        return _chosen(steps, counts)

    def run(c):
        cut = pieces(len(c["x"]), m.p * (2 * most + 3 * responses + 6))
        return {"yhat": np.vstack([predict(c["x"][s], c["y"][s]) for s in cut])}

    return run


def left_out_axes(m: Moments, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covariance eigenvalues, falling, and axes of the others for each row (``d`` from the mean of all), in one call."""
    f = m.n / max(m.n - 1, 1)
    values, vectors = np.linalg.eigh((m.xx - f * d[:, :, None] * d[:, None, :]) / max(m.n - 2, 1))
    values, vectors = np.maximum(values[:, ::-1], 0), vectors[:, :, ::-1]
    top = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None, :], axis=1)
    return values, vectors * np.where(top < 0, -1, 1)


def _left_out_pcr(m: Moments, counts: list[int]):
    """Leave-one-out predictions of PCR fits for whole blocks of rows."""
    f, n = m.n / (m.n - 1), m.n - 1
    most = max(1, min(max(counts), m.p, int(n)))

    def predict(x, y):
        d, e = x - m.x_mean, y - m.y_mean
        values, axes = left_out_axes(m, d)
        axes, power = axes[:, :, :most], values[:, :most] * (n - 1)
        inverse = np.where(power > 1e-12 * np.maximum(power.max(axis=1, keepdims=True), 1e-300), 1 / np.where(power > 0, power, 1), 0)
        q = inverse[:, :, None] * (axes.transpose(0, 2, 1) @ m.xy - f * np.einsum("ipa,ip->ia", axes, d)[:, :, None] * e[:, None, :])
        gains = (f * np.einsum("ipa,ip->ia", axes, d))[:, :, None] * q
        return _chosen(list((m.y_mean - e / n)[None] + np.cumsum(gains, axis=1).transpose(1, 0, 2)), counts)

    def run(c):
        return {"yhat": np.vstack([predict(c["x"][s], c["y"][s]) for s in pieces(len(c["x"]), 3 * m.p ** 2)])}

    return run


def long_predictions(wide: DataFrame, values: list, responses: int, keep=("ix", "fold")) -> DataFrame:
    """(…, candidate, response, y, yhat) from the array form."""
    names = F.array(*[F.lit(float(v)) for v in values])
    return (wide.select(*keep, "y", F.posexplode("yhat").alias("_p", "yhat"))
            .withColumn("candidate", F.get(names, F.floor(F.col("_p") / responses).cast("int")))
            .withColumn("response", (F.col("_p") % responses).cast("int"))
            .withColumn("y", F.get("y", F.col("response")))
            .select(*keep, "candidate", "response", "y", "yhat"))


def curve(long: DataFrame) -> DataFrame:
    """RMSE and R² per candidate over all responses, one aggregation."""
    per = long.groupBy("candidate", "response").agg(
        F.count("*").alias("n"), F.sum(F.pow(F.col("y") - F.col("yhat"), 2)).alias("sse"),
        (F.var_pop("y") * F.count("*")).alias("sst"))
    return per.groupBy("candidate").agg(
        F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"),
        F.when(F.sum("sst") > 0, 1 - F.sum("sse") / F.sum("sst")).alias("r2")).orderBy("candidate")


def diagnostics(df: DataFrame, fit: Projection, name_q: str = "q") -> DataFrame:
    """Scores, leverage, Hotelling T² and Q residual per sample, row-locally."""
    tau, n = fit.score_squares, fit.n

    def run(c):
        z = (c["x"] - fit.mean) / fit.scale
        t = z @ fit.rotations
        safe = np.where(tau > 0, tau, np.inf)
        share = (t * t / safe).sum(axis=1)
        rest = z - t @ fit.loadings.T
        return {"scores": t, "leverage": share, "t2": share * (n - 1), name_q: (rest * rest).sum(axis=1)}

    keep = [c for c in df.columns if c != "x"]
    return map_blocks(df, run, [("scores", "array<double>"), ("leverage", "double"), ("t2", "double"),
                                (name_q, "double")], ["x"], keep)


def y_residual_variance(fit: Projection, m: Moments) -> np.ndarray:
    """Mean response variance left after 1..A components."""
    explained = np.cumsum(fit.y_loadings ** 2 * fit.score_squares[None, :], axis=1)
    return ((np.diag(m.yy)[:, None] - explained) / m.n).mean(axis=0)


def response_count(ds: Dataset) -> int:
    return len(ds.y_names) or ds.df.select(F.size("y").alias("q")).first()["q"]
