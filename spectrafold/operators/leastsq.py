"""Small non-negative and penalised least squares shared by the alternating models."""

from __future__ import annotations

import numpy as np


def nnls_rows(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """min ½ xᵀGx - fᵀx, x ≥ 0, for every row f of ``rhs`` (Kim and Park 2011).

    Block principal pivoting: rows that share a set of positive places share one solve. With a stack of
    matrices every row has its own; all of them are solved in one call, left-out places as identity rows.
    """
    n, r = rhs.shape
    stacked = gram.ndim == 3
    trace = np.trace(gram, axis1=-2, axis2=-1)
    gram = gram + 1e-14 * np.maximum(trace / max(r, 1), 1e-300)[..., None, None] * np.eye(r)
    x = np.zeros((n, r))
    y = -rhs.copy()
    passive = np.zeros((n, r), dtype=bool)
    allowance = np.full(n, 3)
    least = np.full(n, r + 1)
    scale = 1e-12 * (np.abs(rhs).max(axis=1 if stacked else None, keepdims=True, initial=0) + 1e-300)
    for _ in range(100 * r + 100):
        bad = (passive & (x < 0)) | (~passive & (y < -scale))
        count = bad.sum(axis=1)
        rows = np.flatnonzero(count)
        if not len(rows):
            break
        fewer = count[rows] < least[rows]
        full = rows[fewer | (allowance[rows] > 0)]
        allowance[rows[~fewer]] -= 1
        least[rows[fewer]] = count[rows[fewer]]
        allowance[rows[fewer]] = 3
        single = np.setdiff1d(rows, full)
        passive[full] ^= bad[full]
        if len(single):  # backup rule: exchange the last infeasible place only
            last = r - 1 - bad[single][:, ::-1].argmax(axis=1)
            passive[single, last] ^= True
        if stacked:
            on, own = passive[rows], gram[rows]
            system = np.where(on[:, :, None] & on[:, None, :], own, np.eye(r))
            x[rows] = np.linalg.solve(system, np.where(on, rhs[rows], 0.0)[:, :, None])[:, :, 0]
            y[rows] = np.where(on, 0.0, np.einsum("jab,jb->ja", own, x[rows]) - rhs[rows])
            continue
        codes = passive[rows] @ (1 << np.arange(r, dtype=np.int64))
        for code in np.unique(codes):
            group = rows[codes == code]
            on = passive[group[0]]
            x[group] = 0.0
            if on.any():
                x[np.ix_(group, on)] = np.linalg.solve(gram[np.ix_(on, on)], rhs[np.ix_(group, on)].T).T
            y[group] = x[group] @ gram - rhs[group]
            y[np.ix_(group, on)] = 0.0
    return np.maximum(x, 0.0)


def ols_rows(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    return rhs @ np.linalg.pinv(gram, hermitian=True)


def khatri_rao(factors) -> np.ndarray:
    """Column-wise Kronecker product, first factor slowest (C order)."""
    out = factors[0]
    for f in factors[1:]:
        out = (out[:, None, :] * f[None, :, :]).reshape(-1, f.shape[1])
    return out


def monotone(v: np.ndarray, rising: bool = True) -> np.ndarray:
    """Isotonic regression by pooling adjacent violators."""
    v = v if rising else v[::-1]
    level, weight = [], []
    for item in v:
        level.append(float(item))
        weight.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            w = weight[-2] + weight[-1]
            level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / w]
            weight[-2:] = [w]
    out = np.repeat(level, weight)
    return out if rising else out[::-1]


def unimodal(v: np.ndarray) -> np.ndarray:
    """Best rise-then-fall fit over all peak places."""
    best, loss = v, np.inf
    for peak in range(len(v)):
        fit = np.concatenate([monotone(v[:peak + 1]), monotone(v[peak + 1:], rising=False)])
        gap = ((fit - v) ** 2).sum()
        if gap < loss and (peak + 1 == len(v) or fit[peak] >= fit[peak + 1]):
            best, loss = fit, gap
    return best


def simplex(v: np.ndarray, size: float) -> np.ndarray:
    """Projection on {x ≥ 0, Σx = size}."""
    u = np.sort(v)[::-1]
    excess = (np.cumsum(u) - size) / np.arange(1, len(v) + 1)
    k = np.flatnonzero(u > excess)
    return np.maximum(v - excess[k[-1]], 0.0) if len(k) else np.maximum(v - excess[0], 0.0)


def l1_ball(v: np.ndarray, size: float) -> np.ndarray:
    if np.abs(v).sum() <= size:
        return v
    return np.sign(v) * simplex(np.abs(v), size)


def proximal(f: np.ndarray, kind: str, strength: float) -> np.ndarray:
    """Proximal map of a factor constraint, per column where the constraint is a column's."""
    columns = lambda fn: np.stack([fn(c) for c in f.T], axis=1)
    if kind == "non_negative":
        return np.maximum(f, 0.0)
    if kind == "l1_reg":
        return np.sign(f) * np.maximum(np.abs(f) - strength, 0.0)
    if kind == "l2_reg":
        norm = np.linalg.norm(f)
        return f * max(0.0, 1 - strength / norm) if norm > 0 else f
    if kind == "l2_square_reg":
        return f / (1 + 2 * strength)
    if kind == "unimodality":
        return columns(lambda c: unimodal(np.maximum(c, 0.0)))
    if kind == "normalize":
        top = np.abs(f).max()
        return f / top if top > 0 else f
    if kind == "simplex":
        return columns(lambda c: simplex(c, strength))
    if kind == "normalized_sparsity":
        sparse = columns(lambda c: _keep_largest(c, int(strength)))
        norm = np.linalg.norm(sparse, axis=0)
        return sparse / np.where(norm > 0, norm, 1.0)
    if kind == "soft_sparsity":
        return columns(lambda c: l1_ball(c, strength))
    if kind == "smoothness":
        n = len(f)
        lap = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
        return np.linalg.solve(np.eye(n) + strength * lap, f)
    if kind == "monotonicity":
        return columns(monotone)
    if kind == "hard_sparsity":
        return columns(lambda c: _keep_largest(c, int(strength)))
    raise ValueError(f"unknown constraint {kind}")


def _keep_largest(v: np.ndarray, k: int) -> np.ndarray:
    if k >= len(v):
        return v
    out = np.zeros_like(v)
    top = np.argsort(-np.abs(v), kind="stable")[:k]
    out[top] = v[top]
    return out


def constrained_factor(gram: np.ndarray, cross: np.ndarray, constraints: dict[str, float],
                       start: np.ndarray | None = None, rounds: int = 100, tol: float = 1e-8) -> np.ndarray:
    """Factor F minimising ½tr(F G Fᵀ) - tr(Fᵀ M) under constraints, by ADMM splitting.

    Non-negativity alone is solved exactly.
    """
    if not constraints:
        return ols_rows(gram, cross)
    if set(constraints) == {"non_negative"}:
        return nnls_rows(gram, cross)
    rho = max(np.trace(gram) / len(gram), 1e-12)
    inverse = np.linalg.inv(gram + rho * np.eye(len(gram)))
    z = ols_rows(gram, cross) if start is None else start.copy()
    return _split(lambda v: (cross + rho * v) @ inverse, z, rho, constraints, rounds, tol)


def constrained_rows(grams: np.ndarray, cross: np.ndarray, constraints: dict[str, float], start: np.ndarray,
                     rounds: int = 100, tol: float = 1e-8) -> np.ndarray:
    """``constrained_factor`` where every row has normal equations of its own, as with missing cells."""
    if not constraints:
        return np.einsum("jab,jb->ja", np.linalg.pinv(grams, hermitian=True), cross)
    if set(constraints) == {"non_negative"}:
        return nnls_rows(grams, cross)
    k = grams.shape[1]
    rho = max(np.trace(grams.mean(axis=0)) / k, 1e-12)
    inverse = np.linalg.inv(grams + rho * np.eye(k))
    return _split(lambda v: np.einsum("jab,jb->ja", inverse, cross + rho * v), start.copy(), rho, constraints, rounds, tol)


def _split(solve, z, rho, constraints, rounds, tol):
    u = np.zeros_like(z)
    for _ in range(rounds):
        f = solve(z - u)
        old, z = z, f + u
        for kind, strength in constraints.items():
            scaled = strength / rho if kind in ("l1_reg", "l2_reg", "l2_square_reg", "smoothness") else strength
            z = proximal(z, kind, scaled)
        u = u + f - z
        if np.linalg.norm(z - f) <= tol * np.linalg.norm(z) and np.linalg.norm(z - old) <= tol * np.linalg.norm(z):
            break
    return z
