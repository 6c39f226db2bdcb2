"""CP decomposition (PARAFAC) of samples × way 1 × way 2 × …

The sample factor has as many rows as there are samples and is never collected: given the
instrument factors each row is a small least-squares problem of its own. A pass returns AᵀA and
AᵀX, from which the driver updates every instrument factor in turn; several starts, or several
sample-by-sample refits, share the pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import few_tasks, map_blocks, sum_blocks
from ..dataset import Dataset
from . import nearby, refits
from .leastsq import constrained_factor, constrained_rows, khatri_rao, nnls_rows

# constraints that act on each sample's row alone
_ROW_LOCAL = ("non_negative", "l1_reg", "l2_square_reg")


@dataclass(frozen=True)
class CPModel:
    factors: list[np.ndarray]        # instrument factors, unit columns
    shape: tuple[int, ...]
    constraints: list[dict[str, float]]
    sse: float
    sfit: float
    explained: float
    core_consistency: float
    iterations: int
    start: int = 0
    history: list = field(default_factory=list)
    missing: str = "none"

    def transform(self, df: DataFrame) -> DataFrame:
        """Sample scores by least squares on the observed cells, and the residual squares."""
        design, rule = khatri_rao(self.factors), self.constraints[0]

        def run(c):
            a, fitted = _rows(c["x"], design, rule)
            rest = np.where(np.isfinite(c["x"]), c["x"] - fitted, 0.0)
            return {"scores": a, "sse": (rest * rest).sum(axis=1)}

        return map_blocks(df, run, [("scores", "array<double>"), ("sse", "double")], ["x"],
                          [c for c in df.columns if c != "x"])

    def component_cells(self, df: DataFrame) -> DataFrame:
        """(ix, component, pos, value): the part of each sample that a component explains."""
        design = khatri_rao(self.factors)
        k = design.shape[1]
        scored = self.transform(df)
        wide = map_blocks(scored, lambda c: {"v": (c["scores"][:, :, None] * design.T[None]).reshape(len(c["scores"]), -1)},
                          [("v", "array<double>")], ["scores"], ["ix"])
        width = len(design)
        return (wide.select("ix", F.posexplode("v").alias("_p", "value"))
                .select("ix", F.floor(F.col("_p") / width).cast("int").alias("component"),
                        (F.col("_p") % width).cast("int").alias("pos"), "value")
                .filter(F.col("component") < k))


def _rows(x: np.ndarray, design: np.ndarray, rule: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the rows of ``x`` and their fitted values; rows may have missing cells."""
    seen = np.isfinite(x)
    whole = seen.all(axis=1)
    out = np.zeros((len(x), design.shape[1]))
    if whole.any():
        out[whole] = _solve(design.T @ design, x[whole] @ design, rule)
    for i in np.flatnonzero(~whole):
        if seen[i].sum() < design.shape[1]:
            continue
        d = design[seen[i]]
        out[i] = _solve(d.T @ d, (x[i, seen[i]] @ d)[None, :], rule)[0]
    return out, out @ design.T


def _solve(gram, rhs, rule):
    if not rule:
        return rhs @ np.linalg.pinv(gram, hermitian=True)
    if set(rule) == {"non_negative"}:
        return nnls_rows(gram, rhs)
    gram = gram + 2 * rule.get("l2_square_reg", 0.0) * np.eye(len(gram))
    if "l1_reg" not in rule:
        return nnls_rows(gram, rhs) if "non_negative" in rule else rhs @ np.linalg.inv(gram)
    if "non_negative" in rule:  # |a| = a there, so the penalty is linear
        return nnls_rows(gram, rhs - rule["l1_reg"])
    # a = u - v with u, v ≥ 0 turns the penalty linear as well
    both = np.block([[gram, -gram], [-gram, gram]])
    parts = nnls_rows(both + 1e-10 * np.trace(gram) * np.eye(len(both)),
                      np.hstack([rhs, -rhs]) - rule["l1_reg"])
    k = len(gram)
    return parts[:, :k] - parts[:, k:]


def _statistics(x, factors, rule, weighted: bool) -> np.ndarray:
    """AᵀA, AᵀX (missing cells filled by the model, or weighted), Σa, Σx² and residual squares."""
    design = khatri_rao(factors)
    a, fitted = _rows(x, design, rule)
    seen = np.isfinite(x)
    rest = np.where(seen, x - fitted, 0.0)
    data = np.where(seen, x, 0.0 if weighted else fitted)
    parts = [(a.T @ a).ravel(), (a.T @ data).ravel(), a.sum(axis=0)]
    if weighted:
        # per cell: Σ over the samples that observed it of a aᵀ
        outer = (a[:, :, None] * a[:, None, :]).reshape(len(a), -1)
        parts.append((seen.T.astype(float) @ outer).ravel())
    parts.append([np.where(seen, x, 0.0).ravel() @ np.where(seen, x, 0.0).ravel(), (rest * rest).sum(),
                  seen.sum(), (data * data).sum()])
    return np.concatenate(parts)


def _update(stats, factors, shape, constraints, weighted, orthogonal) -> list[np.ndarray]:
    """One sweep over the instrument modes given AᵀA and AᵀX."""
    k = factors[0].shape[1]
    cells = prod(shape)
    aa = stats[:k * k].reshape(k, k)
    ax = stats[k * k:k * k + k * cells].reshape(k, *shape)
    weights = stats[k * k + k * cells + k:][:cells * k * k].reshape(*shape, k, k) if weighted else None
    factors = [f.copy() for f in factors]
    for mode in range(len(shape)):
        rest = [f for i, f in enumerate(factors) if i != mode]
        others = khatri_rao(rest) if rest else np.ones((1, k))
        unfolded = np.moveaxis(ax, mode + 1, 1).reshape(k, shape[mode], -1)
        cross = np.einsum("kjm,mk->jk", unfolded, others)
        if weighted:
            w = np.moveaxis(weights, mode, 0).reshape(shape[mode], -1, k, k)
            normal = np.einsum("jmab,ma,mb->jab", w, others, others)
            factors[mode] = constrained_rows(normal, cross, constraints[mode + 1], factors[mode])
        else:
            gram = aa * (others.T @ others)
            factors[mode] = constrained_factor(gram, cross, constraints[mode + 1], factors[mode])
        if orthogonal and k <= shape[mode]:
            factors[mode] = np.linalg.qr(factors[mode])[0]
        norm = np.linalg.norm(factors[mode], axis=0)
        if "normalize" not in constraints[mode + 1]:
            # the scale moves to the sample mode, whose statistics follow
            norm = np.where(norm > 0, norm, 1.0)
            factors[mode] = factors[mode] / norm
            aa = aa * np.outer(norm, norm)
            ax = ax * norm.reshape(k, *[1] * len(shape))
            if weighted:
                weights = weights * np.outer(norm, norm)
    return factors


def _initial(df, shape, rank, init, seed, custom=None) -> list[np.ndarray]:
    """Leading singular vectors per mode (one pass), random or given factors."""
    if custom is not None:
        return [np.asarray(f, dtype=float) for f in custom]
    rng = np.random.default_rng(seed)
    if init == "random":
        return [np.abs(rng.normal(size=(n, rank))) for n in shape]

    def grams(c):
        x = np.nan_to_num(c["x"]).reshape(-1, *shape)
        parts = []
        for mode in range(len(shape)):
            u = np.moveaxis(x, mode + 1, 0).reshape(shape[mode], -1)
            parts.append((u @ u.T).ravel())
        return np.concatenate(parts)

    sums = sum_blocks(df, ["x"], grams)
    out, at = [], 0
    for n in shape:
        _, vectors = np.linalg.eigh(sums[at:at + n * n].reshape(n, n))
        at += n * n
        lead = vectors[:, ::-1][:, :rank]
        lead = lead * np.where(lead.sum(axis=0) < 0, -1.0, 1.0)
        if lead.shape[1] < rank:
            lead = np.hstack([lead, np.abs(rng.normal(size=(n, rank - lead.shape[1])))])
        out.append(lead)
    return out


def _alternate(df, shape, starts, constraints, max_iter, tol, weighted=False, orthogonalise=False,
               line_search=False, extra=None):
    state = [_begin(f) for f in starts]
    rule = constraints[0]
    few = few_tasks(df)
    while any(not s["done"] for s in state):
        live = [i for i, s in enumerate(state) if not s["done"]]
        tried = [state[i]["f"] for i in live]
        sums = sum_blocks(df, ["x"], lambda c: np.concatenate(
            [_statistics(c["x"], f, rule, weighted) for f in tried]), few).reshape(len(live), -1)
        for stats, i in zip(sums, live):
            if extra is not None:
                stats = stats + _statistics(extra[i], state[i]["f"], rule, weighted)
            _advance(state[i], stats, shape, constraints, max_iter, tol, weighted, orthogonalise, line_search)
    return state


def _begin(f) -> dict:
    return dict(f=f, good=f, before=f, error=np.inf, history=[], stats=None, done=False, rounds=0, jumped=False)


def _advance(s, stats, shape, constraints, max_iter, tol, weighted=False, orthogonalise=False, line_search=False) -> None:
    """One step of an alternation whose statistics are those of all its rows."""
    error = stats[-3]
    s["rounds"] += 1
    if s["jumped"] and error > s["error"]:
        # the extrapolation made it worse: return to the plain update
        s["f"], s["jumped"] = s["plain"], False
        if s["rounds"] > max_iter:
            s["done"] = True
        return
    s["history"].append(float(error))
    change = abs(s["error"] - error) / max(stats[-4], 1e-300)
    s.update(error=error, before=s["good"], good=s["f"], stats=stats)
    if change < tol or s["rounds"] > max_iter:
        s["done"] = True
        return
    plain = _update(stats, s["f"], shape, constraints, weighted, orthogonalise and s["rounds"] <= 5)
    s["jumped"] = line_search and s["rounds"] >= 5 and s["rounds"] % 2 == 0
    s["plain"] = plain
    reach = s["rounds"] ** (1 / 3)
    s["f"] = [a + (b - a) * reach for a, b in zip(s["good"], plain)] if s["jumped"] else plain


def parafac(ds: Dataset, rank: int, constraints: dict[int, dict[str, float]] | None = None,
            init: str = "svd", starts: int = 1, seed: int = 42, max_iter: int = 500, tol: float = 1e-8,
            missing: str = "em", orthogonalise: bool = False, line_search: bool = False, custom=None,
            joint: bool = True) -> CPModel:
    """Best of several starts by fit.

    ``constraints`` maps a mode (0 = samples, 1.. = ways) to {kind: strength}. ``missing``: 'em'
    (also 'em_adaptive') fills unobserved cells from the model; 'weighted' (also 'masked') solves
    the weighted normal equations of the observed cells.
    """
    rules = [dict((constraints or {}).get(m, {})) for m in range(len(ds.shape) + 1)]
    if any(k not in _ROW_LOCAL for k in rules[0]):
        raise ValueError(f"the sample mode supports {', '.join(_ROW_LOCAL)}")
    weighted = missing in ("weighted", "masked")
    df = (ds.df if joint else ds.cal).select("x").persist()
    try:
        begin = [_initial(df, ds.shape, rank, init if i == 0 else "random", seed + i, custom if i == 0 else None)
                 for i in range(starts)]
        begin = [[_admissible(f, rules[m + 1]) for m, f in enumerate(b)] for b in begin]
        state = _alternate(df, ds.shape, begin, rules, max_iter, tol, weighted, orthogonalise, line_search)
        best = min(range(starts), key=lambda i: (state[i]["error"], i))
        if weighted:  # the core needs the unobserved cells filled in
            state[best]["stats"] = sum_blocks(df, ["x"], lambda c: _statistics(c["x"], state[best]["good"], rules[0], False))
    finally:
        df.unpersist()
    return _model(state[best], ds.shape, rules, best, missing)


def _admissible(f: np.ndarray, rule: dict) -> np.ndarray:
    return np.maximum(f, 1e-12) if "non_negative" in rule else f


def _model(s, shape, rules, start, missing) -> CPModel:
    stats, k = s["stats"], s["good"][0].shape[1]
    cells = prod(shape)
    aa = stats[:k * k].reshape(k, k)
    ax = stats[k * k:k * k + k * cells].reshape(k, *shape)
    mean_a = stats[k * k + k * cells:k * k + k * cells + k]
    factors = orient(s["good"], mean_a, rules)
    flips = np.prod([np.sign((a * b).sum(0) + (np.abs(a).sum(0) == 0)) for a, b in zip(factors, s["good"])], axis=0)
    return CPModel(factors, shape, rules, float(s["error"]), float(np.sqrt(s["error"] / max(stats[-2], 1))),
                   max(0.0, 100 * (1 - s["error"] / stats[-4])) if stats[-4] > 0 else 0.0,
                   core_consistency(aa * np.outer(flips, flips), ax * flips.reshape(k, *[1] * len(shape)), factors),
                   s["rounds"], start, s["history"], missing)


def orient(factors, sample_sums, rules) -> list[np.ndarray]:
    """Flip pairs of modes whose component means are negative; the tensor stays the same.

    The sample mode takes the other half of an odd flip, as its scores are solved afterwards.
    """
    out = [f.copy() for f in factors]
    for k in range(out[0].shape[1]):
        negative = ([0] if sample_sums[k] < 0 else []) + [m + 1 for m, f in enumerate(out) if f[:, k].mean() < 0]
        while len(negative) >= 2:
            for m in (negative.pop(0), negative.pop(0)):
                if m:
                    out[m - 1][:, k] *= -1
    return out


def core_consistency(aa: np.ndarray, ax: np.ndarray, factors) -> float:
    """100(1 - Σ(G - I)²/R): the core follows from AᵀA and AᵀX, without another pass."""
    if len(factors) < 2:
        return float("nan")
    k = len(aa)
    core = np.tensordot(np.linalg.pinv(aa, hermitian=True), ax, axes=(1, 0))
    for mode, f in enumerate(factors):
        core = np.moveaxis(np.tensordot(np.linalg.pinv(f), core, axes=(1, mode + 1)), 0, mode + 1)
    ideal = np.zeros_like(core)
    ideal[(np.arange(k),) * core.ndim] = 1.0
    return float(max(0.0, 100 * (1 - ((core - ideal) ** 2).sum() / (k + 1e-12))))


def profile_angle(a, b) -> float:
    """Angle in degrees between a resolved and a reference profile."""
    a, b = np.ravel(a).astype(float), np.ravel(b).astype(float)
    c = a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-12)
    return float(np.degrees(np.arccos(np.clip(c, -1, 1))))


def rank_sweep(ds: Dataset, ranks, **hp) -> DataFrame:
    rows = []
    for k in ranks:
        m = parafac(ds, int(k), **hp)
        rows.append((int(k), float(m.sfit), float(m.core_consistency), float(m.explained), int(m.iterations)))
    return ds.df.sparkSession.createDataFrame(
        rows, "components int, sfit double, core_consistency double, explained double, iterations int")


def sample_refits(ds: Dataset, model: CPModel, max_iter: int = 100, tol: float = 1e-8, batch: int = refits.BATCH):
    """Refit calibration plus one validation sample at a time.

    The calibration rows are summed once per iteration for all validation samples near the model of these rows alone, and
    scanned once per iteration and batch for the others. Returns (ix, scores, sfit, core_consistency) with components aligned
    to the medoid of all models, scores of profiles that run against it turned, and the similarities of the models.
    """
    cal = ds.cal.select("x").persist()
    k = model.factors[0].shape[1]
    rule, shape = model.constraints[0], ds.shape

    def made(x, s):
        f = _model(s, shape, model.constraints, 0, model.missing)
        return np.vstack(f.factors).T, _rows(x, khatri_rao(f.factors), f.constraints[0])[0][0], [f.sfit, f.core_consistency]

    def fit(rows):
        extra = [np.asarray(r["x"], dtype=float)[None, :] for r in rows]
        state = _alternate(cal, shape, [model.factors] * len(rows), model.constraints, max_iter, tol, extra=extra)
        for r, x, s in zip(rows, extra, state):
            yield r["ix"], *made(x, s)

    def summed(here, factors):
        known = here.statistics(khatri_rao(factors).T)
        if known is None:
            return None
        aa, ax, sums, error = known
        stats = np.concatenate([aa.ravel(), ax.ravel(), sums, [here.total, error, here.cells, here.total]])
        return stats + _statistics(here.rows, factors, rule, False)

    def step(s, here):
        s["done"] = False
        _advance(s, summed(here, s["f"]), shape, model.constraints, max_iter, tol)
        if s["done"]:  # the next round may still serve others
            s["f"] = _update(s["stats"], s["f"], shape, model.constraints, False, False)
        return s["done"]

    try:
        held = nearby.walk(cal, lambda x: x, _begin(model.factors), lambda s: khatri_rao(s["f"]).T, bool(rule), step,
                           max_iter + 1) if set(rule) <= {"non_negative"} else []
        held = cal.sparkSession.sparkContext.broadcast(held) if held else None

        def quick(x):
            s, x = _begin(model.factors), x[None, :]
            for here in held.value:
                stats = summed(here, s["f"])
                if stats is None or not stats[-3] > nearby.LEAST_ERROR * stats[-4]:
                    return None
                _advance(s, stats + _statistics(x, s["f"], rule, False), shape, model.constraints, max_iter, tol)
                if s["done"]:
                    return made(x, s)
            return None

        fits = refits.refit_table(ds.val.select("ix", "x"), fit, batch, quick if held else None)
    finally:
        cal.unpersist()
    similar = refits.similarities(fits, k)
    rows = refits.aligned(fits, k, similar.medoid, signed=True).select(
        "ix", "scores", F.get("facts", F.lit(0)).alias("sfit"), F.get("facts", F.lit(1)).alias("core_consistency"))
    return rows, similar
