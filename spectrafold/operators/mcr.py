"""Multivariate curve resolution by alternating least squares, D ≈ C Sᵀ.

C has a row per sample (or several, for augmented tensors) and never exists as a whole: a pass
broadcasts S, solves the C rows where they are, and sums CᵀC and CᵀD. S is small and is solved
on the driver, so an iteration is one scan and no state survives it but S.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import few_tasks, map_blocks, sum_blocks
from ..dataset import Dataset
from . import metrics, nearby, refits
from .leastsq import nnls_rows, ols_rows


@dataclass(frozen=True)
class Rules:
    """Constraints of one matrix, applied along its last axis in this order."""

    regression: str = "NNLS"       # or OLS
    non_negative: bool = False     # clip after the regression
    cumsum_non_negative: bool = False
    zero_end_points: int = 0       # span; 0 = off
    zero_cumsum_end_points: bool = False
    zero_cumsum_nodes: tuple[int, ...] = ()
    normalize: bool = False
    cut_below: float | None = None
    cut_above: float | None = None
    compress_below: float | None = None
    compress_above: float | None = None
    replace_zeros: tuple[int, float] | None = None   # 0-based feature, value

    def apply(self, a: np.ndarray) -> np.ndarray:
        a = a.copy()
        if self.non_negative:
            a = np.where(a > 0, a, 0.0)
        if self.cumsum_non_negative:
            a = np.where(np.cumsum(a, axis=-1) > 0, a, 0.0)
        if self.zero_end_points:
            a = self._flatten_ends(a)
        if self.zero_cumsum_end_points:
            a = self._zero_cumsum(a)
        if self.normalize:
            total = a.sum(axis=-1, keepdims=True)
            a = a / np.where(total != 0, total, 1.0)
        if self.cut_below is not None:
            a = np.where(a >= self.cut_below, a, 0.0)
        if self.cut_above is not None:
            a = np.where(a <= self.cut_above, a, 0.0)
        if self.compress_below is not None:
            a = np.maximum(a, self.compress_below)
        if self.compress_above is not None:
            a = np.minimum(a, self.compress_above)
        if self.replace_zeros is not None:
            feature, value = self.replace_zeros
            empty = np.all(a == 0, axis=-1)
            a[empty, min(feature, a.shape[-1] - 1)] = value
        return a

    def _flatten_ends(self, a):
        span, n = self.zero_end_points, a.shape[-1]
        first = a[..., :span].mean(axis=-1, keepdims=True)
        last = a[..., n - span:].mean(axis=-1, keepdims=True)
        return a - (first + (last - first) * np.arange(n) / max(n - 1, 1))

    def _zero_cumsum(self, a):
        cuts = sorted({0, a.shape[-1], *[c for c in self.zero_cumsum_nodes if 0 < c < a.shape[-1]]})
        for start, stop in zip(cuts, cuts[1:]):
            a[..., start:stop] -= a[..., start:stop].mean(axis=-1, keepdims=True)
        return a


@dataclass(frozen=True)
class Layout:
    """How a sample unfolds to rows × spectral columns; first-order data is one row."""

    shape: tuple[int, ...]
    spectral: int | None = None   # 0-based way that becomes the columns

    @property
    def columns(self) -> int:
        return int(np.prod(self.shape)) if self.spectral is None else self.shape[self.spectral]

    @property
    def rows(self) -> int:
        return 1 if self.spectral is None else int(np.prod(self.shape)) // self.columns

    def unfold(self, x: np.ndarray) -> np.ndarray:
        """(samples, rows, columns); rows run in Fortran order of the remaining ways."""
        if self.spectral is None:
            return x.reshape(len(x), 1, -1)
        t = np.moveaxis(x.reshape(len(x), *self.shape), self.spectral + 1, -1)
        ways = list(range(1, t.ndim - 1))
        return np.transpose(t, [0, *ways[::-1], t.ndim - 1]).reshape(len(x), self.rows, -1)


@dataclass(frozen=True)
class MCRModel:
    spectra: np.ndarray            # components × columns
    c_rules: Rules
    layout: Layout
    aggregation: str
    sse: float
    explained: float
    sfit: float
    iterations: int
    history: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Scores per sample (area, max or min over its rows) and its residual squares."""
        s, rules, layout, how = self.spectra, self.c_rules, self.layout, self.aggregation

        def run(c):
            d = layout.unfold(c["x"])
            rows, seen = _usable(d)
            conc = np.full((*d.shape[:2], len(s)), np.nan)
            conc[seen] = _concentrations(rows, s, rules)
            rest = rows - conc[seen] @ s
            lost = np.zeros(d.shape[:2])
            lost[seen] = (rest * rest).sum(axis=1)
            return {"scores": _collapse(conc, how), "sse": lost.sum(axis=1)}

        return map_blocks(df, run, [("scores", "array<double>"), ("sse", "double")], ["x"],
                          [c for c in df.columns if c != "x"])

    def rows(self, df: DataFrame) -> DataFrame:
        """(ix, row, component, value) concentration profiles of augmented samples."""
        s, rules, layout = self.spectra, self.c_rules, self.layout

        def run(c):
            d = layout.unfold(c["x"])
            rows, seen = _usable(d)
            conc = np.full((*d.shape[:2], len(s)), np.nan)
            conc[seen] = _concentrations(rows, s, rules)
            return {"c": conc.reshape(len(d), -1)}

        k = len(s)
        wide = map_blocks(df, run, [("c", "array<double>")], ["x"], ["ix"])
        return (wide.select("ix", F.posexplode("c").alias("_p", "value")).filter(~F.isnan("value"))
                .select("ix", F.floor(F.col("_p") / k).cast("int").alias("row"),
                        (F.col("_p") % k).cast("int").alias("component"), "value"))


def _usable(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without padding, and where they are; a row is padding when nothing is finite."""
    seen = np.isfinite(d).any(axis=2)
    rows = d[seen]
    if not np.isfinite(rows).all():
        raise ValueError("rows with some missing values: trim or impute them first")
    return rows, seen


def _collapse(conc: np.ndarray, how: str) -> np.ndarray:
    if conc.shape[1] == 1:
        return conc[:, 0, :]
    seen = np.isfinite(conc).all(axis=2)
    out = np.empty((len(conc), conc.shape[2]))
    for i, profile in enumerate(conc):
        p = profile[seen[i]]
        if len(p) == 1:
            out[i] = p[0]
        elif how == "max":
            out[i] = p.max(axis=0)
        elif how == "min":
            out[i] = p.min(axis=0)
        else:
            out[i] = p.sum(axis=0) - (p[0] + p[-1]) / 2
    return out


def _concentrations(rows: np.ndarray, s: np.ndarray, rules: Rules) -> np.ndarray:
    solve = nnls_rows if rules.regression == "NNLS" else ols_rows
    return rules.apply(solve(s @ s.T, rows @ s.T))


def _statistics(rows: np.ndarray, s: np.ndarray, rules: Rules) -> np.ndarray:
    """CᵀC, CᵀD, ΣD², residual squares, ΣD and the cell count, as one vector."""
    c = _concentrations(rows, s, rules)
    rest = rows - c @ s
    return np.concatenate([(c.T @ c).ravel(), (c.T @ rows).ravel(),
                           [(rows * rows).sum(), (rest * rest).sum(), rows.sum(), rows.size]])


def _spectra(stats: np.ndarray, k: int, columns: int, rules: Rules) -> np.ndarray:
    cc = stats[:k * k].reshape(k, k)
    cd = stats[k * k:k * k + k * columns].reshape(k, columns)
    solve = nnls_rows if rules.regression == "NNLS" else ols_rows
    return rules.apply(solve(cc, cd.T).T)


def _scan(df: DataFrame, layout: Layout, spectra: list[np.ndarray], rules: Rules, few: bool) -> np.ndarray:
    """Statistics of several candidate S in one pass, one row each."""

    def run(c):
        rows, _ = _usable(layout.unfold(c["x"]))
        return np.concatenate([_statistics(rows, s, rules) for s in spectra])

    return sum_blocks(df, ["x"], run, few).reshape(len(spectra), -1)


def mcr_als(ds: Dataset, components: int, c_rules: Rules = Rules(), s_rules: Rules = Rules(),
            spectral_way: int | None = None, aggregation: str = "area", max_iter: int = 250,
            tol: float = 1e-8, seed: int = 42, start: np.ndarray | None = None,
            joint: bool = True) -> MCRModel:
    """Fit on calibration (and, for a joint fit, validation) rows.

    ``spectral_way`` (1-based) augments tensors: that way becomes the columns, the others rows.
    """
    layout = Layout(ds.shape, None if spectral_way is None else spectral_way - 1)
    if spectral_way is not None and not 1 <= spectral_way <= len(ds.shape):
        raise ValueError("the spectral way does not exist")
    df = (ds.df if joint else ds.cal).select("x").persist()
    try:
        s = np.abs(np.random.default_rng(seed).normal(size=(components, layout.columns))) \
            if start is None else np.asarray(start, dtype=float)
        (fit,) = _alternate(df, layout, [s], c_rules, s_rules, max_iter, tol)
    finally:
        df.unpersist()
    s, sse, iterations, history, stats = fit
    total_squares, cells = stats[-4], stats[-1]
    spread = total_squares - stats[-2] ** 2 / cells   # around the grand mean
    return MCRModel(s, c_rules, layout, aggregation, sse, 100 * (1 - sse / (spread + 1e-12)),
                    float(np.sqrt(sse / max(cells, 1))), iterations, history)


def _alternate(df, layout, starts, c_rules, s_rules, max_iter, tol, extra=None):
    """Alternate from every start at once; ``extra`` adds each start's own further rows."""
    state = [_begin(s) for s in starts]
    few = few_tasks(df)
    for _ in range(max_iter + 1):
        live = [i for i, f in enumerate(state) if not f["done"]]
        if not live:
            break
        scanned = _scan(df, layout, [state[i]["s"] for i in live], c_rules, few)
        for stats, i in zip(scanned, live):
            if extra is not None:
                stats = stats + _statistics(extra[i], state[i]["s"], c_rules)
            _advance(state[i], stats, layout, s_rules, max_iter, tol)
    return [_outcome(f) for f in state]


def _begin(s: np.ndarray) -> dict:
    return dict(s=s, best=s, error=np.inf, history=[], stats=None, done=False, rounds=0)


def _advance(f: dict, stats: np.ndarray, layout: Layout, s_rules: Rules, max_iter: int, tol: float) -> None:
    """One step of an alternation whose statistics are those of all its rows."""
    error = stats[-3]
    f["history"].append(float(error))
    change = abs(f["error"] - error) / max(stats[-4], 1e-300)
    f.update(error=error, best=f["s"], stats=stats, rounds=f["rounds"] + 1)
    if change < tol or f["rounds"] > max_iter:
        f["done"] = True
    else:
        f["s"] = _spectra(stats, len(f["s"]), layout.columns, s_rules)


def _outcome(f: dict) -> tuple:
    return f["best"], float(f["error"]), f["rounds"], f["history"], f["stats"]


def calibrate_scores(scored: DataFrame, responses: int, mapping: dict[int, int] | None = None) -> DataFrame:
    """Pseudo-univariate lines: each component with its mapped or best-explained response."""
    pairs = (scored.select("ix", "y", F.posexplode("scores").alias("component", "score"))
             .select("ix", "component", "score", F.posexplode("y").alias("response", "true")))
    if mapping:
        wanted = None
        for component, response in mapping.items():
            hit = (F.col("component") == component) & (F.col("response") == response)
            wanted = hit if wanted is None else wanted | hit
        return metrics.simple_ols(pairs.filter(wanted), "true", "score", ["component", "response"])
    return metrics.best_pairing(metrics.simple_ols(pairs, "true", "score", ["component", "response"]))


def paired_predictions(scored: DataFrame, lines: DataFrame) -> DataFrame:
    """(ix, component, response, pred, true, err) of every paired component."""
    scores = scored.select("ix", "y", F.posexplode("scores").alias("component", "score"))
    # one line per component
    joined = scores.join(F.broadcast(lines.select("component", "response", "slope", "intercept")), "component")
    pred = F.col("intercept") + F.col("slope") * F.col("score")
    true = F.get("y", F.col("response"))
    return joined.select("ix", "component", "response", pred.alias("pred"), true.alias("true"),
                         (true - pred).alias("err"))


def rank_sweep(ds: Dataset, ranks, **hp) -> DataFrame:
    rows = []
    for k in ranks:
        m = mcr_als(ds, int(k), **hp)
        rows.append((int(k), float(m.sfit), float(m.explained), int(m.iterations)))
    return ds.df.sparkSession.createDataFrame(rows, "components int, sfit double, explained double, iterations int")


def sample_refits(ds: Dataset, model: MCRModel, s_rules: Rules = Rules(), max_iter: int = 100,
                  tol: float = 1e-8, batch: int = refits.BATCH) -> tuple[DataFrame, refits.Similarities]:
    """Refit calibration plus one validation sample, for every validation sample.

    The calibration rows are summed once per iteration for all validation samples near the model of these rows alone, and
    scanned once per iteration and batch for the others. Components are aligned to the medoid of all models. Returns the
    scores (ix, scores, sfit) and the similarities of the models.
    """
    cal = ds.cal.select("x").persist()
    k = len(model.spectra)

    def made(own, f):
        score = _collapse(_concentrations(own, f[0], model.c_rules)[None, :, :], model.aggregation)[0]
        return f[0], score, [np.sqrt(f[1] / max(f[4][-1], 1))]

    def fit(rows):
        extra = [_usable(model.layout.unfold(np.asarray(r["x"])[None, :]))[0] for r in rows]
        fits = _alternate(cal, model.layout, [model.spectra] * len(rows), model.c_rules, s_rules, max_iter, tol, extra)
        for r, own, f in zip(rows, extra, fits):
            yield r["ix"], *made(own, f)

    def summed(here, s):
        known = here.statistics(s)
        if known is None:
            return None
        cc, cd, _, error = known
        stats = np.concatenate([cc.ravel(), cd.ravel(), [here.total, error, here.sums.sum(), here.cells]])
        return stats + _statistics(here.rows, s, model.c_rules)

    def step(f, here):
        f["done"] = False
        _advance(f, summed(here, f["s"]), model.layout, s_rules, max_iter, tol)
        if f["done"]:  # the next round may still serve others
            f["s"] = _spectra(f["stats"], k, model.layout.columns, s_rules)
        return f["done"]

    try:
        held = nearby.walk(cal, lambda x: _usable(model.layout.unfold(x))[0], _begin(model.spectra), lambda f: f["s"],
                           model.c_rules.regression == "NNLS", step, max_iter + 1) if _linear(model.c_rules) else []
        held = cal.sparkSession.sparkContext.broadcast(held) if held else None

        def quick(x):
            own = _usable(model.layout.unfold(x[None, :]))[0]
            f = _begin(model.spectra)
            for here in held.value:
                stats = summed(here, f["s"])
                if stats is None or not stats[-3] > nearby.LEAST_ERROR * stats[-4]:
                    return None
                _advance(f, stats + _statistics(own, f["s"], model.c_rules), model.layout, s_rules, max_iter, tol)
                if f["done"]:
                    return made(own, _outcome(f))
            return None

        fits = refits.refit_table(ds.val.select("ix", "x"), fit, batch, quick if held else None)
    finally:
        cal.unpersist()
    similar = refits.similarities(fits, k)
    rows = refits.aligned(fits, k, similar.medoid).select("ix", "scores", F.get("facts", F.lit(0)).alias("sfit"))
    return rows, similar


def _linear(rules: Rules) -> bool:
    """Whether scores are those of the regression alone, so that they are linear in a row while the same places are positive."""
    signed = rules.regression == "NNLS"
    return replace(rules, regression="NNLS", non_negative=False) == Rules() and (signed or not rules.non_negative)
