"""One-class models: SIMCA, DD-SIMCA, isolation forest, robust covariance, LOF, one-class SVM.

All give ``score`` (positive inside) and ``inlier`` (1 or -1). Statistics of the reference class
are moments and exact quantiles; scoring is row-local.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import SALTS, block, few_tasks, lists, map_blocks, sum_blocks, vector
from ..functions.distributions import chi2_quantile, f_quantile, normal_quantile
from . import kernels, neighbors
from .folds import CV, assign, test_rows, training_rows
from .linear import principal_axes
from .moments import Moments, moments, total
from .ordering import with_index
from .stats import exact_quantiles

MIN_REFERENCE = 5


# --- reference class ----------------------------------------------------------------------

def reference_class(df: DataFrame, label: str, wanted=None) -> str:
    """Resolve the reference: a name, a value of numeric labels, or a 1-based place of first
    appearance; the first class when nothing is given."""
    numeric = dict(df.dtypes)[label] not in ("string",)
    if wanted in (None, ""):
        place = 1
    else:
        try:
            place = int(str(wanted).strip())
        except ValueError:
            return str(wanted).strip()
        if numeric:
            return str(wanted).strip()
    order = (df.groupBy(F.col(label).cast("string").alias("k")).agg(F.min("ix").alias("first"))
             .orderBy("first").limit(place).collect())
    if len(order) < place or place < 1:
        raise ValueError(f"there is no class number {place}")
    return order[place - 1]["k"]


def remap_truth(df: DataFrame, label: str, reference: str, unknown: str = "Unknown") -> DataFrame:
    """Labels other than the reference become the unknown class."""
    return df.withColumn("truth", F.when(F.col(label).cast("string") == reference, F.lit(reference))
                         .otherwise(F.lit(unknown)))


def _require(n: float) -> None:
    if n < MIN_REFERENCE:
        raise ValueError(f"a one-class model needs at least {MIN_REFERENCE} reference samples, got {int(n)}")


def _quantile(df: DataFrame, column: str, p: float) -> float:
    return exact_quantiles(df.select(F.lit(0).alias("pos"), F.col(column).alias("value")), [p])[(0,)][0]


# --- SIMCA --------------------------------------------------------------------------------

@dataclass(frozen=True)
class Subspace:
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    rest: np.ndarray     # eigenvalues beyond the retained ones
    n: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - self.mean) / self.scale
        t = z @ self.axes
        e = z - t @ self.axes.T
        return (e * e).sum(1), (t * t / np.maximum(self.eigenvalues, 1e-12)).sum(1)


def subspace(m: Moments, components: int, scale: bool = False) -> Subspace:
    _require(m.n)
    s = m.std(1) if scale else np.ones(m.p)
    s = np.where(s > 1e-12, s, 1.0)
    scaled = Moments(m.n, m.mean[:m.p], m.xx / np.outer(s, s), m.p)
    values, vectors = principal_axes(scaled)
    a = max(1, min(components, m.p, int(m.n) - 1))
    return Subspace(m.x_mean, s, vectors[:, :a], values[:a], values[a:], m.n)


@dataclass(frozen=True)
class SIMCA:
    space: Subspace
    q_limit: float
    t2_limit: float
    rule: str = "both"
    combine: str = "l1"

    def values(self, x: np.ndarray) -> dict[str, np.ndarray]:
        q, t2 = self.space.distances(x)
        qn, tn = q / max(abs(self.q_limit), 1e-12), t2 / max(abs(self.t2_limit), 1e-12)
        q_margin, t_margin = (self.q_limit - q) / max(abs(self.q_limit), 1e-12), \
            (self.t2_limit - t2) / max(abs(self.t2_limit), 1e-12)
        if self.rule == "q_only":
            inside, score = q <= self.q_limit, q_margin
        elif self.rule == "t2_only":
            inside, score = t2 <= self.t2_limit, t_margin
        elif self.rule == "combined":
            size = np.hypot(qn, tn) if self.combine == "l2" else qn + tn
            inside, score = size <= 1, 1 - size
        else:
            inside, score = (q <= self.q_limit) & (t2 <= self.t2_limit), np.minimum(q_margin, t_margin)
        return {"score": score, "inlier": np.where(inside, 1, -1).astype(np.int32), "q": q, "t2": t2}

    fields = [("score", "double"), ("inlier", "int"), ("q", "double"), ("t2", "double")]


def score_with(model, df: DataFrame) -> DataFrame:
    """Row-local scoring by any model with ``values`` and ``fields``."""
    names = {n for n, _ in model.fields}
    return map_blocks(df, lambda c: model.values(c["x"]), model.fields, ["x"],
                      [c for c in df.columns if c != "x" and c not in names])


def simca(df: DataFrame, m: Moments, components: int = 2, confidence: float = 0.95, limits: str = "analytical",
          rule: str = "both", combine: str = "l1", scale: bool = False, q_limit: str = "empirical") -> SIMCA:
    """``df`` holds the reference rows whose moments are ``m``.

    The T² limit follows F when ``limits`` is analytical. The Q limit is the empirical quantile;
    ``q_limit='jackson'`` uses the discarded eigenvalues instead.
    """
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    space = subspace(m, components, scale)
    return _limits(space, _space_quantiles(df, {0: space}, confidence)[0], confidence, limits, rule, combine, q_limit)


def _space_quantiles(df: DataFrame, spaces: dict[int, Subspace], p: float, fold: str | None = None) -> dict:
    """Quantiles of Q and T² of the training rows of each space, in one set of passes."""
    source = df if fold else df.withColumn("_f", F.lit(0))
    key = fold or "_f"

    def run(c):
        out = np.empty((len(c["x"]), 2))
        for f in np.unique(c[key]):
            at = c[key] == f
            out[at] = np.stack(spaces[int(f)].distances(c["x"][at]), axis=1)
        return {"d": out}

    long = (map_blocks(source, run, [("d", "array<double>")], ["x", key], [key])
            .select(F.col(key).cast("int").alias("f"), F.posexplode("d").alias("pos", "value")))
    found = exact_quantiles(long, [p], ("f", "pos"))
    return {f: (found[(f, 0)][0], found[(f, 1)][0]) for f in spaces}


def _limits(space, quantiles, confidence, limits, rule, combine, q_limit="empirical") -> SIMCA:
    q_thr, t_thr = quantiles
    n, a = int(space.n), len(space.eigenvalues)
    if limits == "analytical" and n > a:
        t_thr = a * (n - 1) / max(1, n - a) * f_quantile(confidence, a, n - a)
    if q_limit == "jackson":
        theta = [float((space.rest ** i).sum()) for i in (1, 2, 3)]
        if theta[0] > 1e-12 and theta[1] > 1e-12:
            h = min(max(1 - 2 * theta[0] * theta[2] / (3 * theta[1] ** 2), 1e-6), 1.0)
            z = normal_quantile(confidence)
            inner = 1 + z * np.sqrt(2 * theta[1] * h * h) / theta[0] + theta[1] * h * (h - 1) / theta[0] ** 2
            q_thr = theta[0] * max(inner, 1e-9) ** (1 / h)
    return SIMCA(space, float(q_thr), float(t_thr), rule, combine)


# --- DD-SIMCA -----------------------------------------------------------------------------

@dataclass(frozen=True)
class DDSIMCA:
    space: Subspace
    h0: float
    nh: int
    q0: float
    nq: int
    alpha: float
    gamma: float

    @property
    def extreme_limit(self) -> float:
        return chi2_quantile(1 - self.alpha, self.nh + self.nq)

    @property
    def outlier_limit(self) -> float:
        """The limit that a whole class of this size keeps with probability 1 - γ."""
        return chi2_quantile((1 - self.gamma) ** (1 / self.space.n), self.nh + self.nq)

    def values(self, x: np.ndarray) -> dict[str, np.ndarray]:

        q, t2 = self.space.distances(x)
        h = t2 / (self.space.n - 1)
        f = h / self.h0 * self.nh + q / self.q0 * self.nq
        low, high = sorted((self.extreme_limit, self.outlier_limit))
        region = np.where(f <= low, "regular", np.where(f <= high, "extreme", "outlier"))
        decide = self.outlier_limit
        inside = (f <= self.extreme_limit) | (f <= decide)
        return {"score": (decide - f) / max(abs(decide), 1e-12), "inlier": np.where(inside, 1, -1).astype(np.int32),
                "q": q, "h": h, "f": f, "region": pa.array(region.tolist())}

    fields = [("score", "double"), ("inlier", "int"), ("q", "double"), ("h", "double"), ("f", "double"),
              ("region", "string")]


def _moment_fit(mean: float, variance: float) -> tuple[float, int]:
    """Scale and degrees of freedom of a scaled chi-squared by the method of moments."""
    freedom = int(round(2 * mean * mean / variance)) if variance > 0 else 1
    return max(mean, 1e-300), min(max(freedom, 1), 250)


def _robust_fit(median: float, iqr: float) -> tuple[float, int]:
    """The same from median and interquartile range (Pomerantsev and Rodionova 2014)."""
    ratio = iqr / median if median > 0 else np.inf
    if ratio > 2.685592117:
        freedom = 1
    elif ratio < 0.194565995:
        freedom = 100
    else:
        freedom = int(round(np.exp((1.380948 * np.log(2.68631 / ratio)) ** 1.185785)))
    quartiles = chi2_quantile(0.75, freedom) - chi2_quantile(0.25, freedom)
    return max(0.5 * freedom * (median / chi2_quantile(0.5, freedom) + iqr / quartiles), 1e-300), freedom


def dd_simca(df: DataFrame, m: Moments, components: int = 2, alpha: float = 0.05, gamma: float = 0.01,
             limits: str = "classic", scale: bool = False) -> DDSIMCA:
    for p in (alpha, gamma):
        if not 0 < p < 1:
            raise ValueError("alpha and gamma must lie between 0 and 1")
    return _dd_fit(df, {0: subspace(m, components, scale)}, alpha, gamma, limits)[0]


def _dd_fit(df, spaces, alpha, gamma, limits, fold=None) -> dict[int, DDSIMCA]:
    source = df if fold else df.withColumn("_f", F.lit(0))
    key = fold or "_f"

    def run(c):
        out = np.empty((len(c["x"]), 2))
        for f in np.unique(c[key]):
            at = c[key] == f
            q, t2 = spaces[int(f)].distances(c["x"][at])
            out[at] = np.stack([t2 / (spaces[int(f)].n - 1), q], axis=1)
        return {"d": out}

    dist = map_blocks(source, run, [("d", "array<double>")], ["x", key], [key])
    out = {}
    if limits == "robust":
        long = dist.select(F.col(key).cast("int").alias("f"), F.posexplode("d").alias("pos", "value"))
        found = exact_quantiles(long, [0.25, 0.5, 0.75], ("f", "pos"))
        for f, space in spaces.items():
            fits = [_robust_fit(found[(f, i)][1], found[(f, i)][2] - found[(f, i)][0]) for i in (0, 1)]
            out[f] = DDSIMCA(space, *fits[0], *fits[1], alpha, gamma)
        return out
    parts = moments(dist, "d", key=key, width=2)
    for f, space in spaces.items():
        m = parts[str(f)]
        fits = [_moment_fit(float(m.x_mean[i]), float(m.xx[i, i] / (m.n - 1))) for i in (0, 1)]
        out[f] = DDSIMCA(space, *fits[0], *fits[1], alpha, gamma)
    return out


# --- isolation forest ---------------------------------------------------------------------

@dataclass(frozen=True)
class IsolationForest:
    trees: list[dict]
    sample: int
    offset: float = 0.0

    def depth_score(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=int)
            while True:
                inner = t["feature"][at] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                node = at[rows]
                left = x[rows, t["feature"][node]] <= t["threshold"][node]
                at[rows] = np.where(left, t["left"][node], t["right"][node])
            depth += t["depth"][at]
        return -np.power(2.0, -depth / (len(self.trees) * max(_average_path(self.sample), 1e-12)))

    def values(self, x):
        score = self.depth_score(x) - self.offset
        return {"score": score, "inlier": np.where(score >= 0, 1, -1).astype(np.int32)}

    fields = [("score", "double"), ("inlier", "int")]


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def isolation_forest(df: DataFrame, n: int, width: int, trees: int = 100, contamination: float = 0.1,
                     sample: int = 256, max_features: float = 1.0, seed: int = 42) -> IsolationForest:
    """Each tree is grown in one group from its own hash-chosen rows, at most ``sample`` of them.

    A row enters a tree's draw by its hash; the draw is about twice the sample and the rows with
    the lowest hashes form it, so no tree sees more than a fixed number of rows.
    """
    _require(n)
    trees, contamination = max(20, trees), min(0.5, max(1e-4, contamination))
    size = min(sample, n)
    share = min(1.0, (2 * size + 64) / n)
    cut = int(share * (1 << 62)) if share < 1 else (1 << 62)
    limit = int(np.ceil(np.log2(max(size, 2))))
    picked = max(1, int(max_features * width))
    draw = lambda t: F.xxhash64("ix", t, F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))
    rows = (df.select("ix", "x", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                                                    lambda t: draw(t) < cut)).alias("tree"))
            .withColumn("h", draw(F.col("tree"))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "ix"]).head(size)
        tree = _grow(np.stack(pdf["x"].to_numpy()), limit, picked, np.random.default_rng(seed + int(pdf["tree"].iloc[0])))
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], **{k: [v] for k, v in tree.items()}})

    schema = ("tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
              "depth array<double>")
    grown = rows.groupBy("tree").applyInPandas(grow, schema).orderBy("tree").collect()
    forest = IsolationForest([{k: np.asarray(r[k]) for k in ("feature", "threshold", "left", "right", "depth")}
                              for r in grown], size)
    scored = map_blocks(df, lambda c: {"value": forest.depth_score(c["x"])}, [("value", "double")], ["x"], [])
    return IsolationForest(forest.trees, size, _quantile(scored, "value", contamination))


def _grow(x: np.ndarray, limit: int, picked: int, rng) -> dict:
    tree: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "depth")}
    pool = rng.choice(x.shape[1], picked, replace=False)
    todo = [(np.arange(len(x)), 0, None, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(tree["feature"])
        if parent is not None:
            tree[side][parent] = me
        part = x[rows][:, pool]
        low, high = part.min(axis=0), part.max(axis=0)
        open_ = np.flatnonzero(high > low)
        leaf = depth >= limit or len(rows) <= 1 or not len(open_)
        j = 0 if leaf else int(rng.choice(open_))
        cut = 0.0 if leaf else float(rng.uniform(low[j], high[j]))
        tree["feature"].append(-1 if leaf else int(pool[j]))
        tree["threshold"].append(cut)
        tree["left"].append(-1)
        tree["right"].append(-1)
        tree["depth"].append(depth + _average_path(len(rows)) if leaf else 0.0)
        if not leaf:
            left = part[:, j] <= cut
            todo += [(rows[left], depth + 1, me, "left"), (rows[~left], depth + 1, me, "right")]
    return tree


# --- robust covariance --------------------------------------------------------------------

@dataclass(frozen=True)
class Envelope:
    center: np.ndarray
    precision: np.ndarray
    offset: float

    def distance(self, x):
        z = x - self.center
        return np.einsum("ij,jk,ik->i", z, self.precision, z)

    def values(self, x):
        score = -self.distance(x) - self.offset
        return {"score": score, "inlier": np.where(score >= 0, 1, -1).astype(np.int32), "distance": self.distance(x)}

    fields = [("score", "double"), ("inlier", "int"), ("distance", "double")]


def elliptic_envelope(df: DataFrame, n: int, width: int, contamination: float = 0.1, support: float | None = None,
                      centered: bool = False, rounds: int = 30, seed: int = 42) -> Envelope:
    """Minimum covariance determinant: C-steps of all starts over the whole table.

    Starts are ``_STARTS`` sets of ``width`` + 1 rows, drawn by hash over the whole table. A step finds the h-th
    smallest distance of every start at once and takes the moments of the rows within it, mostly in two passes over
    packed rows (``_c_step``). After ``_TRIED`` steps, over all
    rows, the ``_BEST`` starts go on (Rousseeuw and Van Driessen, 1999); the smallest
    determinant is kept. The result is corrected for consistency and reweighted.
    """
    _require(n)
    contamination = min(0.5, max(1e-4, contamination))
    h = int(np.ceil(support * n)) if support else (n + width + 1) // 2
    h = min(h, n)
    df = df.persist()   # every C-step scans it some times
    within = lambda c, p: map_blocks(
        df, lambda b: {"value": np.einsum("ij,jk,ik->i", b["x"] - c, p, b["x"] - c)}, [("value", "double")], ["x"], ["x"])
    center, cov = _least_determinant(df, n, width, h, centered, rounds, seed)
    dist = within(center, np.linalg.pinv(cov, hermitian=True))
    correction = _quantile(dist, "value", 0.5) / chi2_quantile(0.5, width)
    cov = cov * correction
    cut = chi2_quantile(0.975, width)
    kept = within(center, np.linalg.pinv(cov, hermitian=True)).filter(F.col("value") < cut)
    m = moments(kept, "x", width=width)[""]
    center, cov = _location(m, centered)
    model = Envelope(center, np.linalg.pinv(cov, hermitian=True), 0.0)
    scored = map_blocks(df, lambda c: {"value": -model.distance(c["x"])}, [("value", "double")], ["x"], [])
    offset = _quantile(scored, "value", contamination)
    df.unpersist()
    return Envelope(center, model.precision, offset)


def _location(m: Moments, centered: bool):
    if centered:
        return np.zeros(m.p), m.xx / m.n + np.outer(m.x_mean, m.x_mean)
    return m.x_mean, m.xx / m.n


_STARTS = 30
_TRIED, _BEST = 2, 10    # steps of all starts, and starts that go on after them
_HELD_MOMENTS = 4 << 20  # numbers of the moments of a group of starts in one pass


def _elemental(df: DataFrame, n: int, width: int, centered: bool, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centre and covariance of each start: ``width`` + 1 rows by hash, no row twice where there are enough."""
    size = min(n, width + 1)
    ids = [r["ix"] for r in df.select("ix").orderBy(F.xxhash64("ix", F.lit(seed), F.lit("start")), "ix").limit(_STARTS * size).collect()]
    rng = np.random.default_rng(seed)
    sets = [ids[k * size:(k + 1) * size] if len(ids) == _STARTS * size else rng.choice(ids, size, replace=False).tolist() for k in range(_STARTS)]
    named = df.sparkSession.createDataFrame([(int(i), k) for k, own in enumerate(sets) for i in own], "ix long, start int")
    found = moments(df.join(F.broadcast(named), "ix"), "x", key="start", width=width)
    made = [_location(found[k], centered) for k in sorted(found, key=int)]
    return [(c, v + 1e-9 * max(np.trace(v) / width, 1e-12) * np.eye(width)) for c, v in made]


def _least_determinant(df: DataFrame, n: int, width: int, h: int, centered: bool, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the start whose C-steps end at the smallest determinant."""
    state = _elemental(df, n, width, centered, seed)
    guide = _guide(df, n, width), h / n
    packed = _packed(df, width).persist()
    few = few_tasks(packed)
    last = np.full(len(state), np.inf)
    active = list(range(len(state)))
    step = max(1, _HELD_MOMENTS // (1 + width + width * width))
    for done in range(rounds):
        if done == _TRIED:
            active = sorted(active, key=lambda k: last[k])[:_BEST]
        moving = []
        for at in range(0, len(active), step):
            group = active[at:at + step]
            for k, (center, cov) in zip(group, _c_step(packed, width, [state[k] for k in group], h, centered, few, guide)):
                size = np.linalg.slogdet(cov + 1e-12 * np.trace(cov) / width * np.eye(width))[1]
                state[k] = center, cov
                if size < last[k] - 1e-7:
                    moving.append(k)
                last[k] = size
        active = moving
        if not active:
            break
    packed.unpersist()
    return state[int(np.argmin(last))]


_PACKED_BYTES = 1 << 20  # of rows that are packed as one
_TILE = 4096             # rows whose distances are taken at once, so that they stay in cache
_GUIDE = 16_384          # rows that tell about where a rank lies
_BINS = 256              # cells that a pass cuts a range of distances into
_LOOSE = 1 << 21         # numbers of single rows that may reach the driver in one pass


def _packed(df: DataFrame, width: int) -> DataFrame:
    """The rows as blocks of bytes (variables x rows), which passes read without converting rows."""
    most = max(1, _PACKED_BYTES // (8 * width))

    def pack(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = block(batch.column("x"))
            for a in range(0, len(x), most):
                held = np.ascontiguousarray(x[a:a + most].T).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], names=["block"])

    return df.select("x").mapInArrow(pack, "block binary")


def _guide(df: DataFrame, n: int, width: int) -> np.ndarray:
    """Some rows by hash. They only say where to look first for a rank, which all rows decide."""
    size = max(1, min(_GUIDE, (_GUIDE << 8) // width))
    drawn = df.filter(F.pmod(F.xxhash64("ix", F.lit("guide")), F.lit(n // size + 1)) == 0).select("x").limit(2 * size).toArrow()
    return block(drawn["x"]) if drawn.num_rows else np.empty((0, width))


def _about(center: np.ndarray, p: np.ndarray, rows: np.ndarray, share: float) -> tuple[float, float]:
    """A range of distances that probably holds that of rank ``share``."""
    d = np.sort(_distances(rows.T - center[:, None], p))
    d = d[~np.isnan(d)]
    slack = 4.5 * np.sqrt(share * (1 - share) * len(d)) + 4
    low, high = int(np.floor(share * len(d) - slack)), int(np.ceil(share * len(d) + slack))
    return float(d[low]) if low >= 0 and len(d) else 0.0, float(d[high]) if high < len(d) else np.inf


def _distances(z: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The quadratic form of every column; of few variables without a product whose rounding depends on the place of a row."""
    if len(z) > 8:
        return np.maximum(np.einsum("ij,ij->j", p @ z, z), 0.0) + 0.0
    out = np.zeros(z.shape[1])
    for i in range(len(z)):
        own = p[i, i] * z[i]
        for j in range(i):
            own += (p[i, j] + p[j, i]) * z[j]
        own *= z[i]
        out += own
    return np.maximum(out, 0.0, out=out) + 0.0


def _bits(value: float) -> int:
    """The image of a distance: whole numbers that sort as the distances do."""
    return int(np.array([value]).view(np.int64)[0])


def _tiles(blocks, width: int):
    for held in blocks:
        x = np.frombuffer(held, np.float64).reshape(width, -1)
        for a in range(0, x.shape[1], _TILE):
            yield x[:, a:a + _TILE]


def _cells(packed: DataFrame, width: int, wanted: list[tuple], few: bool) -> list[tuple]:
    """Per (centre, form, lowest, highest) the least and greatest distance and the count of every cell, and how many
    distances lie below all cells and how many are numbers."""
    cuts = []
    for _, _, low, high in wanted:
        first, span = _bits(low), _bits(high) - _bits(low)
        cuts.append((first, max(0, span.bit_length() - _BINS.bit_length() + 1)))

    def count(b):
        least = np.full((len(wanted), 2, _BINS), np.inf)
        sums = np.zeros((len(wanted), _BINS + 2))
        for held in b["block"]:
            inside = [[] for _ in wanted]
            for x in _tiles([held], width):
                for k, (c, p, low, high) in enumerate(wanted):
                    d = _distances(x - c[:, None], p)
                    sums[k, -2] += np.count_nonzero(d < low)
                    sums[k, -1] += np.count_nonzero(d == d)
                    inside[k].append(d[(d >= low) & (d <= high)])
            for k, (first, shift) in enumerate(cuts):
                d = np.sort(np.concatenate(inside[k]))
                cell = (d.view(np.int64) - first) >> shift
                start, end = (np.searchsorted(cell, np.arange(_BINS), side=s) for s in ("left", "right"))
                some = end > start
                sums[k, :_BINS] += end - start
                least[k, 0, some] = np.minimum(least[k, 0, some], d[start[some]])
                least[k, 1, some] = np.minimum(least[k, 1, some], -d[end[some] - 1])
        return np.concatenate([least.ravel(), sums.ravel()])

    edge = len(wanted) * 2 * _BINS
    found = sum_blocks(packed, ["block"], count, few, minima=edge)
    least, sums = found[:edge].reshape(len(wanted), 2, _BINS), found[edge:].reshape(len(wanted), -1)
    return [(e[0], -e[1], s[:_BINS], s[-2], s[-1]) for e, s in zip(least, sums)]


def _within(packed: DataFrame, width: int, wanted: list[tuple], few: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per (centre, form, lowest, highest) the moments of the rows below the range, and the (distance, row) of those in it.

    Rows of one single distance count as below.
    """
    size = 1 + width + width * width

    def run(batches):
        sums, loose = np.zeros((len(wanted), size)), []
        for batch in batches:
            for x in _tiles(vector(batch.column("block")), width):
                for k, (c, p, low, high) in enumerate(wanted):
                    z = x - c[:, None]
                    d = _distances(z, p)
                    own = np.compress(d <= high if low == high else d < low, z, axis=1)
                    sums[k, 0] += own.shape[1]
                    sums[k, 1:1 + width] += own.sum(axis=1)
                    sums[k, 1 + width:] += (own @ own.T).ravel()
                    if low < high:
                        at = np.flatnonzero((d >= low) & (d <= high))
                        loose.append(np.column_stack([np.full(len(at), k), d[at], z[:, at].T]).ravel())
        context = TaskContext.get()
        salt = (context.partitionId() if context else 0) % SALTS
        loose = np.concatenate(loose) if loose else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), lists(sums.reshape(1, -1)), lists(loose[None, :])],
                                         names=["salt", "v", "loose"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loose = 0.0, []
        for batch in batches:
            sums = sums + block(batch.column("v")).sum(axis=0)
            loose.append(batch.column("loose").flatten().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([lists(sums[None, :]), lists(np.concatenate(loose)[None, :])], names=["v", "loose"])

    parts = packed.mapInArrow(run, "salt int, v array<double>, loose array<double>")
    if not few:
        parts = parts.groupBy("salt").applyInArrow(merged, "v array<double>, loose array<double>")
    table = parts.select("v", "loose").toArrow()
    sums = block(table["v"]).sum(axis=0).reshape(len(wanted), size)
    rows = table["loose"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width + 2)
    return sums, [rows[rows[:, 0] == k, 1:] for k in range(len(wanted))]


def _c_step(df: DataFrame, width: int, starts: list[tuple[np.ndarray, np.ndarray]], h: int, centered: bool, few: bool,
            guide: tuple[np.ndarray, float] | None = None):
    """Centre and covariance of the h rows (and ties) that are nearest to each start.

    The first pass counts distances in the cells of a range about the h-th, as the rows of ``guide`` tell; it is
    repeated over the cell of the h-th as long as that holds many rows of several distances, or over what lies
    beyond the range should the rank be there. ``guide``: some rows, and the share of rows that are to be found. The second takes the moments of what lies below the cell and brings its rows.
    """
    packed = df if "block" in df.columns else _packed(df, width)
    centers = [c for c, _ in starts]
    inverses = [np.linalg.pinv(v, hermitian=True) for _, v in starts]
    most = max(1, _LOOSE // (len(starts) * (width + 2)))
    ranges = [_about(c, p, *guide) if guide else (0.0, np.inf) for c, p in zip(centers, inverses)]
    cells: dict[int, tuple] = {}  # start: lowest and highest distance of the cell, rows below it, rank of the last row
    while len(cells) < len(starts):
        open_ = [k for k in range(len(starts)) if k not in cells]
        found = _cells(packed, width, [(centers[k], inverses[k], *ranges[k]) for k in open_], few)
        for k, (low, high, count, below, numbers) in zip(open_, found):
            rank = min(h, int(numbers)) - 1
            upto = below + np.cumsum(count)
            if rank < 0:
                cells[k] = (np.nan, np.nan, 0, rank)
            elif rank < below:
                ranges[k] = 0.0, float(np.nextafter(ranges[k][0], -np.inf))
            elif rank >= upto[-1]:
                ranges[k] = float(np.nextafter(ranges[k][1], np.inf)), np.inf
            else:
                at = int(np.searchsorted(upto, rank, "right"))
                ranges[k] = float(low[at]), float(high[at])
                if low[at] == high[at] or count[at] <= most:
                    cells[k] = (*ranges[k], int(upto[at] - count[at]), rank)
    sums, loose = _within(packed, width, [(c, p, *cells[k][:2]) for k, (c, p) in enumerate(zip(centers, inverses))], few)
    made = []
    for k, c in enumerate(centers):
        low, high, below, rank = cells[k]
        own = sums[k]
        if len(loose[k]):
            d = loose[k][:, 0]
            z = loose[k][d <= np.sort(d)[rank - below], 1:]
            own = own + np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        m, total_ = own[1:1 + width] / own[0], own[1 + width:].reshape(width, width) / own[0]
        made.append((np.zeros(width), total_) if centered else (c + m, total_ - np.outer(m, m)))
    return made


# --- common front end ---------------------------------------------------------------------

@dataclass(frozen=True)
class LOF:
    train: DataFrame
    fitted: DataFrame
    k: int
    width: int
    offset: float


def fit_novelty(df: DataFrame, method: str, width: int, **hp):
    """Fit on the reference rows ``df`` (ix, x)."""
    if method in ("simca", "dd_simca"):
        m = moments(df, "x", width=width)[""]
        return simca(df, m, **hp) if method == "simca" else dd_simca(df, m, **hp)
    n = df.count()
    _require(n)
    if method == "isolation_forest":
        return isolation_forest(df, n, width, **hp)
    if method == "elliptic_envelope":
        return elliptic_envelope(df, n, width, **hp)
    if method == "lof":
        k = min(max(2, hp.get("k", 20)), n - 1)
        fitted = neighbors.lof_fit(df, k, width=width)
        return LOF(df, fitted, k, width, neighbors.lof_offset(fitted, min(0.5, max(1e-4, hp.get("contamination", 0.1)))))
    if method == "one_class_svm":
        kernel = hp.get("kernel", "rbf")
        gamma = hp.get("gamma") or 1.0 / width
        f = kernels.features(kernel, width, gamma, hp.get("size", 256), hp.get("degree", 3), hp.get("coef0", 0.0))
        return kernels.one_class_svm(df, f, hp.get("nu", 0.1))
    raise ValueError(f"unknown one-class method {method}")


def score_novelty(model, df: DataFrame) -> DataFrame:
    """Adds score and inlier (and the method's own columns)."""
    if isinstance(model, LOF):
        scored = neighbors.lof_score(df, model.train, model.fitted, model.k, width=model.width)
        out = df.drop("x").join(scored, "ix").withColumn("score", -F.col("lof") - model.offset)
        return out.withColumn("inlier", F.when(F.col("score") >= 0, 1).otherwise(-1)).drop("lof")
    if isinstance(model, kernels.OneClassMachine):
        return model.score(df).withColumn("inlier", F.when(F.col("score") >= 0, 1).otherwise(-1))
    return score_with(model, df)


def probabilities(scored: DataFrame) -> DataFrame:
    """Adds ``p_reference``: each side of the boundary scaled by its own 90th percentile.

    Scores are turned over when the predicted inliers lie below the outliers.
    """
    finite = scored.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    sides = finite.select(F.col("inlier").alias("pos"), F.col("score").alias("value"))
    medians = {k[0]: v[0] for k, v in exact_quantiles(sides, [0.5]).items()}
    direction = 1.0
    if 1 in medians and -1 in medians:
        direction = -1.0 if medians[1] < medians[-1] else 1.0
    elif medians.get(1, 0.0) < 0 or medians.get(-1, 0.0) > 0:
        direction = -1.0
    s = F.col("score") * direction
    margins = finite.select(F.col("inlier").alias("side"), s.alias("s"))
    has = {side: side in medians for side in (1, -1)}
    scales = {}
    for side in (1, -1):
        values = margins.filter(F.col("side") == side) if has[side] else margins
        values = values.select(F.lit(0).alias("pos"), (F.col("s") * side).alias("value")).filter("value > 0")
        found = exact_quantiles(values, [0.9, 0.5]).get((0,))
        size = 0.0
        if found:
            size = found[0] if found[0] > 1e-12 else found[1]
        scales[side] = size / np.log(10.0) if size > 1e-12 else 1.0
    p = F.when(s > 0, 0.5 + 0.5 * (1 - F.exp(-s / scales[1]))).when(s < 0, 0.5 * F.exp(s / scales[-1])).otherwise(0.5)
    out = scored.withColumn("p_reference", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p)))
    if has[1] and has[-1] and direction * (medians[1] - medians[-1]) < 0:
        out = out.withColumn("p_reference", 1 - F.col("p_reference"))
    return out


def novelty_cv(df: DataFrame, is_reference, method: str, width: int, cv: CV, **hp) -> DataFrame:
    """(ix, score, inlier, out_of_fold): reference rows are judged by models that left them out.

    The other rows keep the full model's verdict, as do rows of folds with too few training
    rows. SIMCA methods fit all folds from subtracted moments; the others refit per fold.
    """
    reference = df.filter(is_reference)
    full_model = fit_novelty(reference, method, width, **hp)
    full = score_novelty(full_model, df.select("ix", "x")).select("ix", "score", "inlier")
    indexed, n = with_index(reference.select(F.col("ix").alias("_ix"), "x"), ["_ix"])
    if n <= MIN_REFERENCE:
        return full.withColumn("out_of_fold", F.lit(False))
    assigned = assign(indexed, cv, n)
    if method in ("simca", "dd_simca") and cv.strategy != "loocv":
        train = training_rows(assigned)
        if cv.partitions:
            parts = moments(assigned, "x", key="fold", width=width)
            whole = total(parts.values())
            fits = {int(f): whole - m for f, m in parts.items()}
        else:
            fits = {int(f): m for f, m in moments(train, "x", key="fold", weight="weight", width=width).items()}
        fits = {f: m for f, m in fits.items() if m.n >= MIN_REFERENCE}
        components = hp.get("components", 2)
        spaces = {f: subspace(m, components, hp.get("scale", False)) for f, m in fits.items()}
        train = train.filter(F.col("fold").isin(list(spaces)))
        if method == "simca":
            conf = hp.get("confidence", 0.95)
            limits = _space_quantiles(train, spaces, conf, "fold")
            models = {f: _limits(spaces[f], limits[f], conf, hp.get("limits", "analytical"), hp.get("rule", "both"),
                                 hp.get("combine", "l1"), hp.get("q_limit", "empirical")) for f in spaces}
        else:
            models = _dd_fit(train, spaces, hp.get("alpha", 0.05), hp.get("gamma", 0.01), hp.get("limits", "classic"), "fold")

        def run(c):
            score, inlier = np.empty(len(c["x"])), np.empty(len(c["x"]), dtype=np.int32)
            for f in np.unique(c["fold"]):
                at = c["fold"] == f
                v = models[int(f)].values(c["x"][at])
                score[at], inlier[at] = v["score"], v["inlier"]
            return {"score": score, "inlier": inlier}

        tested = (assigned if cv.partitions else test_rows(assigned)).filter(F.col("fold").isin(list(models)))
        held = map_blocks(tested, run, [("score", "double"), ("inlier", "int")], ["x", "fold"], ["_ix", "fold"])
    else:
        held = None
        folds = [r["fold"] for r in test_rows(assigned).select("fold").distinct().orderBy("fold").collect()] \
            if cv.strategy != "loocv" else list(range(n))
        for f in folds:
            train = assigned.filter(F.col("fold") != f) if cv.partitions else \
                assigned.filter(F.array_contains("train_folds", f))
            rows = assigned.filter(F.col("fold") == f) if cv.partitions else \
                assigned.filter(F.array_contains("test_folds", f))
            if train.count() < MIN_REFERENCE:
                continue
            model = fit_novelty(train.select(F.col("_ix").alias("ix"), "x"), method, width, **hp)
            part = score_novelty(model, rows.select(F.col("_ix").alias("ix"), "x")).select(
                F.col("ix").alias("_ix"), "score", "inlier", F.lit(f).alias("fold"))
            held = part if held is None else held.unionByName(part)
    # a row tested more than once keeps its last fold
    last = held.groupBy("_ix").agg(F.max_by(F.struct("score", "inlier"), "fold").alias("h"))
    joined = full.join(last, full["ix"] == last["_ix"], "left")
    return joined.select("ix", F.coalesce("h.score", "score").alias("score"),
                         F.coalesce("h.inlier", "inlier").cast("int").alias("inlier"),
                         F.col("h").isNotNull().alias("out_of_fold"))
