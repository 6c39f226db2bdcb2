"""Nearest-neighbour and range joins, and the models built on them.

No cross join and no pair table: tasks compare blocks with blocks and hand on the k best, or
sums. A training side of checked size is broadcast. Beyond that it is cut into rings of bounded
size around pivots, and the triangle inequality tells which groups of rings a query must visit
(after Lu et al. 2012, kNN joins in MapReduce). Both ways are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..arrays import block, column_of, map_blocks, vector
from ..dataset import Dataset
from ..session import durable
from .moments import moments
from .ordering import rank_within
from .stats import exact_quantiles

BROADCAST_BYTES = 64 << 20   # largest training block a task may hold whole
RING_ROWS = 2048             # training rows per ring
MAX_RINGS = 1_000_000        # beyond, rings grow instead of their table
QUERY_ROWS = 4096            # queries per (ring, chunk) group
GROUP_ROWS = 65_536          # rows of either side in a cell of the block join
_SIDE = 8                    # blocks a side is cut into at least, so that there are cells for many tasks
_TASKS, _SPARE = 2000, 3     # tasks of the block join at most, and for each cell
_PIVOTS = 256
_WORK_BYTES = 32 << 20       # temporary distance cells per step
_TILE = 8192                 # training rows compared at a time
_TILE_32 = 2048              # training rows all of whose distances are taken where no bound is known
_QUERIES_32 = 32             # queries compared variable by variable with a tile; both stay in cache
_MANY = 8                    # one pair in so many is too many to be measured one by one
_LEVELS = 64                 # whole numbers of a variable, at least
_EPS_32 = 1.2e-7
_STEP_BYTES = 1 << 20        # differences of pairs measured one by one, per step
_UNDERFLOW = 38.7            # exp(-t²/2) is 0 in double precision beyond this t


# --- metrics ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Metric:
    """A distance on prepared vectors. ``bounded`` says the triangle inequality holds."""

    name: str = "euclidean"
    p: float = 3.0
    whiten: np.ndarray | None = None
    raw_zero: bool = False   # chord: a zero vector is compared by its plain distance

    @property
    def bounded(self) -> bool:
        return not (self.name == "minkowski" and self.p < 1)

    def prepare(self, x: np.ndarray) -> np.ndarray:
        if self.name == "mahalanobis":
            return x @ self.whiten
        if self.name == "chord":
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            unit = x / np.maximum(norm, 1e-12)
            return np.hstack([unit, norm]) if self.raw_zero else unit
        return x

    def odd(self, z: np.ndarray) -> np.ndarray:
        """Rows to which the triangle inequality does not apply."""
        if self.name == "chord" and self.raw_zero:
            return z[:, -1] == 0
        return np.zeros(len(z), dtype=bool)

    def direct(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Distance matrix by plain differences, in steps of bounded memory."""
        out = np.empty((len(q), len(t)))
        step = max(1, _WORK_BYTES // (8 * max(1, t.size)))
        for a in range(0, len(q), step):
            part = q[a:a + step]
            if self.name == "chord" and self.raw_zero:
                diff = part[:, None, :-1] - t[None, :, :-1]
                d = np.sqrt((diff * diff).sum(2))
                zero = (part[:, -1] == 0)[:, None] | (t[:, -1] == 0)[None, :]
                d = np.where(zero, np.abs(part[:, -1][:, None] - t[:, -1][None, :]), d)
            else:
                diff = np.abs(part[:, None, :] - t[None, :, :])
                if self.name == "manhattan":
                    d = diff.sum(2)
                elif self.name == "chebyshev":
                    d = diff.max(2)
                elif self.name == "minkowski":
                    d = (diff ** self.p).sum(2) ** (1 / self.p)
                else:
                    d = np.sqrt((diff * diff).sum(2))
            out[a:a + step] = d
        return out

    def paired(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Distances of row i to row i by plain differences, in steps of bounded memory."""
        out = np.empty(len(q))
        step = max(1, _WORK_BYTES // (8 * max(1, q.shape[1])))
        for a in range(0, len(q), step):
            x, y = q[a:a + step], t[a:a + step]
            if self.name == "chord" and self.raw_zero:
                diff = x[:, :-1] - y[:, :-1]
                d = np.sqrt((diff * diff).sum(1))
                d = np.where((x[:, -1] == 0) | (y[:, -1] == 0), np.abs(x[:, -1] - y[:, -1]), d)
            elif self.name == "manhattan":
                d = np.abs(x - y).sum(1)
            elif self.name == "chebyshev":
                d = np.abs(x - y).max(1)
            elif self.name == "minkowski":
                d = (np.abs(x - y) ** self.p).sum(1) ** (1 / self.p)
            else:
                diff = x - y
                d = np.sqrt((diff * diff).sum(1))
            out[a:a + step] = d
        return out

    @property
    def euclidean(self) -> bool:
        return self.name in ("euclidean", "mahalanobis") or (self.name == "chord" and not self.raw_zero)


def metric(train: DataFrame, name: str = "euclidean", p: float = 3.0, width: int | None = None,
           raw_zero: bool = False) -> Metric:
    if name not in ("euclidean", "manhattan", "minkowski", "chebyshev", "mahalanobis", "chord"):
        raise ValueError(f"unknown distance {name}")
    if name == "minkowski" and not (np.isfinite(p) and p > 0):
        raise ValueError("p must be positive")
    whiten = None
    if name == "mahalanobis":
        cov = moments(train, "x", width=width)[""].covariance(1)
        inverse = np.linalg.pinv(cov + 1e-10 * np.eye(len(cov)), hermitian=True)
        values, vectors = np.linalg.eigh(inverse)
        whiten = vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T
    return Metric(name, p, whiten, raw_zero and name == "chord")


# --- block kernels ------------------------------------------------------------------------

def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that are set, row by row."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def _up(limit: np.ndarray, kind, towards: float = np.inf) -> np.ndarray:
    """A limit in the precision of keys, not rounded down (or, ``towards`` -inf, not up)."""
    with np.errstate(over="ignore"):
        return np.nextafter(limit.astype(kind), np.array(towards, kind))


def _below(keys: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Where keys are at most the limit of their row."""
    return keys <= _up(limit, keys.dtype)[:, None]


class _Rough:
    """Quick keys that grow with the distances, and how far a key may be off.

    Euclidean keys are squares from one matrix product, in single precision if ``single``; those of the other norms
    are sums (or maxima) in single precision, variable by variable. What neither can bound is measured by differences.
    Pairs that are too far by whole numbers (Manhattan, Chebyshev) or by their plain distance (Minkowski) need no key.
    """

    def __init__(self, m: Metric, q: np.ndarray, t: np.ndarray, single: bool = False):
        self.m, self.q, self.t = m, q, t
        self.zero = m.name == "chord" and m.raw_zero
        self.kind, self.power, self.lower, self.unit = "direct", 1.0, None, 0.0
        largest = max(np.abs(q).max(initial=0), np.abs(t).max(initial=0)) if single else np.nan
        if m.euclidean or self.zero:
            self.kind, self.power = "product", 2.0
            uq, ut = (q[:, :-1], t[:, :-1]) if self.zero else (q, t)
            eps = 16e-16
            if largest < 1e15:  # not so for NaN
                centre = ut.mean(0)
                uq, ut, eps = (uq - centre).astype(np.float32), (ut - centre).astype(np.float32), 4 * _EPS_32
                eps *= 1 + np.abs(centre).max(initial=0) / max(np.abs(ut).max(initial=0), 1e-30)
            self.uq, self.ut = uq, ut
            self.qq, self.tt = (uq * uq).sum(1), (ut * ut).sum(1)
            top = self.tt[np.isfinite(self.tt)].max(initial=0) + 1e-30
            if self.zero:
                self.q_zero, self.t_zero = q[:, -1] == 0, t[:, -1] == 0
                if self.q_zero.any() or self.t_zero.any():
                    top = top + np.square(np.abs(q[:, -1]) + np.abs(t[:, -1]).max(initial=0))
            self.slack = eps * (uq.shape[1] + 4) * (self.qq.astype(float) + top)
        elif (m.name != "minkowski" or 1 <= m.p <= 8) and largest < 1e4:
            self.kind, self.power = "single", m.p if m.name == "minkowski" else 1.0
            self.q32, self.own32 = q.astype(np.float32), t.astype(np.float32)
            self.t32 = np.ascontiguousarray(self.own32.T)
            # what is lost to rounding, and below the smallest single number
            self.off = _EPS_32 * (np.abs(q).sum(1) + np.abs(t).sum(1).max(initial=0)) + (q.shape[1] * 1.2e-38) ** (1 / self.power)
            self.rel = _EPS_32 * (q.shape[1] + 40) * 2
            if m.name == "minkowski" and m.p >= 2:  # the plain distance bounds the others from below
                self.lower, self.room = _Rough(Metric(), q, t, True), q.shape[1] ** (1 - 2 / m.p)
            elif m.name in ("manhattan", "chebyshev") and len(q) >= _QUERIES_32 and len(t):
                self.unit = None

    def _count(self, limit: np.ndarray) -> None:
        """Rows in whole numbers: variables drawn into one range, which brings no pair farther apart, and what rounding leaves."""
        self.unit, self.held = 0.0, None
        centre = self.t.mean(0)
        off = self.t - centre
        top = min(max(np.abs(off).max(), np.abs(self.q - centre).max()), 6 * np.sqrt(np.square(off).mean()))
        if not top > 0:
            return
        # bytes where they resolve the limit
        kind = np.int8 if self.m.name == "chebyshev" and limit.max() * 63 > _LEVELS / 8 * top else np.int16
        levels = np.iinfo(kind).max // (self.q.shape[1] if self.m.name == "manhattan" else 1)
        if levels < _LEVELS:
            return
        self.unit = 2 * top / (levels - 1)
        whole, self.left = [], []
        for x in (self.q, self.t):
            at = (np.clip(x - centre, -top, top) + top) / self.unit
            near = np.rint(at)
            whole.append(near.astype(kind))
            gap = np.abs(at - near)
            self.left.append(gap.sum(1) if self.m.name == "manhattan" else gap.max(1, initial=0))
        self.q_whole, self.t_whole = whole[0], np.ascontiguousarray(whole[1].T)

    def _near(self, a: int, to: int, b: int, end: int, limit: np.ndarray) -> np.ndarray:
        """Which pairs are, in whole numbers, not beyond the distances ``limit``."""
        if self.held is None or self.held[0].shape != (to - a, end - b):
            self.held = tuple(np.empty((to - a, end - b), self.q_whole.dtype) for _ in range(2))
        out, gap = self.held
        out[:] = 0
        join = np.maximum if self.m.name == "chebyshev" else np.add
        for j in range(len(self.t_whole)):
            np.subtract(self.q_whole[a:to, j, None], self.t_whole[j, None, b:end], out=gap)
            join(out, np.abs(gap, out=gap), out=out)
        far = (limit / self.unit + self.left[0][a:to] + self.left[1][b:end].max()) * (1 + 1e-9) + 1e-6
        return out <= np.minimum(far, np.iinfo(out.dtype).max).astype(out.dtype)[:, None]

    @property
    def steps(self) -> tuple[int, int]:
        """Queries and training rows that are compared at a time."""
        most = _WORK_BYTES // (8 * max(1, len(self.t)))
        return _QUERIES_32 if self.kind == "single" else max(32, min(256, most)), _TILE_32 if self.kind == "direct" else _TILE

    def _sums(self, a: int, to: int, b: int, end: int, limit: np.ndarray | None = None):
        """Keys of all pairs, or, as soon as few pairs are within ``limit``, which ones, and their keys."""
        out = np.zeros((to - a, end - b), np.float32)
        gap = np.empty_like(out)
        width = len(self.t32)
        for j in range(width):
            np.subtract(self.q32[a:to, j, None], self.t32[j, None, b:end], out=gap)
            self._add(out, np.abs(gap, out=gap))
            if limit is not None and j % 16 == 15 and j + 1 < width:
                left = out <= limit[:, None]
                if np.count_nonzero(left) * 16 < left.size:
                    i, at = np.nonzero(left)
                    own = out[i, at]
                    for rest in range(j + 1, width):
                        self._add(own, np.abs(self.q32[i + a, rest] - self.t32[rest, at + b]))
                    return i, at, own
        return out

    def _add(self, out: np.ndarray, gap: np.ndarray) -> None:
        if self.m.name == "chebyshev":
            np.maximum(out, gap, out=out)
        elif self.power == 1:
            out += gap
        elif self.power == int(self.power):
            whole = gap * gap
            for _ in range(int(self.power) - 2):
                whole *= gap
            out += whole
        else:
            out += np.power(gap, self.power)

    def keys(self, a: int, to: int, b: int, end: int) -> np.ndarray:
        if self.kind == "single":
            return self._sums(a, to, b, end)
        if self.kind == "direct":
            return self.m.direct(self.q[a:to], self.t[b:end])
        out = (-2 * self.uq[a:to]) @ self.ut[b:end].T
        out += self.qq[a:to, None]
        out += self.tt[None, b:end]
        if self.zero and (self.q_zero[a:to].any() or self.t_zero[b:end].any()):
            gap = np.square(self.q[a:to, -1][:, None] - self.t[b:end, -1][None, :])
            out = np.where(self.q_zero[a:to, None] | self.t_zero[None, b:end], gap, out)
        return out

    def _each(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of single pairs."""
        out, ones = np.empty(len(i), np.float32), np.ones(len(self.t32), np.float32)
        size = max(1, _STEP_BYTES // (4 * max(1, len(self.t32))))
        for c in range(0, len(i), size):
            gap = np.take(self.own32, at[c:c + size], axis=0)
            gap -= np.take(self.q32, i[c:c + size], axis=0)
            np.abs(gap, out=gap)
            if self.m.name == "chebyshev":
                out[c:c + size] = gap.max(1, initial=0)
                continue
            whole = gap
            if self.power != int(self.power):
                whole = np.power(gap, self.power)
            elif self.power > 1:
                whole = gap * gap
                for _ in range(int(self.power) - 2):
                    whole *= gap
            out[c:c + size] = whole @ ones
        return out

    def within(self, a: int, to: int, b: int, end: int, limit: np.ndarray):
        """(query, training row, key) of the pairs whose key is at most ``limit``, and maybe of others beyond."""
        mask = None
        if self.lower is not None:
            mask = self.lower.mask(a, to, b, end, self.lower.wide(limit ** (2 / self.power) * self.room, a, to))
        else:
            if self.unit is None:
                self._count(limit)
            if self.unit:
                mask = self._near(a, to, b, end, limit)
        if mask is not None and np.count_nonzero(mask) * _MANY < mask.size:
            i, at = _where(mask)
            own = self._each(i + a, at + b)
            keep = own <= _up(limit, own.dtype)[i]
            return i[keep], at[keep], own[keep]
        found = self._sums(a, to, b, end, limit) if self.kind == "single" else self.keys(a, to, b, end)
        if isinstance(found, tuple):
            return found
        i, at = _where(_below(found, limit))
        return i, at, found[i, at]

    def mask(self, a: int, to: int, b: int, end: int, limit: np.ndarray) -> np.ndarray:
        return _below(self.keys(a, to, b, end), limit)

    def wide(self, key: np.ndarray, a: int, to: int) -> np.ndarray:
        """A bound on the keys of all pairs that are no farther than those of key ``key``."""
        key = np.where(np.isnan(key), np.inf, key).astype(float)
        if self.kind == "product":
            return key + 2 * self.slack[a:to]
        if self.kind == "direct":
            return key
        off = self.off[a:to]
        far = ((np.maximum(key, 0) ** (1 / self.power) * (1 + self.rel) + off) * (1 + self.rel) + off)
        return far ** self.power * (1 + self.rel)

    def of(self, d: np.ndarray, a: int, to: int) -> np.ndarray:
        """A bound on the keys of all pairs no farther than ``d``."""
        return self.wide(d ** self.power, a, to)


def _candidates(rough: _Rough, a: int, to: int, q_not, t_not, k: int, theta):
    """(query, training row, key) of all pairs that may be among the k nearest of queries ``a`` to ``to``."""
    tile, n = rough.steps[1], len(rough.t)
    limit = np.full(to - a, np.inf) if theta is None else rough.of(theta[a:to], a, to)
    if rough.lower is not None and k <= n:
        limit = np.minimum(limit, rough.of(_reached(rough, a, to, q_not, t_not, k), a, to))
    parts, b, done = [], 0, 0
    while b < n:
        end = min(b + tile, n)
        if b == 0 and not np.isfinite(limit).all() and k <= n:
            end = min(max(k, _TILE_32), n)
            key = rough.keys(a, to, b, end)
            if q_not is not None:
                key = np.where(q_not[a:to, None] == t_not[None, :end], np.inf, key)
            limit = np.minimum(limit, rough.wide(np.partition(key, k - 1, axis=1)[:, k - 1], a, to))
            i, at = _where(key <= limit[:, None])
            own = key[i, at]
        else:
            i, at, own = rough.within(a, to, b, end, limit)
        keep = np.isfinite(own)
        if q_not is not None:
            keep &= q_not[i + a] != t_not[at + b]
        parts.append((i[keep], at[keep] + b, own[keep]))
        b, done = end, done + 1
        if done > 1 and done & (done - 1) == 0 and end < n:  # after 2, 4, 8 tiles the limit is drawn closer
            parts = [_ordered(parts)]
            limit = np.minimum(limit, rough.wide(_kth(parts[0][0], parts[0][2], to - a, k), a, to))
            keep = parts[0][2] <= limit[parts[0][0]]
            parts = [tuple(c[keep] for c in parts[0])]
    return _ordered(parts)


def _reached(rough: _Rough, a: int, to: int, q_not, t_not, k: int) -> np.ndarray:
    """A distance within which each query has k rows: that of the farthest of the k nearest by plain distance."""
    i, at, _ = _candidates(rough.lower, a, to, q_not, t_not, k, None)
    first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
    i, at = i[first], at[first]
    out = np.zeros(to - a)
    np.maximum.at(out, i, rough.m.paired(rough.q[i + a], rough.t[at]))
    return np.where(np.bincount(i, minlength=to - a) >= k, out, np.inf)


def _ordered(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, at, own = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((own, i))
    return i[order], at[order], own[order].astype(float)


def _kth(near_q: np.ndarray, key: np.ndarray, queries: int, k: int) -> np.ndarray:
    """The k-th key of each query, infinite where there are fewer."""
    start, end = (np.searchsorted(near_q, np.arange(queries), side=s) for s in ("left", "right"))
    enough = end - start >= k
    out = np.full(queries, np.inf)
    out[enough] = key[start[enough] + k - 1]
    return out


def _nearest(m: Metric, q, q_not, t, t_ix, t_not, k: int, theta=None):
    """Per query the k nearest (distance, then training position) of a block.

    A pair with equal ``q_not`` and ``t_not`` (None: no exclusion) does not count; ``theta`` is a distance per query
    beyond which rows need not be found. Pairs are ranked by quick keys; every pair within their error of
    the k-th is then measured again by differences, so the result is that of plain distances.
    """
    rows_q, rows_t, dist = [], [], []
    rough, fine = _Rough(m, q, t, True), None
    step = rough.steps[0]
    for a in range(0, len(q) if len(t) else 0, step):
        to = min(a + step, len(q))
        used = rough
        for used in (rough, None):
            if used is None:  # single precision tells too few pairs apart
                used = fine = fine or _Rough(m, q, t)
            near_q, near_t, key = _candidates(used, a, to, q_not, t_not, k, theta)
            keep = key <= used.wide(_kth(near_q, key, to - a, k), a, to)[near_q]
            if used is not rough or rough.kind != "product" or keep.sum() <= 16 * (k + 8) * (to - a):
                break
        near_q, near_t = near_q[keep], near_t[keep]
        d = np.empty(len(near_q))
        size = max(1, _WORK_BYTES // (8 * max(1, q.shape[1])))
        for b in range(0, len(near_q), size):
            d[b:b + size] = m.paired(q[near_q[b:b + size] + a], t[near_t[b:b + size]])
        order = np.lexsort((t_ix[near_t], d, near_q))
        near_q, near_t, d = near_q[order], near_t[order], d[order]
        start = np.searchsorted(near_q, near_q, side="left")
        first = (np.arange(len(near_q)) - start < k) & np.isfinite(d)
        rows_q.append(near_q[first] + a)
        rows_t.append(near_t[first])
        dist.append(d[first])
    if not rows_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows_q), np.concatenate(rows_t), np.concatenate(dist)


def _in_range(m: Metric, kind: str, d, par):
    return d <= par if kind == "radius" else 1.0 / (1.0 + d) > par


def _weighted(m: Metric, kind: str, q, q_not, q_par, t, t_not, t_y, h: float):
    """Per query Σw and Σw·y of a block under a range or kernel weight.

    Euclidean distances come from matrix products; pairs within the error of a limit are measured by differences.
    """
    if kind != "kernel" and m.euclidean:
        return _ranged(m, kind, q, q_not, q_par, t, t_not, t_y)
    sw = np.zeros(len(q))
    swy = np.zeros((len(q), t_y.shape[1]))
    rough = _Rough(m, q, t) if m.euclidean else None
    if rough is not None and not np.all(rough.slack < 1e-10 * h * h):
        rough = None
    tile = _TILE if rough is not None else max(1, len(t))
    step = max(1, _WORK_BYTES // (8 * max(1, min(tile, len(t)))))
    for a in range(0, len(q), step):
        to = min(a + step, len(q))
        for b in range(0, len(t), tile):
            end = min(b + tile, len(t))
            if rough is None:
                d = m.direct(q[a:to], t[b:end])
                w = np.exp(-0.5 * np.square(np.maximum(d, 1e-12) / h)) if kind == "kernel" else \
                    _in_range(m, kind, d, q_par[a:to, None]).astype(float)
            else:
                w = rough.keys(a, to, b, end)
                np.maximum(w, 0, out=w)
                w *= -0.5 / (h * h)
                np.exp(w, out=w)
            if q_not is not None:
                w = np.where(q_not[a:to, None] == t_not[None, b:end], 0.0, w)
            sw[a:to] += w.sum(1)
            swy[a:to] += w @ t_y[b:end]
    return sw, swy


def _ranged(m: Metric, kind: str, q, q_not, q_par, t, t_not, t_y):
    """``_weighted`` of a Euclidean range: keys in single precision where they tell pairs apart."""
    sw = np.zeros(len(q))
    swy = np.zeros((len(q), t_y.shape[1]))
    rough = _Rough(m, q, t, True)
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = q_par if kind == "radius" else np.where(q_par > 0, 1 / q_par - 1, np.inf)
        square = reach * reach
        # beyond any error of the limit itself
        slack = rough.slack + 1e-12 * np.where(np.isfinite(square), square + reach + 1, 0)
    if not np.all(slack < 1e-3 * square):
        rough = _Rough(m, q, t)
        with np.errstate(invalid="ignore"):
            slack = rough.slack + 1e-12 * np.where(np.isfinite(square), square + reach + 1, 0)
    step, tile = rough.steps
    size = max(1, _WORK_BYTES // (8 * max(1, q.shape[1])))
    for a in range(0, len(q), step):
        to = min(a + step, len(q))
        for b in range(0, len(t), tile):
            end = min(b + tile, len(t))
            key = rough.keys(a, to, b, end)
            far = _below(key, square[a:to] + slack[a:to])
            i, j = _where(far)
            sure = key[i, j] <= _up(square[a:to] - slack[a:to], key.dtype, -np.inf)[i]
            verge = np.flatnonzero(~sure & np.isfinite(square[i + a]))
            for c in range(0, len(verge), size):
                at = verge[c:c + size]
                sure[at] = _in_range(m, kind, m.paired(q[i[at] + a], t[j[at] + b]), q_par[i[at] + a])
            if q_not is not None:
                sure &= q_not[i + a] != t_not[j + b]
            if len(i) * _MANY < far.size:
                i, j = i[sure], j[sure]
                sw[a:to] += np.bincount(i, minlength=to - a)
                for r in range(t_y.shape[1]):
                    swy[a:to, r] += np.bincount(i, weights=t_y[b:end, r][j], minlength=to - a)
                continue
            far[i, j] = sure
            w = far.astype(float)
            sw[a:to] += w.sum(1)
            swy[a:to] += w @ t_y[b:end]
    return sw, swy


# --- joins --------------------------------------------------------------------------------

_PAIR = [("q_ix", T.LongType()), ("t_ix", T.LongType()), ("d", T.DoubleType())]


def _schema(df: DataFrame, carry: list[str], extra: list[tuple[str, T.DataType]]) -> T.StructType:
    types = {f.name: f.dataType for f in df.schema.fields}
    return T.StructType([T.StructField(n, t) for n, t in extra] + [T.StructField(c, types[c]) for c in carry])


def _fits(train: DataFrame, width: int) -> tuple[bool, int]:
    n = train.count()
    return n * (width + 4) * 8 <= BROADCAST_BYTES, n


def _excluding(df: DataFrame, exclude: str | None, columns: list[str]) -> DataFrame:
    """The needed columns, with the exclusion key as ``_not``."""
    key = F.col(exclude).cast("long") if exclude else F.lit(None).cast("long")
    return df.select(*columns, key.alias("_not"))


def _keys(table, exclude: str | None):
    return vector(table["_not"]) if exclude else None


def knn_join(queries: DataFrame, train: DataFrame, k: int, m: Metric, width: int, carry: list[str] = (),
             exclude: str | None = None, strategy: str | None = None) -> DataFrame:
    """(q_ix, t_ix, d, rank, carried training columns): the k nearest of each query, exactly.

    Ties in distance go to the lower training position. ``exclude`` names a column of both
    sides: pairs that agree in it do not count ('ix' leaves the row itself out, 'fold' its fold).
    """
    carry = list(carry)
    train = _excluding(train, exclude, ["ix", "x", *carry])
    queries = _excluding(queries, exclude, ["ix", "x"])
    small, n = _fits(train, width)
    if strategy == "broadcast" or (strategy is None and small):
        schema = _schema(train, carry, _PAIR + [("rank", T.IntegerType())])
        target = to_arrow_schema(schema)
        table = train.toArrow()
        held = train.sparkSession.sparkContext.broadcast(
            (m.prepare(block(table["x"])) if n else None, vector(table["ix"]), _keys(table, exclude),
             [table[c].combine_chunks() for c in carry]))

        def search(batches):
            t, t_ix, t_not, cols = held.value
            for batch in batches:
                if batch.num_rows == 0 or t is None:
                    continue
                q_ix = vector(batch.column("ix"))
                a, b, d = _nearest(m, m.prepare(block(batch.column("x"))), _keys(batch, exclude), t, t_ix, t_not, k)
                rank = np.arange(len(a)) - np.searchsorted(a, a, side="left") + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ix[a]), pa.array(t_ix[b]), pa.array(d), pa.array(rank.astype(np.int32)),
                     *[c.take(pa.array(b)) for c in cols]], schema=target)

        return queries.mapInArrow(search, schema)
    rings = Rings(train, m, width, n, carry)
    first = rings.search(rings.home(queries), k, exclude)
    # the k-th distance met at home bounds the search everywhere
    bound = first.groupBy("q_ix").agg(F.when(F.count("*") >= k, F.max("d")).alias("theta"))
    visits = rings.visits(queries.join(bound, queries["ix"] == bound["q_ix"], "left").drop("q_ix"))
    found = rings.search(visits, k, exclude, grouped=True)
    w = W.partitionBy("q_ix").orderBy("d", "t_ix")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def range_sums(queries: DataFrame, train: DataFrame, kind: str, m: Metric, width: int, responses: int,
               h: float = 1.0, exclude: str | None = None, strategy: str | None = None) -> DataFrame:
    """(q_ix, sw, swy): sums of weights and weighted responses over the training rows in range.

    ``kind`` radius and similarity use the queries' ``par`` column; kernel uses bandwidth ``h``.
    Blocks add up sums, so no pair leaves a task.
    """
    train = _excluding(train, exclude, ["ix", "x", "y"])
    if "par" not in queries.columns:
        queries = queries.withColumn("par", F.lit(float("inf")))
    queries = _excluding(queries, exclude, ["ix", "x", "par"])
    small, n = _fits(train, width + responses)
    schema = "q_ix long, sw double, swy array<double>"
    if strategy == "broadcast" or (strategy is None and small):
        table = train.toArrow()
        held = train.sparkSession.sparkContext.broadcast(
            (m.prepare(block(table["x"])), _keys(table, exclude), block(table["y"])))

        def add(batches):
            t, t_not, t_y = held.value
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                sw, swy = _weighted(m, kind, m.prepare(block(batch.column("x"))), _keys(batch, exclude),
                                    vector(batch.column("par")), t, t_not, t_y, h)
                yield pa.RecordBatch.from_arrays([batch.column("ix"), column_of(sw), column_of(swy)],
                                                 names=["q_ix", "sw", "swy"])

        return queries.mapInArrow(add, schema)
    reach = {"radius": F.col("par"), "kernel": F.lit(_UNDERFLOW * h),
             "similarity": F.when(F.col("par") > 0, 1 / F.col("par") - 1).otherwise(float("inf"))}[kind]
    rings = Rings(train, m, width, n, ["y"])
    visits = rings.visits(queries.withColumn("theta", reach))

    def add(left, right):
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"q_ix": pa.array([], pa.int64()), "sw": pa.array([], pa.float64()),
                             "swy": pa.array([], pa.list_(pa.float64()))})
        sw, swy = _weighted(m, kind, m.prepare(block(left["x"])), _keys(left, exclude), vector(left["par"]),
                            m.prepare(block(right["x"])), _keys(right, exclude), block(right["y"]), h)
        return pa.table({"q_ix": left["ix"], "sw": column_of(sw), "swy": column_of(swy)})

    parts = rings.pairs(visits, add, schema, grouped=True)
    sums = [F.sum(F.get("swy", F.lit(i))).alias(f"_s{i}") for i in range(responses)]
    return (parts.groupBy("q_ix").agg(F.sum("sw").alias("sw"), *sums)
            .select("q_ix", "sw", F.array(*[F.col(f"_s{i}") for i in range(responses)]).alias("swy")))


def _home_ring(to_pivot, rings):
    """The ring of the nearest pivot whose bounds are closest to the query's own distance."""
    cell, lo, hi = rings
    nearest = to_pivot.argmin(1)
    own = to_pivot.min(1)[:, None]
    gap = np.maximum(np.maximum(lo[None, :] - own, own - hi[None, :]), 0.0)
    gap = np.where(cell[None, :] == nearest[:, None], gap, np.inf)
    none = ~np.isfinite(gap).any(1)
    gap[none] = 0.0
    mask = np.zeros(gap.shape, dtype=bool)
    mask[np.arange(len(gap)), gap.argmin(1)] = True
    return mask


class Rings:
    """Training rows cut into rings of at most ``RING_ROWS`` rows around pivots.

    A ring is a run of rows of one pivot's cell in order of distance to the pivot, so a cell
    that holds a third of the data becomes many rings. The ring table (bounds and counts) has
    n / RING_ROWS rows and is what a query is compared with.
    """

    def __init__(self, train: DataFrame, m: Metric, width: int, n: int, carry: list[str]):
        self.m, self.carry = m, carry
        # products are quick, other cells are made smaller
        self.side = max(RING_ROWS, min(GROUP_ROWS if m.euclidean else GROUP_ROWS // 2, -(-n // _SIDE)))
        spark = train.sparkSession
        count = max(1, min(_PIVOTS, n // RING_ROWS + 1))
        sample = train.select("x", "ix").orderBy(F.xxhash64("ix"), "ix").limit(count).toArrow()
        pivots = m.prepare(block(sample["x"]))
        pivots = pivots[~m.odd(pivots)]
        self.pivots = spark.sparkContext.broadcast(pivots)
        held = self.pivots

        def assign(c):
            z = m.prepare(c["x"])
            p = held.value
            d = m.direct(z, p) if len(p) else np.zeros((len(z), 1))
            odd = m.odd(z)
            return {"cell": np.where(odd, -1, d.argmin(1)).astype(np.int64),
                    "dp": np.where(odd, 0.0, d.min(1))}

        celled = map_blocks(train, assign, [("cell", "long"), ("dp", "double")], ["x"], train.columns)
        ranked = rank_within(celled, "cell", [F.col("dp"), F.col("ix")], "_r")
        ringed = durable(ranked.withColumn("_no", F.floor(F.col("_r") / max(RING_ROWS, -(-n // MAX_RINGS)))))
        table = (ringed.groupBy("cell", "_no").agg(F.min("dp").alias("lo"), F.max("dp").alias("hi"),
                                                   F.count("*").alias("n")).orderBy("cell", "_no").collect())
        ids = {(r["cell"], r["_no"]): i for i, r in enumerate(table)}
        # runs of rings, of about ``side`` rows
        before = np.cumsum([0] + [r["n"] for r in table[:-1]])
        group = np.unique(before // self.side, return_inverse=True)[1]
        lookup = spark.createDataFrame([(c, b, i, int(group[i])) for (c, b), i in ids.items()], "cell long, _no long, ring long, group long")
        self.rows = ringed.join(F.broadcast(lookup), ["cell", "_no"]).select("ring", "group", *train.columns)
        cell = np.array([r["cell"] for r in table])
        self.rings = spark.sparkContext.broadcast((
            cell, np.where(cell < 0, 0.0, [r["lo"] for r in table]),
            np.where(cell < 0, np.inf, [r["hi"] for r in table])))
        self.starts = np.flatnonzero(np.diff(group, prepend=-1))

    def _rows_for(self, queries: DataFrame, choose, place: str) -> DataFrame:
        """One row per (query, ring or group) chosen by ``choose(distances to pivots, batch) -> mask``."""
        m, held, rings = self.m, self.pivots, self.rings
        base = queries.schema
        schema = T.StructType([T.StructField(place, T.LongType())] + list(base.fields))

        def run(batches):
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                z = m.prepare(block(batch.column("x")))
                to_pivot = m.direct(z, held.value) if len(held.value) else np.zeros((len(z), 1))
                odd = m.odd(z)
                step = max(1, _WORK_BYTES // (32 * len(rings.value[0])))
                for at in range(0, len(z), step):
                    part = batch.slice(at, step)
                    q, r = np.nonzero(choose(to_pivot[at:at + step], odd[at:at + step], part, rings.value))
                    for a in range(0, len(q), 10_000):
                        taken = part.take(pa.array(q[a:a + 10_000]))
                        yield pa.RecordBatch.from_arrays([pa.array(r[a:a + 10_000]), *taken.columns],
                                                         names=[place, *base.names])

        return queries.mapInArrow(run, schema)

    def home(self, queries: DataFrame) -> DataFrame:
        return self._rows_for(queries, lambda d, odd, batch, rings: _home_ring(d, rings), "ring")

    def visits(self, queries: DataFrame) -> DataFrame:
        """Groups of rings that may hold a row within ``theta`` (NULL: unbounded) of the query."""
        bounded, starts = self.m.bounded, self.starts

        def choose(to_pivot, odd, batch, rings):
            cell, lo, hi = rings
            theta = vector(batch.column("theta")).astype(float)
            theta = np.where(np.isnan(theta) | odd, np.inf, theta)[:, None]
            if not bounded:
                mask = np.ones((len(to_pivot), len(cell)), dtype=bool)
            else:
                to = to_pivot[:, np.maximum(cell, 0)]
                # ring bounds, then the generalised hyperplane between two cells
                least = np.maximum(lo[None, :] - to, to - hi[None, :])
                least = np.maximum(least, (to - to_pivot.min(1)[:, None]) / 2)
                least = np.where(cell[None, :] < 0, 0.0, least)
                mask = least <= theta + 1e-9 * (1 + to)
            return np.logical_or.reduceat(mask, starts, axis=1)

        return self._rows_for(queries, choose, "group")

    def pairs(self, visits: DataFrame, fn, schema, grouped: bool = False) -> DataFrame:
        """Run ``fn(query table, table of a ring or group)`` on blocks of bounded size on both sides."""
        place, most = ("group", self.side) if grouped else ("ring", QUERY_ROWS)
        chunks = (visits.groupBy(place).count()
                  .select(place, F.ceil(F.col("count") / most).cast("int").alias("_chunks")))
        left = (visits.join(F.broadcast(chunks), place)
                .withColumn("_chunk", F.pmod(F.xxhash64("ix", F.lit(17)), F.col("_chunks")).cast("int"))
                .drop("_chunks"))
        right = (self.rows.drop("ring" if grouped else "group").join(F.broadcast(chunks), place)
                 .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks"))

        if grouped:  # a cell is much work for few rows: few cells share a task
            tasks = min(_TASKS, _SPARE * len(self.starts) ** 2)
            left, right = (side.repartition(tasks, place, "_chunk") for side in (left, right))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            return fn(a, b)

        return (left.groupBy(place, "_chunk").cogroup(right.groupBy(place, "_chunk"))
                .applyInArrow(run, schema))

    def search(self, visits: DataFrame, k: int, exclude: str | None, grouped: bool = False) -> DataFrame:
        m, carry = self.m, self.carry
        schema = _schema(self.rows, carry, _PAIR)
        target = to_arrow_schema(schema)

        def best(left, right):
            if left.num_rows == 0 or right.num_rows == 0:
                return target.empty_table()
            q_ix, t_ix = vector(left["ix"]), vector(right["ix"])
            theta = None
            if grouped:
                theta = vector(left["theta"]).astype(float)
                theta = np.where(np.isnan(theta), np.inf, theta)
            a, b, d = _nearest(m, m.prepare(block(left["x"])), _keys(left, exclude), m.prepare(block(right["x"])), t_ix,
                               _keys(right, exclude), k, theta)
            return pa.Table.from_arrays([pa.array(q_ix[a]), pa.array(t_ix[b]), pa.array(d),
                                         *[right[c].combine_chunks().take(pa.array(b)) for c in carry]],
                                        schema=target)

        return self.pairs(visits, best, schema, grouped)


# --- local regression ---------------------------------------------------------------------

def local_predict(queries: DataFrame, train: DataFrame, method: str = "knn", k: int = 5, power: float = 1.0,
                  alpha: float = 1.0, radius: float = 1.0, bandwidth: float = 1.0, distance: str = "euclidean",
                  p: float = 3.0, width: int | None = None, responses: int | None = None,
                  exclude: str | None = None, strategy: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """(ix, yhat) by knn, idw, adaptive, radius or kernel averaging of the training responses.

    ``exclude='ix'`` predicts each training row without itself, ``'fold'`` without its fold. ``near``: the
    ``shared_neighbors`` of these rows, of as many or more neighbours; knn and idw then need no join of their own.
    """
    if width is None or responses is None:
        first = train.select(F.size("x").alias("p"), F.size("y").alias("q")).first()
        width, responses = first["p"], first["q"]
    shared = near if method in ("knn", "idw") else None
    m = metric(train, distance, p, width) if shared is None else None
    near = lambda kk: knn_join(queries, train, kk, m, width, ["y"], exclude, strategy) if shared is None else shared.filter(F.col("rank") <= kk)
    pick = lambda i: F.get("y", F.lit(i))
    power, alpha = max(power, 1e-12), max(alpha, 1e-12)
    radius, bandwidth = max(radius, 1e-12), max(bandwidth, 1e-12)
    if method in ("knn", "idw"):
        weight = F.lit(1.0) if method == "knn" else 1 / F.pow(F.greatest("d", F.lit(1e-12)), F.lit(power))
        pairs = near(max(1, k)).withColumn("_w", weight)
        agg = pairs.groupBy(F.col("q_ix").alias("ix")).agg(
            F.sum("_w").alias("_sw"), *[F.sum(F.col("_w") * pick(i)).alias(f"_s{i}") for i in range(responses)],
            *[F.avg(pick(i)).alias(f"_a{i}") for i in range(responses)])
        return agg.select("ix", F.array(*[F.when(F.col("_sw") > 0, F.col(f"_s{i}") / F.col("_sw"))
                                          .otherwise(F.col(f"_a{i}")) for i in range(responses)]).alias("yhat"))
    asked = queries.select("ix", "x", *([exclude] if exclude and exclude != "ix" else []))
    if method == "kernel":
        sums = range_sums(asked, train, "kernel", m, width, responses, bandwidth, exclude, strategy)
    else:
        # the nearest row decides the adaptive threshold and is the radius fallback; several steps read it
        nearest = durable(near(1).select(F.col("q_ix").alias("ix"), F.col("d").alias("_d1"), F.col("y").alias("_y1")))
        asked = asked.join(nearest, "ix", "left")
        if method == "adaptive":
            top = 1 / (1 + F.col("_d1"))
            limits = [((10 - i) * 0.1) ** alpha for i in range(1, 11)]
            first = F.coalesce(*[F.when(top > v, F.lit(v)) for v in limits], F.lit(-1.0))
            kind, asked = "similarity", asked.withColumn("par", first)
        elif method == "radius":
            kind, asked = "radius", asked.withColumn("par", F.lit(float(radius)))
        else:
            raise ValueError(f"unknown local method {method}")
        sums = range_sums(asked, train, kind, m, width, responses, 1.0, exclude, strategy)
    joined = asked.join(sums, asked["ix"] == sums["q_ix"], "left")
    if method == "kernel":
        # every weight underflowed: the mean of all training rows that count
        totals = [F.sum(pick(i)).alias(f"s{i}") for i in range(responses)] + [F.count("*").alias("n")]
        whole = train.agg(*totals).first()
        if exclude:
            own = train.groupBy(F.col(exclude).alias("_o")).agg(F.count("*").alias("_on"), *[
                F.sum(pick(i)).alias(f"_o{i}") for i in range(responses)])
            joined = joined.join(own, asked[exclude] == F.col("_o"), "left")
            left = F.greatest(F.lit(whole["n"]) - F.coalesce("_on", F.lit(0)), F.lit(1))
            spare = [(F.lit(whole[f"s{i}"]) - F.coalesce(f"_o{i}", F.lit(0.0))) / left for i in range(responses)]
        else:
            spare = [F.lit(whole[f"s{i}"] / max(whole["n"], 1)) for i in range(responses)]
    else:
        spare = [F.get("_y1", F.lit(i)) for i in range(responses)]
    return joined.select(asked["ix"].alias("ix"), F.array(*[
        F.when(F.col("sw") > 0, F.get("swy", F.lit(i)) / F.col("sw")).otherwise(spare[i])
        for i in range(responses)]).alias("yhat"))


def shared_neighbors(queries: DataFrame, train: DataFrame, k: int, width: int, exclude: str | None = None,
                     distance: str = "euclidean", p: float = 3.0, strategy: str | None = None) -> DataFrame:
    """The k nearest rows and their responses, written out for several calls of ``local_predict``."""
    return durable(knn_join(queries, train, k, metric(train, distance, p, width), width, ["y"], exclude, strategy))


def local_path(queries: DataFrame, train: DataFrame, method: str, values: list, width: int, responses: int,
               exclude: str | None = None, **hp) -> DataFrame:
    """Predictions of all candidates as one array (candidate-major).

    knn and idw candidates share one neighbour join; the other methods join once per candidate.
    """
    name = {"knn": "k", "idw": "power", "adaptive": "alpha", "radius": "radius", "kernel": "bandwidth"}[method]
    if method in ("knn", "idw"):
        m = metric(train, hp.get("distance", "euclidean"), hp.get("p", 3.0), width)
        top = int(max(values)) if method == "knn" else int(hp.get("k", 5))
        pairs = knn_join(queries, train, max(1, top), m, width, ["y"], exclude, hp.get("strategy"))
        out = []
        for v in values:
            w = (F.col("rank") <= int(v)).cast("double") if method == "knn" else \
                1 / F.pow(F.greatest("d", F.lit(1e-12)), F.lit(float(v)))
            out += [(F.sum(w * F.get("y", F.lit(i))) / F.sum(w)) for i in range(responses)]
        agg = pairs.groupBy(F.col("q_ix").alias("ix")).agg(*[e.alias(f"_c{i}") for i, e in enumerate(out)])
        return agg.select("ix", F.array(*[F.col(f"_c{i}") for i in range(len(out))]).alias("yhat"))
    out = None
    for i, v in enumerate(values):
        part = local_predict(queries, train, method, width=width, responses=responses, exclude=exclude, **{**hp, name: v})
        part = part.select("ix", F.col("yhat").alias(f"_c{i}"))
        out = part if out is None else out.join(part, "ix")
    return out.select("ix", F.concat(*[F.col(f"_c{i}") for i in range(len(values))]).alias("yhat"))


# --- classification and outliers ----------------------------------------------------------

def knn_classify(queries: DataFrame, train: DataFrame, label: str, k: int = 5, distance: str = "euclidean",
                 weights: str = "uniform", p: float = 3.0, width: int | None = None,
                 exclude: str | None = None, strategy: str | None = None) -> DataFrame:
    """(ix, pred, proba map): weighted vote of the k nearest; ties go to the first label."""
    if width is None:
        width = train.select(F.size("x").alias("p")).first()["p"]
    m = metric(train, distance, p, width, raw_zero=True)
    named = train.withColumn("_label", F.col(label).cast("string"))
    pairs = knn_join(queries, named, k, m, width, ["_label"], exclude, strategy)
    if weights == "distance":
        # an exact hit takes the whole vote
        hit = F.max((F.col("d") == 0).cast("int")).over(W.partitionBy("q_ix"))
        weight = F.when(hit == 1, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))
        pairs = pairs.withColumn("_w", weight)
    else:
        pairs = pairs.withColumn("_w", F.lit(1.0))
    votes = pairs.groupBy("q_ix", "_label").agg(F.sum("_w").alias("_v"))
    return (votes.groupBy(F.col("q_ix").alias("ix"))
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("_v")).alias("v"), "_label"))).alias("_s"))
            .select("ix", F.get("_s", F.lit(0))["_label"].alias("pred"),
                    F.transform("_s", lambda s: F.struct(
                        s["_label"].alias("label"),
                        (-s["v"] / F.aggregate("_s", F.lit(0.0), lambda a, b: a - b["v"])).alias("p"))).alias("proba")))


def _salted_join(many: DataFrame, one: DataFrame, left: str, right: str, salts: int = 16) -> DataFrame:
    """Join rows that point at a few popular keys: the pointing side is salted, the other copied."""
    many = many.withColumn("_salt", F.pmod(F.xxhash64("q_ix"), F.lit(salts)))
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return many.join(one, (F.col(left) == F.col(right)) & (many["_salt"] == one["_salt"])) \
        .drop(many["_salt"]).drop(one["_salt"])


def lof_fit(train: DataFrame, k: int = 20, distance: str = "euclidean", width: int | None = None,
            strategy: str | None = None) -> DataFrame:
    """(ix, kdist, lrd, lof) of the training rows, each without itself."""
    if width is None:
        width = train.select(F.size("x").alias("p")).first()["p"]
    m = metric(train, distance, width=width)
    pairs = knn_join(train, train, k, m, width, exclude="ix", strategy=strategy).persist()
    kdist = pairs.groupBy(F.col("q_ix").alias("_k_ix")).agg(F.max("d").alias("kdist"))
    reach = _salted_join(pairs, kdist, "t_ix", "_k_ix")
    lrd = reach.groupBy("q_ix").agg((1 / (F.avg(F.greatest("d", "kdist")) + 1e-10)).alias("lrd"))
    near = _salted_join(pairs, lrd.select(F.col("q_ix").alias("_n_ix"), F.col("lrd").alias("_n_lrd")), "t_ix", "_n_ix")
    ratio = near.groupBy("q_ix").agg(F.avg("_n_lrd").alias("_mean"))
    return (lrd.join(ratio, "q_ix").join(kdist, F.col("q_ix") == F.col("_k_ix"))
            .select(F.col("q_ix").alias("ix"), "kdist", "lrd", (F.col("_mean") / F.col("lrd")).alias("lof")))


def lof_score(queries: DataFrame, train: DataFrame, fitted: DataFrame, k: int = 20,
              distance: str = "euclidean", width: int | None = None, strategy: str | None = None) -> DataFrame:
    """(ix, lof) of new rows against fitted training densities."""
    if width is None:
        width = train.select(F.size("x").alias("p")).first()["p"]
    m = metric(train, distance, width=width)
    known = train.select("ix", "x").join(fitted.select("ix", "kdist", "lrd"), "ix")
    pairs = knn_join(queries, known, k, m, width, ["kdist", "lrd"], strategy=strategy)
    agg = pairs.groupBy(F.col("q_ix").alias("ix")).agg(
        (1 / (F.avg(F.greatest("d", "kdist")) + 1e-10)).alias("_own"), F.avg("lrd").alias("_near"))
    return agg.select("ix", (F.col("_near") / F.col("_own")).alias("lof"))


def lof_offset(fitted: DataFrame, contamination: float) -> float:
    """The training quantile of -lof below which a row is an outlier."""
    found = exact_quantiles(fitted.select(F.lit(0).alias("pos"), (-F.col("lof")).alias("value")), [contamination])
    return found[(0,)][0]


def local_regression(ds: Dataset, **hp) -> DataFrame:
    """Predictions of all rows from the calibration rows, out of sample for the latter."""
    cal = local_predict(ds.cal, ds.cal, exclude="ix", width=ds.width, **hp)
    if not ds.has("split"):
        return cal
    return cal.unionByName(local_predict(ds.val, ds.cal, width=ds.width, **hp))

