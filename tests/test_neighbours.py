"""Kernels of the neighbour joins against plain differences, and how many pairs they measure in full."""

import numpy as np
import pytest

from spectrafold.operators import neighbors
from spectrafold.operators.neighbors import Metric

KINDS = [Metric("euclidean"), Metric("manhattan"), Metric("chebyshev"), Metric("minkowski", 3.0), Metric("minkowski", 2.5),
         Metric("minkowski", 1.5), Metric("minkowski", 0.5), Metric("chord", raw_zero=True)]


def rows(kind, n, p, rng):
    x = rng.normal(size=(n, p))
    if kind == "units":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "outliers":
        x[::17] *= 1e3
        x[1] = 1e9
    if kind == "lumps":
        x = rng.integers(0, 4, (n, 1)) * 50 + x * 1e-3
    if kind == "ties":
        x = np.round(x)
    if kind == "gaps":
        x[::9, 0] = np.nan
        x[4] = np.inf
    if kind == "same":
        x[:] = 1.5
    return x


def brute(m, q, q_not, t, t_not, k):
    out = []
    with np.errstate(invalid="ignore"):
        d = m.direct(q, t)
    for i in range(len(q)):
        near = [(d[i, j], j) for j in range(len(t)) if np.isfinite(d[i, j]) and q_not[i] != t_not[j]]
        out += [(i, j, v) for v, j in sorted(near)[:k]]
    return out


@pytest.mark.parametrize("kind", ["units", "outliers", "lumps", "ties", "gaps", "same"])
@pytest.mark.parametrize("m", KINDS, ids=lambda m: f"{m.name}{m.p if m.name == 'minkowski' else ''}")
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_nearest_of_many_tiles(monkeypatch, m, kind):
    monkeypatch.setattr(neighbors, "_TILE", 64)
    monkeypatch.setattr(neighbors, "_TILE_32", 16)
    rng = np.random.default_rng(3)
    q, t = m.prepare(rows(kind, 70, 24, rng)), m.prepare(rows(kind, 401, 24, rng))
    t[5] = q[3]
    ix = np.arange(len(t))
    for k in (1, 6, 30):
        want = brute(m, q, np.arange(len(q)), t, ix, k)
        far = np.full(len(q), np.inf)
        for i, _, v in want:
            far[i] = v if np.isinf(far[i]) else max(far[i], v)
        for theta in (None, far * 1.2 if m.bounded else None):
            a, b, d = neighbors._nearest(m, q, np.arange(len(q)), t, ix, ix, k, theta)
            assert list(zip(a, b)) == [(i, j) for i, j, _ in want] and np.allclose(d, [v for _, _, v in want], rtol=1e-12)


@pytest.mark.parametrize("name", ["manhattan", "chebyshev", "minkowski"])
def test_few_pairs_are_measured_variable_by_variable(monkeypatch, name):
    """Rows of random directions: the dense sums of all variables took every tile before."""
    rng = np.random.default_rng(4)
    q, t = rows("units", 64, 64, rng), rows("units", 20_000, 64, rng)
    measured, single = [], []
    sums, each = neighbors._Rough._sums, neighbors._Rough._each
    monkeypatch.setattr(neighbors._Rough, "_sums", lambda s, a, to, b, end, *x: measured.append((to - a) * (end - b)) or sums(s, a, to, b, end, *x))
    monkeypatch.setattr(neighbors._Rough, "_each", lambda s, i, at: single.append(len(i)) or each(s, i, at))
    m, ix = Metric(name), np.arange(len(t))
    a, b, _ = neighbors._nearest(m, q, None, t, ix, None, 5)
    assert [(i, j) for i, j, _ in brute(m, q, np.full(64, -1), t, ix, 5)] == list(zip(a, b))
    assert sum(measured) <= 64 * neighbors._TILE_32 and 0 < sum(single) < 0.1 * 64 * len(t)


@pytest.mark.parametrize("kind", ["units", "outliers", "ties", "gaps", "same"])
@pytest.mark.parametrize("how", ["radius", "similarity"])
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_range_sums_of_many_tiles(monkeypatch, how, kind):
    monkeypatch.setattr(neighbors, "_TILE", 64)
    rng = np.random.default_rng(5)
    q, t, y = rows(kind, 50, 12, rng), rows(kind, 300, 12, rng), rng.normal(size=(300, 2))
    q[4], t[4] = 0, 1  # sums of infinite distances have no order
    t[7], m = q[2], Metric()
    d = m.direct(q, t)
    for share in (0.02, 0.5, 1.0):
        near = np.nanquantile(np.where(np.isfinite(d), d, np.nan), share)
        # limits that some pairs meet exactly
        limit = np.where(np.arange(50) % 2, near, np.where(np.isfinite(d[:, 8]), d[:, 8], near))
        limit[5] = np.inf
        par = limit if how == "radius" else 1 / (1 + limit)
        with np.errstate(invalid="ignore"):
            hit = neighbors._in_range(m, how, d, par[:, None]) & (np.arange(50)[:, None] != np.arange(300)[None, :])
        sw, swy = neighbors._weighted(m, how, q, np.arange(50), par, t, np.arange(300), y, 1.0)
        assert (sw == hit.sum(1)).all() and np.allclose(swy, hit.astype(float) @ y)


def test_ranges_use_single_precision(monkeypatch):
    """All keys were double before."""
    kinds = []
    keys = neighbors._Rough.keys
    monkeypatch.setattr(neighbors._Rough, "keys", lambda s, *a: kinds.append((out := keys(s, *a)).dtype) or out)
    rng = np.random.default_rng(6)
    q, t = rows("units", 40, 64, rng), rows("units", 3000, 64, rng)
    neighbors._weighted(Metric(), "radius", q, None, np.full(40, 1.2), t, None, np.ones((3000, 1)), 1.0)
    assert set(kinds) == {np.dtype(np.float32)}


@pytest.mark.parametrize("strategy", ["broadcast", "rings"])
def test_the_nearest_row_is_searched_once(spark, strategy):
    """Three steps read it, and each of them searched again before."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(v) for v in r], [float(i)]) for i, r in enumerate(rng.normal(size=(60, 3)))],
                               "ix long, x array<double>, y array<double>")
    done = neighbors.local_predict(df, df, "adaptive", alpha=0.5, width=3, responses=1, exclude="ix", strategy=strategy)
    plan = done._jdf.queryExecution().executedPlan().toString()
    searches = plan.count("search(") + plan.count("t_ix#")
    assert searches == 0 and done.count() == 60
