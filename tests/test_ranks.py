"""Order statistics whatever the values: infinities, tiny and huge numbers, ties, missing ones."""

import numpy as np
import pytest

from helpers import samples
from spectrafold.operators import ranks, stats

RNG = np.random.default_rng


def columns():
    rng = RNG(0)
    n = 3000
    wild = np.sign(rng.normal(size=n)) * 10.0 ** rng.uniform(-300, 300, n)
    ties = rng.integers(-2, 3, n).astype(float)
    ends = np.where(rng.random(n) < 0.3, np.inf, np.where(rng.random(n) < 0.3, -np.inf, rng.normal(size=n)))
    close = 1.0 + rng.integers(0, 50, n) * np.finfo(float).eps
    holes = np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n))
    return np.column_stack([wild, ties, ends, close, holes, np.where(rng.random(n) < 0.5, 0.0, -0.0), np.full(n, np.nan)])


def test_image_sorts_as_doubles_do():
    v = np.sort(np.concatenate([columns()[:, 0], [np.inf, -np.inf, 5e-324, -5e-324, 0.0]]))
    img = ranks.image(v)
    assert (img[1:] >= img[:-1]).all() and [ranks.double(int(i)) for i in img] == v.tolist()


def test_every_rank_in_eight_scans(spark, monkeypatch):
    x = columns()
    df = samples(spark, x).df
    scans = []
    plain = ranks._digits
    monkeypatch.setattr(ranks, "_digits", lambda *a: scans.append(a[4]) or plain(*a))
    want = {j: np.sort(x[~np.isnan(x[:, j]), j]) for j in range(x.shape[1])}
    targets = {(j, r) for j, v in want.items() for r in {0, len(v) // 3, len(v) // 2, len(v) - 1} if len(v)}
    got = ranks.select(df, ["x"], lambda b: b["x"].T, targets)
    assert all(got[j, r] == want[j][r] for j, r in targets) and len(scans) <= 8
    # a separating number has as many values up to it as the ranks ask for
    apart = ranks.select(df, ["x"], lambda b: b["x"].T, {(0, 700), (4, 12)}, separate=True)
    assert (want[0] <= apart[0, 700]).sum() == 701 and (want[4] <= apart[4, 12]).sum() == 13
    assert ranks.select(df, ["x"], lambda b: b["x"].T, {(1, 10**9)})[1, 10**9] == want[1][-1]


@pytest.mark.parametrize("small", [0, 10**6])
def test_quantiles_by_either_route(spark, monkeypatch, small):
    monkeypatch.setattr(stats, "_SMALL_GROUP", small)
    x = columns()[:, [0, 1, 3, 4]]
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = np.array([np.nanquantile(x[:, j], probs) for j in range(4)]).T
    wide = stats.array_quantiles(samples(spark, x).df, probs)
    assert np.allclose(wide, want, rtol=1e-9)
    long = stats.exact_quantiles(stats.to_long(samples(spark, x).df, "x", ()), probs)
    assert np.allclose(np.array([long[(j,)] for j in range(4)]).T, want, rtol=1e-9)


def test_named_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(stats, "_SMALL_GROUP", 0)
    rows = [(g, i % 2, float(v)) for g in ("a", "b", None) for i, v in enumerate(RNG(3).normal(size=41))] + [("a", 0, None), ("c", 1, float("nan"))]
    got = stats.exact_quantiles(spark.createDataFrame(rows, "g string, k int, value double"), [0.3], ("g", "k"))
    assert got.keys() == {(g, k) for g in ("a", "b", None) for k in (0, 1)}
    for (g, k), (q,) in got.items():
        assert np.isclose(q, np.quantile([v for a, b, v in rows if a == g and b == k and v is not None], 0.3))
    assert stats.exact_quantiles(spark.createDataFrame([], "pos int, value double"), [0.5]) == {}
