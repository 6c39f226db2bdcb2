"""Leave-one-out predictions of whole blocks equal a refit without each row."""

import numpy as np
import pytest
from helpers import samples

from spectrafold.operators import latent, linear
from spectrafold.operators.folds import CV
from spectrafold.operators.moments import _of_block


def refits(kind, x, y, counts, **hp):
    out = []
    for i in range(len(x)):
        others = np.arange(len(x)) != i
        m = _of_block(np.hstack([x[others], y[others]]), None, x.shape[1])
        out.append(np.concatenate([x[i] @ f.coef + f.intercept for f in linear.path(kind, m, counts, **hp)]))
    return np.array(out)


def planted(n, p, q, rank, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, p)) + 5
    return x, x @ rng.normal(size=(p, q)) + rng.normal(size=(n, q)) * 0.3


@pytest.mark.parametrize("p, q, rank, n", [(7, 1, 7, 25), (7, 2, 7, 25), (12, 3, 12, 9), (1, 1, 1, 10)])
@pytest.mark.parametrize("scale", [False, True])
def test_pls_without_each_row(p, q, rank, n, scale):
    x, y = planted(n, p, q, rank, p + q)
    counts = [3, 1, 2, 5]
    m = _of_block(np.hstack([x, y]), None, p)
    got = linear._left_out_pls(m, counts, scale)({"x": x, "y": y})["yhat"]
    assert np.allclose(got, refits("pls", x, y, counts, scale=scale), atol=1e-6)


@pytest.mark.parametrize("p, q, n", [(6, 1, 20), (6, 2, 20), (12, 2, 8), (1, 1, 10)])
def test_pcr_without_each_row(p, q, n):
    x, y = planted(n, p, q, p, 3 * p + q)
    counts = [1, 4, 2]
    m = _of_block(np.hstack([x, y]), None, p)
    assert np.allclose(linear._left_out_pcr(m, counts)({"x": x, "y": y})["yhat"], refits("pcr", x, y, counts), atol=1e-6)


def test_pls_ends_when_nothing_is_left():
    """Components past the exact rank leave the prediction as it is."""
    x, _ = planted(15, 4, 1, 1, 2)
    y = 2 * x[:, :1] + 1
    m = _of_block(np.hstack([x, y]), None, 4)
    got = linear._left_out_pls(m, [1, 3], False)({"x": x, "y": y})["yhat"]
    assert np.allclose(got, y, atol=1e-7)


def test_constant_columns_and_responses():
    x, y = planted(12, 4, 2, 4, 9)
    x[:, 1], y[:, 1] = 3.0, 0.0
    m = _of_block(np.hstack([x, y]), None, 4)
    for scale in (False, True):
        got = linear._left_out_pls(m, [2], scale)({"x": x, "y": y})["yhat"]
        assert np.allclose(got, refits("pls", x, y, [2], scale=scale), atol=1e-6) and np.allclose(got[:, 1], 0)


def test_pieces_change_nothing(monkeypatch):
    x, y = planted(23, 5, 2, 5, 4)
    m = _of_block(np.hstack([x, y]), None, 5)
    whole = [run({"x": x, "y": y})["yhat"] for run in (linear._left_out_pls(m, [3], True), linear._left_out_pcr(m, [3]))]
    monkeypatch.setattr(linear, "pieces", lambda rows, numbers: [slice(a, a + 4) for a in range(0, rows, 4)])
    cut = [run({"x": x, "y": y})["yhat"] for run in (linear._left_out_pls(m, [3], True), linear._left_out_pcr(m, [3]))]
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(whole, cut))


@pytest.mark.parametrize("kind", ["pls", "pcr"])
def test_cross_predict_on_spark(spark, kind):
    x, y = planted(30, 5, 1, 5, 6)
    ds = samples(spark, x, y[:, 0])
    rows = linear.cross_predict(ds.df, kind, [1, 3], CV("loocv"), 5).collect()
    got = np.array([r["yhat"] for r in sorted(rows, key=lambda r: r["ix"])])
    assert np.allclose(got, refits(kind, x, y, [1, 3]), atol=1e-8)


def test_pca_scores_without_each_row(spark):
    x = np.random.default_rng(3).normal(size=(20, 4)) * [4, 3, 2, 1]
    ds = samples(spark, x, x[:, 0])
    scored, curve, _ = latent.pca_cv(ds, 3, CV("loocv"))
    left, want = np.zeros(3), {}
    for i in range(20):
        model = latent.fit_moments(_of_block(x[np.arange(20) != i], None, 4), 3)
        z = x[i] - model.mean
        want[i] = z @ model.loadings
        left += [((z - model.loadings[:, :a] @ want[i][:a]) ** 2).sum() for a in (1, 2, 3)]
    assert all(np.allclose(r["scores"], want[r["ix"]], atol=1e-8) for r in scored.collect())
    got = [r["rmse_cv"] for r in curve.orderBy("component").collect()]
    assert np.allclose(got, np.sqrt(left / 80), atol=1e-9)
