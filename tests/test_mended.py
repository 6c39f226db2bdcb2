"""Faults that were found and mended: each test failed or never ended before."""

import numpy as np
import pytest
from helpers import samples
from pyspark.sql import functions as F

from spectrafold.operators import ensemble, latent, parafac, splits, stats
from spectrafold.operators.folds import CV


def test_weighted_parafac_with_constraints(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.random((20, 2)), rng.random((8, 2)), rng.random((7, 2))
    x = np.einsum("ir,jr,kr->ijk", a, b, c)
    x[rng.random(x.shape) < 0.3] = np.nan
    rules = {1: {"non_negative": 1.0}, 2: {"non_negative": 1.0}}
    model = parafac.parafac(samples(spark, x, shape=(8, 7)), 2, rules, missing="weighted", max_iter=300)
    for truth, found in zip((b, c), model.factors):
        close = np.abs((truth / np.linalg.norm(truth, axis=0)).T @ (found / np.linalg.norm(found, axis=0)))
        assert close.max(axis=1).min() > 0.9999


@pytest.mark.parametrize("extra", [[np.inf], [-np.inf, np.inf], [1.7e308, -1.7e308], [5e-324, 0.0]])
def test_quantiles_end(spark, monkeypatch, extra):
    monkeypatch.setattr(stats, "_SMALL_GROUP", 10)
    values = [float(v) for v in range(40)] + extra
    long = spark.createDataFrame([(0, v) for v in values], "pos int, value double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = stats.exact_quantiles(long, probs)[(0,)]
    ranked = sorted(values)
    for p, q in zip(probs, got):
        h = (len(ranked) - 1) * p
        low, high = ranked[int(np.floor(h))], ranked[int(np.ceil(h))]
        assert q == pytest.approx(low if low == high else low + (high - low) * (h - np.floor(h)))


def test_stacking_refuses_missing_rows(spark):
    one = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "ix long, f array<double>")
    with pytest.raises(ValueError):
        ensemble.stack_features([one, one.filter("ix < 5")])
    target = spark.createDataFrame([(i, [1.0]) for i in range(5)], "ix long, y array<double>")
    with pytest.raises(ValueError):
        ensemble.fit_stack(ensemble.stack_features([one, one]), target)


def test_kennard_stone_refuses_gaps(spark):
    rows = [(i, [float(i), float("nan") if i < 4 else 1.0]) for i in range(6)]
    with pytest.raises(ValueError):
        splits.kennard_stone(spark.createDataFrame(rows, "ix long, x array<double>"), {"": 4})


@pytest.mark.parametrize("cv", [CV("kfold", 3), CV("loocv")])
def test_pca_curve_ends_at_the_rank(spark, cv):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 3))
    _, curve, _ = latent.pca_cv(samples(spark, x), 6, cv)
    found = [r["rmse_cv"] for r in curve.orderBy("component").collect()]
    assert len(found) == 3 and found[-1] < 1e-6 and found == sorted(found, reverse=True)


def test_streams_of_tables_in_one_file_and_in_several(spark, tmp_path):
    from spectrafold.plans import QUERIES

    rows = [(i, [float((i * j) % 7) + 0.1 * j for j in range(64)], i % 3) for i in range(12)]
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "many" / "embeddings.parquet"))
    one = tmp_path / "one"
    one.mkdir()
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("part-*.parquet")).rename(one / "embeddings.parquet")
    for name, count in (("saved_model_scores", 12), ("stream_scores", 12 * 64)):
        found = [sorted(map(tuple, QUERIES[name](spark, str(folder)).collect())) for folder in (tmp_path / "many", one)]
        assert found[0] == found[1] and len(found[0]) == count


@pytest.mark.parametrize("name,p,raw", [("euclidean", 3.0, False), ("chord", 3.0, True), ("manhattan", 3.0, False), ("chebyshev", 3.0, False),
                                        ("minkowski", 3.0, False), ("minkowski", 2.5, False), ("minkowski", 0.5, False)])
def test_nearest_of_many_tiles_equals_plain_differences(monkeypatch, name, p, raw):
    from spectrafold.operators import neighbors
    monkeypatch.setattr(neighbors, "_TILE", 32)
    monkeypatch.setattr(neighbors, "_TILE_32", 32)
    rng = np.random.default_rng(31)
    for offset, size in ((0.0, 1.0), (1e3, 1e-4), (0.0, 1e-9), (0.0, 1e30)):   # also what single precision cannot tell apart
        x = offset + size * np.vstack([rng.normal(size=(220, 20)), np.repeat(rng.normal(size=(1, 20)), 60, axis=0)])
        x[7] = x[9] = 0
        m = neighbors.Metric(name, p, None, raw)
        z, ix = m.prepare(x), np.arange(len(x))[::-1]
        d = m.direct(z, z)
        np.fill_diagonal(d, np.inf)
        order = np.lexsort((np.broadcast_to(ix, d.shape), d), axis=1)[:, :5]
        best = np.take_along_axis(d, order, axis=1)
        for theta in (None, best[:, -1]):
            q, t, found = neighbors._nearest(m, z, ix, z, ix, ix, 5, theta)
            assert (q.reshape(-1, 5) == np.arange(len(x))[:, None]).all() and (t.reshape(-1, 5) == order).all()
            assert (found.reshape(-1, 5) == best).all()


@pytest.mark.parametrize("kind,par", [("radius", 4.0), ("similarity", 0.2), ("kernel", 1.0)])
def test_range_sums_equal_plain_differences(monkeypatch, kind, par):
    from spectrafold.operators import neighbors
    monkeypatch.setattr(neighbors, "_TILE", 32)
    rng = np.random.default_rng(32)
    x = np.vstack([np.round(rng.normal(size=(150, 12))), np.zeros((20, 12))])   # distances that meet the limit exactly
    y, ix, m = rng.normal(size=(len(x), 2)), np.arange(len(x)), neighbors.Metric()
    d = m.direct(x, x)
    w = {"radius": d <= par, "similarity": 1 / (1 + d) > par, "kernel": np.exp(-0.5 * d ** 2)}[kind].astype(float)
    np.fill_diagonal(w, 0)
    sw, swy = neighbors._weighted(m, kind, x, ix, np.full(len(x), par), x, ix, y, 1.0)
    assert np.allclose(sw, w.sum(1), atol=1e-12) and np.allclose(swy, w @ y, atol=1e-12)


def test_rows_visit_groups_of_rings_and_not_each_ring(spark, monkeypatch):
    from spectrafold.operators import neighbors
    monkeypatch.setattr(neighbors, "RING_ROWS", 16)
    df = samples(spark, np.random.default_rng(33).normal(size=(1024, 20))).df.withColumn("theta", F.lit(None).cast("double")).persist()
    rings = neighbors.Rings(df, neighbors.Metric(), 20, 1024, [])
    assert rings.visits(df).count() <= 9 * 1024   # each of some 64 rings before


def test_members_and_candidates_share_one_neighbour_join(spark, tmp_path, monkeypatch):
    from spectrafold.operators import neighbors
    from spectrafold.plans import QUERIES
    x = np.random.default_rng(34).normal(size=(40, 64))
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    joins, plain = [], neighbors.knn_join
    monkeypatch.setattr(neighbors, "knn_join", lambda *a, **hp: joins.append(a[2]) or plain(*a, **hp))
    for name in ("ensemble_mean", "sweep_neighbours"):
        joins.clear()
        assert QUERIES[name](spark, str(tmp_path)).count() in (40, 3)
        assert joins == [9]   # three before
