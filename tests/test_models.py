import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import samples, wide
from spectrafold import Dataset
from spectrafold.operators import (discriminant, ensemble, kernels, latent, linear, mcr, neighbors, novelty, npls, parafac,
                                   preprocess, trees)
from spectrafold.operators.calibration import Calibration, candidates
from spectrafold.operators.classification import Classifier
from spectrafold.operators.folds import CV
from spectrafold.operators.leastsq import constrained_rows, nnls_rows
from spectrafold.operators.moments import moments
from spectrafold.operators.stats import cosine_matrix

RNG = np.random.default_rng


def test_msc_restores_the_reference(spark):
    r = np.sin(np.linspace(0, 3, 20)) + 2
    a = RNG(0).uniform(0.5, 2, (12, 1))
    ds = samples(spark, a * r + RNG(1).normal(size=(12, 1)))
    assert np.allclose(wide(preprocess.msc(ds, reference=r).df, "x"), r)


def test_savgol_keeps_polynomials(spark):
    t = np.arange(15.0)
    x = np.stack([1 + t - 0.3 * t * t, 2 - t])
    for window, order in ((5, 2), (6, 2), (2, 2)):
        got = wide(preprocess.savgol(samples(spark, x), window, order).df, "x")
        assert np.allclose(got, x)


def test_tensor_moving_average_and_derivative(spark):
    x = RNG(2).normal(size=(6, 4, 5))
    ds = samples(spark, x, shape=(4, 5))
    d = preprocess.derivative(ds, 1, way=1)
    assert d.shape == (3, 5) and np.allclose(wide(d.df, "x").reshape(6, 3, 5), np.diff(x, axis=1))
    m = wide(preprocess.moving_average(ds, 3, way=2).df, "x").reshape(x.shape)
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1)), mode="edge")
    assert np.allclose(m, (padded[..., :-2] + padded[..., 1:-1] + padded[..., 2:]) / 3)


def test_ols_limits(spark):
    x = RNG(3).normal(size=(60, 5))
    y = x @ RNG(4).normal(size=(5, 2)) + RNG(5).normal(size=(60, 2)) * 0.1
    m = moments(samples(spark, x, y).df, "x", "y", width=5)[""]
    beta = np.linalg.lstsq(x - x.mean(0), y - y.mean(0), rcond=None)[0]
    assert np.allclose(linear.ols(m).coef, beta)
    assert np.allclose(linear.ridge(m, 1e-10).coef, beta)
    assert np.allclose(linear.path("pls", m, [5])[0].coef, beta)
    assert np.allclose(linear.path("pcr", m, [5])[0].coef, beta)
    assert np.allclose(linear.elastic_net(m, 1e-12).coef, beta, atol=1e-6)
    with pytest.raises(ValueError):
        linear.ols(moments(samples(spark, x[:4], y[:4]).df, "x", "y", width=5)[""])


def test_lasso_meets_its_optimality_conditions(spark):
    x = RNG(6).normal(size=(80, 6))
    y = x[:, :2] @ np.array([1.0, -2.0]) + RNG(7).normal(size=80) * 0.1
    m = moments(samples(spark, x, y).df, "x", "y", width=6)[""]
    fit = linear.elastic_net(m, 0.1)
    grad = ((m.xy - m.xx @ fit.coef) / m.n)[:, 0]
    on = fit.coef[:, 0] != 0
    assert np.allclose(grad[on], 0.1 * np.sign(fit.coef[on, 0]), atol=1e-6) and np.all(np.abs(grad[~on]) <= 0.1 + 1e-6)


@pytest.mark.parametrize("cv", [CV("venetian_blinds", 4), CV("kfold", 4), CV("loocv"), CV("timeseries", 4),
                                CV("shuffle_split", 3), CV("bootstrap", 3), CV("repeated_kfold", 3, repeats=2)])
def test_cross_validation_equals_refitting(spark, cv):
    from spectrafold.operators.folds import assign, fold_table
    x = RNG(8).normal(size=(40, 4))
    y = x @ RNG(9).normal(size=4) + RNG(10).normal(size=40) * 0.2
    ds = samples(spark, x, y)
    got = {(r["fold"], r["ix"]): r["yhat"][0] for r in linear.cross_predict(ds.df, "ridge", [0.5], cv, 4).collect()}
    rows = fold_table(assign(ds.df, cv)).collect()
    want = {}
    for f in {r["fold"] for r in rows}:
        test = [r["ix"] for r in rows if r["fold"] == f and r["role"] == "test"]
        if cv.strategy == "loocv":
            train, w = [i for i in range(40) if i != f], np.ones(39)
        else:
            pick = [(r["ix"], r["weight"]) for r in rows if r["fold"] == f and r["role"] == "train"]
            train, w = [p[0] for p in pick], np.array([p[1] for p in pick])
        mx, my = w @ x[train] / w.sum(), w @ y[train] / w.sum()
        z = x[train] - mx
        beta = np.linalg.solve(z.T @ (z * w[:, None]) + 0.5 * np.eye(4), z.T @ (w * (y[train] - my)))
        want.update({(f, i): my + (x[i] - mx) @ beta for i in test})
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_tuning_finds_the_planted_rank(spark):
    t = RNG(11).normal(size=(60, 2))
    x = t @ RNG(12).normal(size=(2, 15)) + RNG(13).normal(size=(60, 15)) * 1e-3
    y = t @ np.array([1.0, 2.0]) + RNG(14).normal(size=60) * 1e-4
    split = ["cal" if i % 3 else "val" for i in range(60)]
    done = Calibration("pls").tune(samples(spark, x, y, split=split), "5", CV("venetian_blinds", 5))
    curve = {r["candidate"]: r["rmse"] for r in done.curve.collect()}
    assert len(curve) == 5 and curve[2.0] < 0.05 * curve[1.0] and done.best >= 2
    assert done.val_curve.count() == 5


def test_candidates():
    assert candidates("pls", "4", 100, 50) == [1, 2, 3, 4]
    assert candidates("ridge", "1,0.1,1", 100, 50) == [0.1, 1.0]
    assert candidates("local", None, 10, 3) == list(range(1, 10))


def test_full_rank_reconstruction_and_projection(spark):
    x = RNG(15).normal(size=(30, 6))
    ds = samples(spark, x)
    model = latent.pca(ds, 6)
    assert max(r["q"] for r in model.transform(ds.df).collect()) < 1e-20
    scored = model.leverage(model.transform(ds.df))
    assert abs(sum(r["leverage"] for r in scored.collect()) - 6) < 1e-9


def test_pca_cv_equals_refitting(spark):
    x = RNG(16).normal(size=(30, 5)) * np.array([5, 3, 1, 1, 1])
    _, curve, loads = latent.pca_cv(samples(spark, x), 2, CV("venetian_blinds", 5))
    left = np.zeros((30, 2))
    for f in range(5):
        tr, te = np.arange(30) % 5 != f, np.arange(30) % 5 == f
        mu = x[tr].mean(0)
        v = np.linalg.svd(x[tr] - mu)[2]
        for a in (1, 2):
            z = x[te] - mu
            left[te, a - 1] = ((z - z @ v[:a].T @ v[:a]) ** 2).sum(1)
    got = [r["rmse_cv"] for r in curve.orderBy("component").collect()]
    assert np.allclose(got, np.sqrt(left.mean(0) / 5)) and loads.count() == 5 * 2 * 5


@pytest.fixture(scope="module")
def blobs(spark):
    x = np.vstack([RNG(17).normal(size=(60, 4)) + 4 * k * np.eye(4)[k] for k in range(3)])
    ds = samples(spark, x, label=np.repeat(["a", "b", "c"], 60))
    return ds.with_df(ds.df.persist())


@pytest.mark.parametrize("method,hp", [
    ("lda", {}), ("lda", {"solver": "lsqr", "shrinkage": "auto"}), ("qda", {"reg": 0.1}), ("pls_da", {"components": 3}),
    ("logistic", {"balanced": True}), ("random_forest", {"trees": 10, "depth": 5}), ("extra_trees", {"trees": 10, "depth": 6}),
    ("svc", {"kernel": "linear", "max_iter": 25}), ("knn", {"k": 5, "weights": "distance"})])
def test_classifiers_separate_blobs(blobs, method, hp):
    out = Classifier(method, **hp).fit(blobs, "label").predict(blobs.df)
    r = out.agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("a"),
                F.max(F.abs(F.aggregate("proba", F.lit(0.0), lambda s, v: s + v) - 1)).alias("p")).first()
    assert r["a"] > 0.8 and r["p"] < 1e-6


def test_discriminant_cv_covers_every_row(blobs):
    held = discriminant.discriminant_cv(blobs, "label", "lda", CV("kfold", 5))
    assert held.select("ix").distinct().count() == 180 == held.count()


@pytest.mark.parametrize("method,hp", [
    ("simca", {"components": 2}), ("simca", {"rule": "combined", "combine": "l2", "scale": True}), ("dd_simca", {}),
    ("dd_simca", {"limits": "robust"}), ("isolation_forest", {"trees": 40}), ("elliptic_envelope", {}),
    ("lof", {"k": 10}), ("one_class_svm", {"nu": 0.1, "gamma": 0.05, "size": 200})])
def test_one_class_models_reject_outliers(spark, method, hp):
    x = np.vstack([RNG(18).normal(size=(120, 5)) * [2, 1, 1, .5, .5], RNG(19).normal(size=(20, 5)) + 12])
    ds = samples(spark, x)
    model = novelty.fit_novelty(ds.df.filter("ix < 120"), method, 5, **hp)
    out = novelty.probabilities(novelty.score_novelty(model, ds.df))
    r = {x["o"]: x for x in out.groupBy((F.col("ix") >= 120).alias("o")).agg(
        F.avg((F.col("inlier") == 1).cast("int")).alias("rate"), F.avg("p_reference").alias("p")).collect()}
    assert r[True]["rate"] == 0.0 and r[False]["rate"] > 0.75 and r[False]["p"] > r[True]["p"]


def test_envelope_judges_starts_on_all_rows(spark):
    """The thousand rows that are first by hash lie apart from the tight majority."""
    n, rng = 6000, RNG(31)
    first = {r["ix"] for r in spark.range(n).select(F.col("id").alias("ix")).orderBy(F.xxhash64("ix", F.lit(42))).limit(1000).collect()}
    loose = np.array([i in first for i in range(n)])
    loose[rng.choice(np.flatnonzero(~loose), int(0.49 * n) - 1000, replace=False)] = True
    x = np.where(loose[:, None], rng.normal(size=(n, 3)) + [10, 0, 0], 0.1 * rng.normal(size=(n, 3)))
    model = novelty.fit_novelty(samples(spark, x).df, "elliptic_envelope", 3)
    assert np.abs(model.center).max() < 0.05


def test_c_step_takes_the_nearest_rows(spark):
    x = np.round(RNG(32).normal(size=(700, 2)), 1)
    starts = [(np.zeros(2), np.eye(2)), (np.array([1.0, 0.5]), np.diag([2.0, 0.3]))]
    for (c, v), (center, cov) in zip(starts, novelty._c_step(samples(spark, x).df, 2, starts, 351, False, False)):
        d = np.einsum("ij,ij->i", (x - c) @ np.linalg.pinv(v, hermitian=True), x - c)
        near = x[d <= np.sort(d)[350] * (1 + 1e-12)]
        assert np.allclose(center, near.mean(0)) and np.allclose(cov, np.cov(near.T, bias=True))


def test_one_class_needs_five_rows(spark):
    with pytest.raises(ValueError):
        novelty.fit_novelty(samples(spark, RNG(20).normal(size=(4, 3))).df, "simca", 3)


def test_reference_class(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "ix long, label string")
    assert novelty.reference_class(df, "label") == "b" and novelty.reference_class(df, "label", 2) == "a"
    assert novelty.reference_class(df.withColumn("label", F.col("ix").cast("int")), "label", 2) == "2"


def test_novelty_cv_marks_reference_rows(spark):
    x = RNG(21).normal(size=(40, 4))
    ds = samples(spark, x)
    out = novelty.novelty_cv(ds.df, F.col("ix") < 30, "simca", 4, CV("venetian_blinds", 5), components=2)
    assert out.filter("out_of_fold").count() == 30 and out.count() == 40


@pytest.mark.parametrize("name,raw", [("euclidean", False), ("manhattan", False), ("chord", True), ("mahalanobis", False),
                                      ("minkowski", False)])
def test_rings_equal_brute_force(spark, monkeypatch, name, raw):
    monkeypatch.setattr(neighbors, "RING_ROWS", 64)
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 80)
    c = RNG(22).normal(size=(4, 3)) * 6
    x = np.vstack([c[RNG(23).integers(0, 4, 300)] + RNG(24).normal(size=(300, 3)),
                   np.repeat(c[:1], 150, axis=0), np.zeros((2, 3))])   # a third of the rows are one point
    df = samples(spark, x, np.arange(len(x)) % 7).df.persist()
    m = neighbors.metric(df, name, 3.0, 3, raw_zero=raw)
    z = m.prepare(x)
    d = m.direct(z, z)
    np.fill_diagonal(d, np.inf)
    got = neighbors.knn_join(df, df, 4, m, 3, ["y"], "ix", "rings").collect()
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), np.round(d, 9)), axis=1)[:, :4]
    assert len(got) == 4 * len(x)
    for r in got:
        assert abs(d[r["q_ix"], r["t_ix"]] - d[r["q_ix"], order[r["q_ix"], r["rank"] - 1]]) < 1e-9


def test_fold_exclusion_equals_refitting(spark):
    x, y = RNG(25).normal(size=(50, 3)), RNG(26).normal(size=50)
    df = samples(spark, x, y).df.withColumn("fold", F.col("ix") % 5)
    for method, hp in (("knn", {"k": 3}), ("kernel", {"bandwidth": 0.7}), ("radius", {"radius": 0.8})):
        got = wide(neighbors.local_predict(df, df, method, width=3, responses=1, exclude="fold", **hp), "yhat")[:, 0]
        for f in range(5):
            part = neighbors.local_predict(df.filter(F.col("fold") == f), df.filter(F.col("fold") != f), method, width=3,
                                           responses=1, **hp).collect()
            assert all(abs(got[r["ix"]] - r["yhat"][0]) < 1e-12 for r in part)


def test_kernel_regressors_learn(spark):
    x = RNG(27).uniform(-2, 2, size=(150, 2))
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1]
    ds = samples(spark, x, y)
    for kind, value, hp in (("svr", 10.0, {"epsilon": 0.02, "gamma": 0.5, "size": 100}),
                            ("gaussian_process", 1e-3, {"length_scale": 1.0, "size": 150}),
                            ("random_forest", 20, {"depth": 6}), ("gradient_boosting", 20, {})):
        out = wide(Calibration(kind, value, **hp).fit(Dataset(ds.df, (2,), y_names=("y",), scaled=True)).predict(ds.df), "yhat")
        assert np.sqrt(((out[:, 0] - y) ** 2).mean()) < 0.3 * y.std()


def test_minimise_reaches_the_bottom():
    a = np.diag([1.0, 10.0, 100.0])
    w = kernels.minimise(lambda v: (0.5 * v @ a @ v - v.sum(), a @ v - 1), np.zeros(3))
    assert np.allclose(w, [1, 0.1, 0.01], atol=1e-3)


def test_nnls_conditions():
    g = RNG(28).normal(size=(20, 4))
    gram, rhs = g.T @ g, RNG(29).normal(size=(100, 4)) * 5
    x = nnls_rows(gram, rhs)
    slope = x @ gram - rhs
    assert x.min() >= 0 and slope.min() > -1e-9 and np.abs(x * slope).max() < 1e-9


@pytest.mark.parametrize("r", [1, 4])
def test_rows_with_normal_equations_of_their_own(r):
    g = RNG(128).normal(size=(60, 9, r))
    grams, cross = g.transpose(0, 2, 1) @ g, RNG(129).normal(size=(60, r)) * 5
    grams[7], cross[8] = np.eye(r), -1.0
    x = constrained_rows(grams, cross, {"non_negative": 1.0}, cross)
    slope = np.einsum("jab,jb->ja", grams, x) - cross
    assert x.min() >= 0 and slope.min() > -1e-9 and np.abs(x * slope).max() < 1e-9
    assert np.allclose(x, np.vstack([nnls_rows(g, c[None, :]) for g, c in zip(grams, cross)]), atol=1e-9)
    assert not x[8].any() and np.allclose(x[7], np.maximum(cross[7], 0))
    grams[9] = 0.0  # a row without cells
    free = constrained_rows(grams, cross, {}, cross)
    assert np.allclose(free[:9], np.stack([np.linalg.solve(g, c) for g, c in zip(grams[:9], cross[:9])])) and not free[9].any()
    assert nnls_rows(grams[:0], cross[:0]).shape == (0, r)


def test_mcr_recovers_a_mixture(spark):
    t = np.linspace(0, 1, 25)
    s = np.stack([np.exp(-((t - .3) / .08) ** 2), np.exp(-((t - .7) / .1) ** 2)])
    c = np.abs(RNG(30).normal(size=(80, 2)))
    ds = samples(spark, c @ s, c)
    model = mcr.mcr_als(ds, 2, max_iter=60)
    assert np.abs(cosine_matrix(model.spectra, s)).max(1).min() > 0.99
    assert all(b <= a * (1 + 1e-9) for a, b in zip(model.history, model.history[1:]))
    lines = mcr.calibrate_scores(model.transform(ds.df), 2).collect()
    assert {r["response"] for r in lines} == {0, 1} and all(r["r2"] > 0.99 for r in lines)


def test_mcr_constraints():
    rules = mcr.Rules(zero_end_points=1, normalize=False)
    a = rules.apply(np.array([[1.0, 2, 5]]))
    assert a[0, 0] == 0 and a[0, -1] == 0
    assert np.allclose(mcr.Rules(normalize=True).apply(np.array([[1.0, 3]])).sum(), 1)
    assert mcr.Rules(cut_below=2.0).apply(np.array([[1.0, 3]])).tolist() == [[0, 3]]
    assert mcr.Rules(compress_above=2.0).apply(np.array([[1.0, 3]])).tolist() == [[1, 2]]
    assert mcr.Rules(replace_zeros=(1, 9.0)).apply(np.array([[0.0, 0], [1, 0]])).tolist() == [[0, 9], [1, 0]]


@pytest.fixture(scope="module")
def tensor():
    a, b, c = (np.abs(RNG(31 + i).normal(size=(n, 2))) for i, n in enumerate((24, 9, 8)))
    return a, b, c, np.einsum("ir,jr,kr->ijk", a, b, c)


@pytest.mark.parametrize("options", [{}, {"missing": "em"}, {"missing": "weighted"}, {"starts": 2, "init": "random"},
                                     {"constraints": {m: {"non_negative": 1} for m in range(3)}}])
def test_parafac_recovers_factors(spark, tensor, options):
    a, b, c, x = tensor
    x = x.reshape(24, -1).copy()
    if "missing" in options:
        x[RNG(40).random(x.shape) < 0.1] = np.nan
    model = parafac.parafac(samples(spark, x, shape=(9, 8)), 2, max_iter=60, **options)
    assert np.abs(cosine_matrix(model.factors[0].T, b.T)).max(1).min() > 0.99
    assert model.explained > 99.9 and model.core_consistency > 95
    assert model.history[-1] <= model.history[0]


def test_parafac_refits_per_sample(spark, tensor):
    *_, x = tensor
    ds = samples(spark, x, shape=(9, 8), split=["cal"] * 21 + ["val"] * 3)
    model = parafac.parafac(ds, 2, joint=False, max_iter=60)
    rows, similar = parafac.sample_refits(ds, model, max_iter=3)
    assert rows.count() == 3 and similar.min() > 0.99


def test_residual_bilinearisation_removes_an_interferent(spark, tensor):
    a, b, c, x = tensor
    y = a[:, 0] * 2 + 1
    ds = samples(spark, x, y, shape=(9, 8))
    model = npls.npls(ds, 2, "u_pls")
    assert np.allclose(wide(model.predict(ds.df), "yhat")[:, 0], y, atol=1e-6)
    other = x[:6] + np.einsum("i,j,k->ijk", np.ones(6) * 3, RNG(50).normal(size=9), RNG(51).normal(size=8))
    out = model.predict(samples(spark, other, y[:6], shape=(9, 8)).df, interferents=1)
    fixed, base = wide(out, "yhat")[:, 0], wide(out, "yhat_base")[:, 0]
    assert np.abs(fixed - y[:6]).max() < 0.1 * np.abs(base - y[:6]).max()
    figures = model.figures(out, ds.cal, interferents=1).collect()
    assert len(figures) == 6 and all(0 < r["lod_min"] <= r["lod_max"] for r in figures)


def test_npls_fits_trilinear_data(spark, tensor):
    a, *_, x = tensor
    ds = samples(spark, x, a @ [1.0, -2.0], shape=(9, 8))
    model = npls.npls(ds, 2)
    t = model.targets[0]
    assert t.y_percent.sum() > 99 and np.all(np.diff(np.cumsum(t.y_percent)) > -1e-9)


def test_ensembles_check_their_members(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "ix long, response int, yhat double")
    with pytest.raises(ValueError):
        ensemble.combine_regression([m, m.filter("ix = 0")])
    with pytest.raises(ValueError):
        ensemble.combine_regression([m, m.unionByName(m)])
    with pytest.raises(ValueError):
        ensemble.checked_weights([1, -1], 2)
    with pytest.raises(ValueError):
        ensemble.same_family(["simca", "lda"])


def test_votes_break_ties_by_member_and_label(spark):
    a = spark.createDataFrame([(0, "z")], "ix long, pred string")
    b = spark.createDataFrame([(0, "a")], "ix long, pred string")
    assert ensemble.hard_vote([a, b]).first()["pred"] == "z"
    p = spark.createDataFrame([(0, "z", 0.5), (0, "a", 0.5)], "ix long, label string, p double")
    votes = ensemble.soft_vote([p, p])
    assert votes.first()["pred"] == "a" and ensemble.tie_count(votes) == 1


@pytest.mark.parametrize("meta", ["linear", "ridge", "random_forest", "extra_trees", "bagging", "adaboost",
                                  "gradient_boosting", "hist_gradient_boosting"])
def test_stacking_regression(spark, meta):
    x = RNG(60).normal(size=(90, 2))
    y = x @ [1.0, 0.5]
    rows = samples(spark, x, y).df
    hp = {} if meta in ("linear", "ridge") else {"rounds": 5} if meta == "adaboost" else {"trees": 10, "depth": 5}
    stack = ensemble.fit_stack(rows.select("ix", "x"), rows.select("ix", "y"), meta, **hp)
    out = wide(stack.predict(rows.select("ix", "x")), "yhat")[:, 0]
    assert np.corrcoef(out, y)[0, 1] > 0.8


@pytest.mark.parametrize("meta,hp", [("logistic", {}), ("adaboost", {"rounds": 6, "depth": 2}), ("bagging", {"trees": 10, "depth": 4}),
                                     ("gradient_boosting", {"trees": 10})])
def test_stacking_classes(blobs, meta, hp):
    rows = blobs.df.select("ix", "x")
    stack = ensemble.fit_stack(rows, blobs.df.select("ix", "label"), meta, "classification", **hp)
    out = stack.predict(rows).join(blobs.df.select("ix", "label"), "ix")
    assert out.agg(F.avg((F.col("pred") == F.col("label")).cast("int"))).first()[0] > 0.8


def test_repeat_and_steps(spark):
    df = ensemble.repeat(lambda d: d.withColumn("v", F.col("v") * 2), spark.createDataFrame([(1,)], "v long"), 7, 3)
    assert df.first()["v"] == 128
    ds = samples(spark, np.ones((3, 4)))
    ensemble.register_step("halve", lambda d: d.with_x(F.transform("x", lambda v: v / 2)))
    assert wide(ensemble.run_step("halve", ds).df, "x").max() == 0.5


def test_extra_trees_regression(spark):
    x = RNG(70).uniform(size=(200, 3))
    y = (x[:, 0] > 0.5) * 2.0
    out = trees.extra_trees(samples(spark, x, y).df, 3, trees=10, depth=6).predict(samples(spark, x, y).df)
    assert np.corrcoef(wide(out, "yhat")[:, 0], y)[0, 1] > 0.9


@pytest.mark.parametrize("depth", [0, 60])
def test_extra_trees_grow_until_pure(spark, depth):
    x = np.arange(1500.0)[:, None]
    y = (np.arange(1500) % 2).astype(float)[:, None]
    df = samples(spark, x, y).df
    model = trees.extra_trees(df, 1, trees=10, depth=depth)
    assert np.allclose(model.leaf_means(x), y)


def test_trees_without_a_limit_are_grown_or_refused(spark):
    rng = np.random.default_rng(3)
    df = samples(spark, rng.normal(size=(1500, 4)), rng.normal(size=(1500, 1))).df
    grown = trees.tree_regressor(df, "random_forest", 1, 10, 0)
    assert max(t.depth for t in grown.models[0].trees) > 10
    # every cut takes the largest response off
    k = np.arange(48)
    chain = samples(spark, np.column_stack([np.minimum(k, 24), np.maximum(k, 24)]).astype(float), 4.0 ** k[:, None]).df
    for depth in (0, 45):
        with pytest.raises(ValueError, match="levels"):
            trees.tree_regressor(chain, "bagging", 1, 10, depth, bootstrap=False)
    assert trees.tree_regressor(chain, "bagging", 1, 10, 30, bootstrap=False).models[0].trees[0].depth == 30
    with pytest.raises(ValueError, match="bins"):
        trees.tree_regressor(df, "gradient_boosting", 1, 10, 2, max_bins=1000)

