import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import samples, wide
from spectrafold.functions import distributions as D
from spectrafold.functions.specs import number_list
from spectrafold.operators import folds, moments, ordering, splits, stats
from spectrafold.operators.folds import CV


def test_number_list():
    assert number_list("1,2,3-6,12:0.5:13") == [1, 2, 3, 4, 5, 6, 12, 12.5, 13]
    assert number_list("5:1") == [5, 4, 3, 2, 1]
    with pytest.raises(ValueError):
        number_list("1:0:5")


def test_quantiles_of_distributions():
    # tabulated values
    assert abs(D.chi2_quantile(0.95, 5) - 11.0705) < 1e-4
    assert abs(D.f_quantile(0.95, 3, 20) - 3.0984) < 1e-4
    assert abs(D.t_quantile(0.975, 10) - 2.2281) < 1e-4
    assert abs(D.f_quantile(0.95, 2, 30) - 3.3158) < 1e-4


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 100, 1001])
def test_permutation_is_a_bijection(n):
    at = ordering.shuffled_positions(np.arange(n), n, 42)
    assert sorted(at) == list(range(n))


def test_index_is_dense_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), "id").repartition(7)
    out, n = ordering.with_index(df, ["k", "id"])
    got = [(r["ix"], r["k"], r["id"]) for r in out.orderBy("ix").collect()]
    assert n == 3000 and [g[0] for g in got] == list(range(3000))
    assert [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_halo_windows_equal_plain_windows(spark):
    df = spark.range(500).select(F.col("id").alias("ix"), (F.col("id") * 37 % 101).alias("v"))
    blocks = ordering.halo_blocks(df, before=2, after=1, rows=20)
    w = ordering.block_window()
    out = ordering.own_rows(blocks.withColumn("s", F.lag("v", 2).over(w)).withColumn("t", F.lead("v").over(w)))
    rows = {r["ix"]: r for r in out.collect()}
    v = [i * 37 % 101 for i in range(500)]
    assert len(rows) == 500
    assert all(rows[i]["s"] == (v[i - 2] if i >= 2 else None) for i in range(500))
    assert all(rows[i]["t"] == (v[i + 1] if i < 499 else None) for i in range(500))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_moments_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(203, 12)) + 1e4
    ds = samples(spark, x, rng.normal(size=203), parts=parts)
    m = moments.moments(ds.df, "x", "y", width=12)[""]
    assert np.allclose(m.x_mean, x.mean(0), rtol=1e-13)
    assert np.allclose(m.xx / 202, np.cov(x, rowvar=False), rtol=1e-8)


def test_moments_subtract_to_training_sets(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 10))
    ds = samples(spark, x)
    parts = moments.moments(ds.df, "x", key=F.col("ix") % 4, width=10)
    whole = moments.total(parts.values())
    for f in range(4):
        kept = x[np.arange(100) % 4 != f]
        m = whole - parts[str(f)]
        assert m.n == 75 and np.allclose(m.covariance(), np.cov(kept, rowvar=False))


def test_few_scalar_columns_agree_with_arrays(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(50, 3))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    m = moments.moments(df, ["a", "b"], ["c"])[""]
    assert np.allclose(m.m2 / 49, np.cov(np.array(rows), rowvar=False))


def test_large_quantiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(size=(4000, 2)) * 3)
    x[:1500, 0] = 2.5   # a third of the values are equal
    ds = samples(spark, x)
    monkeypatch.setattr(stats, "_SMALL_GROUP", 10)
    got = stats.array_quantiles(ds.df, [0.0, 0.25, 0.5, 0.9, 1.0])
    assert np.allclose(got, np.quantile(x, [0.0, 0.25, 0.5, 0.9, 1.0], axis=0), rtol=1e-12)


@pytest.mark.parametrize("cv", [CV("kfold", 4), CV("kfold", 4, shuffle=False), CV("venetian_blinds", 4),
                                CV("stratified_kfold", 4)])
def test_partitions_test_every_row_once(spark, cv):
    rng = np.random.default_rng(4)
    ds = samples(spark, rng.normal(size=(45, 2)), rng.normal(size=45))
    out = folds.assign(ds.df, cv)
    rows = folds.fold_table(out)
    assert rows.filter("role = 'test'").groupBy("ix").count().filter("count <> 1").count() == 0
    assert rows.filter("role = 'train'").count() == 45 * 3
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= (10 if cv.strategy == "stratified_kfold" else 1)


def test_bootstrap_draws_n_rows_and_tests_the_rest(spark):
    ds = samples(spark, np.arange(60.0)[:, None])
    t = folds.fold_table(folds.assign(ds.df, CV("bootstrap", 3)))
    for r in t.groupBy("fold").agg(F.sum(F.when(F.col("role") == "train", F.col("weight"))).alias("w"),
                                   F.count("*").alias("n")).collect():
        assert r["w"] == 60 and r["n"] == 60


def _kennard_stone(x, k):
    d = np.linalg.norm(x - x.mean(0), axis=1)
    picks = [int(d.argmax())]
    near = np.linalg.norm(x - x[picks[0]], axis=1)
    while len(picks) < k:
        near[picks] = -1
        picks.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[picks[-1]], axis=1))
    return picks


def test_kennard_stone_equals_the_sequential_choice(spark, monkeypatch):
    monkeypatch.setattr(splits, "_POOL", 25)   # several passes on a small table
    x = np.random.default_rng(5).normal(size=(150, 4))
    got = splits.kennard_stone(samples(spark, x).df, 40).orderBy("round").collect()
    assert [r["ix"] for r in got] == _kennard_stone(x, 40)


def test_random_split_has_the_exact_size(spark):
    ds = splits.split(samples(spark, np.arange(103.0)[:, None]), "random", 0.7)
    assert ds.cal.count() == 72 and ds.val.count() == 31


def test_quota_by_largest_remainder():
    assert splits.quotas({"a": 5, "b": 3, "c": 2}, 5) == {"a": 3, "b": 1, "c": 1}


def test_wide_roundtrip(spark):
    x = np.random.default_rng(6).normal(size=(8, 5))
    back = stats.to_wide(stats.to_long(samples(spark, x).df))
    assert np.allclose(wide(back, "x"), x)
