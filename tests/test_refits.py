"""Refits per validation sample: exact assignment, one medoid, the whole similarity table."""

import itertools

import numpy as np
import pytest

from helpers import samples, wide
from spectrafold.operators import mcr, nearby, parafac, refits
from spectrafold.operators.stats import cosine_matrix

RNG = np.random.default_rng


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7])
def test_assignment_is_the_best_permutation(n):
    rng = RNG(n)
    for k in range(30):
        gain = rng.random((n, n)) if k % 3 else rng.integers(0, 3, (n, n)).astype(float)
        best = max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        got = refits.assignment(gain)
        assert sorted(got) == list(range(n)) and np.isclose(gain[np.arange(n), got].sum(), best)


def test_assignment_beyond_what_permutations_reach():
    hidden = RNG(1).permutation(40)
    gain = RNG(2).random((40, 40)) * 0.5
    gain[np.arange(40), hidden] += 1
    assert (refits.assignment(gain) == hidden).all()


@pytest.mark.parametrize("n, block", [(1, 8), (23, 100), (23, 7), (23, 1)])
def test_similarities_and_medoid(spark, n, block):
    models = np.abs(RNG(3).normal(size=(n, 3, 6)))
    rows = [(i * 5, [float(v) for v in models[i].ravel()], [1.0, 2.0, 3.0], [0.5]) for i in range(n)]
    fits = spark.createDataFrame(rows, "ix long, profiles array<double>, scores array<double>, facts array<double>")
    got = refits.similarities(fits, 3, block)
    best = lambda a, b: max(sum(abs(cosine_matrix(a, b))[i, p[i]] for i in range(3)) for p in itertools.permutations(range(3))) / 3
    want = {(5 * i, 5 * j): best(models[i], models[j]) for i in range(n) for j in range(n)}
    table = {(r["ix_a"], r["ix_b"]): r["similarity"] for r in got.table.collect()}
    assert got.table.count() == len(want) and table.keys() == want.keys()
    assert all(np.isclose(table[k], v) for k, v in want.items())
    total = [round(sum(want[5 * i, 5 * j] for j in range(n)), 9) for i in range(n)]
    assert got.medoid == 5 * int(np.argmax(total)) and np.isclose(got.min(), min(want.values()))


def split(spark, x, shape=None, val=70):
    df = samples(spark, x, shape=shape) if shape else samples(spark, x)
    from pyspark.sql import functions as F

    return df.with_df(df.df.withColumn("split", F.when(F.col("ix") < val, "val").otherwise("cal")))


def both(rows):
    return {r["ix"]: (np.array(r["scores"]), r["sfit"]) for r in rows.collect()}


def test_bilinear_refits_do_not_depend_on_the_batch(spark):
    rng = RNG(5)
    c, s = rng.random((130, 3)), np.abs(rng.normal(size=(3, 20)))
    ds = split(spark, c @ s)
    model = mcr.mcr_als(ds, 3, max_iter=200, joint=False)
    one, similar = mcr.sample_refits(ds, model, max_iter=5)
    other, again = mcr.sample_refits(ds, model, max_iter=5, batch=11)
    a, b = both(one), both(other)
    assert len(a) == 70 and a.keys() == b.keys() and similar.medoid == again.medoid
    assert all(np.allclose(a[i][0], b[i][0]) and np.isclose(a[i][1], b[i][1]) for i in a)
    assert similar.table.count() == 70 * 70 and similar.min() > 0.95
    # one order for all samples: each score follows one and the same planted component
    found = np.array([a[i][0] for i in range(70)])
    r = np.abs(np.corrcoef(found.T, c[:70].T)[:3, 3:])
    assert sorted(r.argmax(1)) == [0, 1, 2]


def test_trilinear_refits_do_not_depend_on_the_batch(spark):
    rng = RNG(6)
    a, b, c = rng.random((110, 2)), rng.normal(size=(6, 2)), rng.normal(size=(5, 2))
    x = np.einsum("ik,jk,lk->ijl", a, b, c)
    ds = split(spark, x, (6, 5))
    model = parafac.parafac(ds.with_df(ds.cal), 2, max_iter=200)
    one, similar = parafac.sample_refits(ds, model, max_iter=4)
    other, _ = parafac.sample_refits(ds, model, max_iter=4, batch=9)
    p, q = both(one), both(other)
    assert len(p) == 70 and all(np.allclose(p[i][0], q[i][0]) for i in p) and similar.table.count() == 4900
    r = np.abs(np.corrcoef(np.array([p[i][0] for i in range(70)]).T, a[:70].T)[:2, 2:])
    assert r.max(1).min() > 0.999 and sorted(r.argmax(1)) == [0, 1]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_blocks_of_models_are_compared_at_once(monkeypatch, k):
    a, b = RNG(3).normal(size=(7, k, 6)), RNG(4).normal(size=(5, k, 6))
    a[2] = 0
    want = [[refits.matched_similarity(p, q) for q in b] for p in a]
    calls = []
    plain = refits.assignment
    monkeypatch.setattr(refits, "assignment", lambda s: calls.append(1) or plain(s))
    assert np.allclose(refits.block_similarities(a, b), want, atol=1e-14)
    assert len(calls) == (35 if k > 4 else 0)   # one call a pair before


def rough(spark, seed, shape, n=900, val=60):
    """Rows of two components, some of which a row lacks, with noise."""
    rng = RNG(seed)
    factors = [rng.random((m, 2)) for m in shape]
    c = np.where(rng.random((n, 2)) < 0.3, 0, rng.random((n, 2)))
    parts = "abcd"[:len(shape)]
    x = np.einsum("nr," + ",".join(f"{p}r" for p in parts) + "->n" + parts, c, *factors)
    return split(spark, x + 0.05 * rng.random(x.shape), shape if len(shape) > 1 else None, val)


@pytest.mark.parametrize("kind", ["bilinear", "augmented", "trilinear", "free"])
def test_refits_near_a_centre_need_no_pass_of_their_own(spark, monkeypatch, kind):
    if kind in ("trilinear", "free"):
        ds, at = rough(spark, 7, (5, 4)), parafac
        rules = {} if kind == "free" else {m: {"non_negative": 1} for m in range(3)}
        model = parafac.parafac(ds.with_df(ds.cal), 2, rules, max_iter=6)
    else:
        ds, at = rough(spark, 8, (12,) if kind == "bilinear" else (4, 5)), mcr
        model = mcr.mcr_als(ds, 2, spectral_way=2 if kind == "augmented" else None, max_iter=6, joint=False)
    monkeypatch.setattr(nearby, "NEAR_ROWS", 200)
    calls = []
    plain = at._alternate
    monkeypatch.setattr(at, "_alternate", lambda *a, **k: calls.append(1) or plain(*a, **k))
    one = both(at.sample_refits(ds, model, max_iter=3)[0])
    assert not calls and len(one) == 60   # a batch of passes before
    monkeypatch.setattr(nearby, "ALL_CELLS", 0)
    other = both(at.sample_refits(ds, model, max_iter=3)[0])
    assert calls and one.keys() == other.keys()
    assert all(np.allclose(one[i][0], other[i][0], rtol=1e-7, atol=1e-9) and np.isclose(one[i][1], other[i][1], rtol=1e-7) for i in one)


def test_refits_beyond_the_reach_take_the_passes(spark, monkeypatch):
    ds = rough(spark, 9, (12,), n=300, val=8)
    x = np.array([r["x"] for r in ds.df.orderBy("ix").collect()])
    x[3, 2:5] *= 1e4
    ds = split(spark, x, val=8)
    model = mcr.mcr_als(ds, 2, max_iter=6, joint=False)
    monkeypatch.setattr(nearby, "NEAR_ROWS", 40)
    seen = []
    plain = mcr._alternate
    monkeypatch.setattr(mcr, "_alternate", lambda *a, **k: seen.append(len(a[2])) or plain(*a, **k))
    one, similar = mcr.sample_refits(ds, model, max_iter=3)
    one = both(one)
    assert 1 <= sum(seen) < 8 and len(one) == 8 and similar.totals.count() == 8
    monkeypatch.setattr(nearby, "ALL_CELLS", 0)
    other = both(mcr.sample_refits(ds, model, max_iter=3)[0])
    assert all(np.allclose(one[i][0], other[i][0], rtol=1e-7, atol=1e-9) for i in one)


def test_totals_are_those_of_the_whole_table(spark):
    models = np.abs(RNG(4).normal(size=(90, 2, 5)))
    rows = [(i // 2, [float(v) for v in m.ravel()], [1.0, 2.0], [0.5]) for i, m in enumerate(models)]   # each id twice
    fits = spark.createDataFrame(rows, "ix long, profiles array<double>, scores array<double>, facts array<double>")
    for size in (None, 16):
        got = refits.similarities(fits, 2, size)
        want = {}
        for r in got.table.collect():
            want.setdefault(r["ix_a"], []).append(r["similarity"])
        found = {r["ix"]: r for r in got.totals.collect()}
        assert found.keys() == want.keys() and got.table.count() == 90 * 90
        assert all(found[k]["models"] == len(v) == 180 and np.isclose(found[k]["total"], sum(v)) and np.isclose(found[k]["least"], min(v))
                   for k, v in want.items())
