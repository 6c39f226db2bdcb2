import numpy as np
from helpers import samples

from spectrafold.operators import splits


def _sequential(x, k):
    d = np.linalg.norm(x - x.mean(0), axis=1)
    picks = [int(d.argmax())]
    near = np.linalg.norm(x - x[picks[0]], axis=1)
    while len(picks) < k:
        near[picks] = -1
        picks.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[picks[-1]], axis=1))
    return picks


def test_kennard_stone_takes_a_pool_at_once(spark):
    """256 picks a pass used to be the most; exact copies, whose distance falls to 0, are among the rows."""
    x = np.random.default_rng(7).normal(size=(1500, 12))
    x[1200:1500] = x[:300]
    df = samples(spark, x).df
    spark.sparkContext.setJobGroup("kennard", "kennard")
    got = splits.kennard_stone(df, 1300).orderBy("round").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("kennard"))
    spark.sparkContext.setJobGroup("", "")
    assert [r["ix"] for r in got] == _sequential(x, 1300)
    assert jobs < 40


def test_kennard_stone_checkpoints_now_and_then(spark, monkeypatch):
    monkeypatch.setattr(splits, "_POOL", 12)
    monkeypatch.setattr(splits, "_KEPT", 3)
    x = np.random.default_rng(8).normal(size=(160, 3)) * [1, 1e3, 1e-3] + 1e5
    got = splits.kennard_stone(samples(spark, x).df, 60).orderBy("round").collect()
    assert [r["ix"] for r in got] == _sequential(x, 60)


def test_least_distances_are_those_by_differences():
    rng = np.random.default_rng(9)
    for z in (rng.normal(size=(700, 20)), 1e7 + rng.normal(size=(700, 20)), np.round(rng.normal(size=(700, 2)), 1)):
        points = np.vstack([z[:40], z[:40] + 1e-9])
        d = rng.uniform(0, 5, len(z))
        want = np.minimum(d, np.linalg.norm(z[:, None] - points[None], axis=2).min(1))
        assert np.array_equal(splits._least(z, points, d), want)
