import numpy as np
import pytest
from helpers import samples

from spectrafold.operators import novelty

STARTS = [(np.zeros(2), np.eye(2)), (np.array([1.0, 0.5]), np.diag([2.0, 0.3])), (np.array([-40.0, 7.0]), np.diag([1e-4, 9.0]))]


def _expected(x, h):
    for c, v in STARTS:
        d = np.einsum("ij,ij->i", (x - c) @ np.linalg.pinv(v, hermitian=True), x - c)
        near = x[d <= np.sort(d)[h - 1] * (1 + 1e-12)]
        yield near.mean(0), np.cov(near.T, bias=True)


def test_c_step_takes_two_passes(spark):
    """Tied distances used to need a scan for every few bits of the distance."""
    x = np.round(np.random.default_rng(32).normal(size=(900, 2)), 1)
    spark.sparkContext.setJobGroup("c-step", "c-step")
    got = novelty._c_step(samples(spark, x).df, 2, STARTS, 451, False, True)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("c-step"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 4  # the rows are dealt anew in each pass here
    for (center, cov), (c, v) in zip(got, _expected(x, 451)):
        assert np.allclose(center, c) and np.allclose(cov, v)


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("rows,loose", [(0, 1 << 21), (0, 1), (5, 1), (200, 64)])
def test_c_step_does_not_depend_on_the_guide(spark, monkeypatch, few, rows, loose):
    """Rows that mislead, and cells of more rows than may reach the driver."""
    monkeypatch.setattr(novelty, "_LOOSE", loose)
    rng = np.random.default_rng(33)
    x = np.vstack([np.round(rng.normal(size=(400, 2)), 1), rng.normal(size=(300, 2))])
    guide = (np.full((rows, 2), 0.01) if rows < 100 else x[:rows]), 0.5
    for (center, cov), (c, v) in zip(novelty._c_step(samples(spark, x).df, 2, STARTS, 351, False, few, guide), _expected(x, 351)):
        assert np.allclose(center, c) and np.allclose(cov, v)
