"""Newton-Krylov steps, and rates recovered by them."""

import numpy as np
import pytest

from readloom.plans import bias, solvers


def test_newton_krylov():
    rng = np.random.default_rng(2)
    a = np.eye(30) + rng.normal(size=(30, 30)) * 0.1
    truth = rng.uniform(0.1, 0.9, 30)
    f = lambda x: a @ x**3 - a @ truth**3
    found = solvers.newton_krylov(f, np.full(30, 0.5), 0.0, 1.0, 1e-11)
    assert found.settled and found.residual <= 1e-11 and found.x == pytest.approx(truth, abs=1e-8)
    assert not solvers.newton_krylov(lambda x: x**2 + 1, np.array([0.5]), 0.0, 1.0, 1e-9).settled
    assert solvers.newton_krylov(lambda x: x[:0], np.empty(0), 0.0, 1.0, 1e-9).settled


def test_krylov_step():
    rng = np.random.default_rng(3)
    a = np.eye(12) + rng.normal(size=(12, 12)) * 0.2
    b = rng.normal(size=12)
    assert solvers.krylov_step(lambda v: a @ v, b, 12, 1e-12) == pytest.approx(np.linalg.solve(a, b))


@pytest.mark.parametrize("merged", [False, True])
@pytest.mark.parametrize("most", [0.05, 0.5])
def test_rates(merged, most):
    """Rates come back from what they are seen as, also where reads end anywhere and some positions never mutate."""
    rng = np.random.default_rng(5)
    n, gap = 60, 3
    p = rng.uniform(0, most, n) * (rng.random(n) < 0.8)
    ends = np.triu(rng.random((n, n))) ** 3
    ends[:, 55:] = 0
    ends /= ends.sum()
    seen = (bias.observed_merged if merged else bias.observed)(p, ends, gap)
    found = bias.solve(seen, ends, gap, merged=merged)
    assert found.settled and found.residual <= 1e-10 and found.x[:55] == pytest.approx(p[:55], abs=1e-7)


def test_rates_that_nothing_gives():
    """No rates give these: what is found is said to be off, and by how much."""
    ends = np.zeros((5, 5))
    ends[0, 4] = 1
    found = bias.solve(np.full(5, 0.9), ends, 4)
    assert not found.settled and found.residual > 0.1 and (found.x >= 0).all() and (found.x <= 1).all()
