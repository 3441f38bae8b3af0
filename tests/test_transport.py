"""Entropic transport by products with one kernel against the log domain."""

import time

import numpy as np
import pytest

from cellspark.operators import kernels as K


@pytest.mark.parametrize("eps", [0.05, 0.01, 0.005])
def test_products_equal_the_log_domain(eps):
    rng = np.random.default_rng(1)
    p, q = rng.dirichlet(np.full(24, 0.2), 40), rng.dirichlet(np.full(24, 0.2), 40)
    p[0], q[0] = np.eye(24)[0], np.eye(24)[23]
    for cost in (K.index_cost(24), rng.random((24, 24))):
        np.testing.assert_allclose(K.sinkhorn(p, q, cost, eps), K.sinkhorn_log(p, q, cost, eps), rtol=1e-6, atol=1e-9)


def test_costs_beyond_the_kernel():
    """Where exponentials would vanish the log domain is taken."""
    rng = np.random.default_rng(2)
    p, q = rng.dirichlet(np.ones(8), 5), rng.dirichlet(np.ones(8), 5)
    exact = np.abs(np.cumsum(p - q, 1)).sum(1) / 7
    got = K.sinkhorn(p, q, K.index_cost(8), 0.004, 4000)
    assert 1 / 0.004 > K.SAFE and np.abs(got - exact).max() < 0.01


def test_many_pairs_of_many_words():
    """10,000 pairs of 512 words in bounded memory; some of them against the log domain."""
    rng = np.random.default_rng(0)
    p, q = rng.dirichlet(np.full(512, 0.05), 10_000), rng.dirichlet(np.full(512, 0.05), 10_000)
    cost = 1 - (x := rng.normal(0, 1, (512, 8))) @ x.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1))
    start = time.time()
    got = K.sinkhorn(p, q, cost)
    assert time.time() - start < 200
    np.testing.assert_allclose(got[:6], K.sinkhorn_log(p[:6], q[:6], cost), atol=1e-6)
