"""Nearest centroids whose distances tie once rounded (VEC10)."""

import numpy as np

from cellspark.operators import kernels as K
from cellspark.operators import vectors as X


def test_rounded_distances_tie():
    # The second centroid is nearer by less than the ninth decimal, then by more.
    centroids = np.array([[0.5, 1.0], [0.5 - 2e-10, 1.0], [0.5 - 3e-9, 1.0]])
    tokens = np.array([[0.0, 1.0]])
    assert K.nearest(tokens, centroids[:2])[0].tolist() == [1]
    assert K.nearest(tokens, centroids[:2], 9)[0].tolist() == [0]
    assert K.nearest(tokens, centroids[[0, 2]], 9)[0].tolist() == [1]


def test_rounding_against_a_loop():
    rng = np.random.default_rng(3)
    base = rng.random((6, 8))
    centroids = np.concatenate((base, base + rng.normal(0, 1e-9, base.shape)))[rng.permutation(12)]
    tokens = np.concatenate((rng.random((3000, 8)), centroids))
    want = [min((round(float(np.sqrt(((t - c) ** 2).sum())), 9), i) for i, c in enumerate(centroids))[1] for t in tokens]
    assert K.nearest(tokens, centroids, 9)[0].tolist() == want


def test_assign_by_rounded_distances(spark):
    words = spark.createDataFrame([(3, [0.5, 1.0]), (7, [0.5 - 2e-10, 1.0])], "word int, centroid array<double>")
    tokens = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [2.0, 1.0])], "cell_id bigint, pos int, token array<double>")
    assert {r.pos: r.word for r in X.assign(tokens, words, digits=9).collect()} == {0: 3, 1: 3}
    assert {r.pos: r.word for r in X.assign(tokens, words).collect()} == {0: 7, 1: 3}
