"""Clusterers over sums against plain loops, and the silhouette of all rows against all pairs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import clustering as C


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    return np.concatenate([rng.normal(m, 0.7, (150, 3)) for m in (-2, 0, 3)])


@pytest.fixture(scope="module")
def points(spark, data):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(data)], "id bigint, token array<double>").repartition(7).cache()


def starts(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "word int, centroid array<double>")


def model(df, *columns):
    rows = df.orderBy("word").collect()
    return [np.array([r[c] for r in rows]) for c in columns]


def nearest(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)


def test_lloyd(spark, data, points):
    c = np.concatenate((data[:4], [[99.0, 99, 99]]))  # the last centroid never gets a point
    words, error = C.lloyd(points, starts(spark, c), 5)
    for _ in range(5):
        near = nearest(data, c)
        c = np.array([data[near == k].mean(0) if (near == k).any() else c[k] for k in range(5)])
    np.testing.assert_allclose(model(words, "centroid")[0], c, atol=1e-9)
    assert abs(error - ((data - c[nearest(data, c)]) ** 2).sum(1).mean()) < 1e-9


def test_restarts_keep_the_best(spark, data, points):
    sets = [starts(spark, data[:3]), starts(spark, data[[0, 160, 310]])]
    best = C.kmeans_restarts(points, sets, 30)[1]
    assert best == min(C.lloyd(points, s, 30, tolerance=1e-4)[1] for s in sets)


def test_no_points(spark, points):
    s = starts(spark, np.eye(3))
    none = points.where("false")
    assert C.lloyd(none, s, 3)[1] == 0 and C.mini_batch_kmeans(none, s, "id", 2).count() == 3 and C.gaussian_mixture(none, s, 2)[0].count() == 3


def test_mini_batches(spark, data, points):
    got = model(C.mini_batch_kmeans(points, starts(spark, data[:4]), "id", 5, epochs=2, seed=9), "centroid", "weight")
    batch = np.array([int(hashlib.md5(f"9:{i}".encode()).hexdigest()[:8], 16) % 5 for i in range(len(data))])
    c, seen = data[:4].copy(), np.zeros(4)
    for _ in range(2):
        for b in range(5):
            part = data[batch == b]
            near = nearest(part, c)
            for x, k in zip(part, near):  # one point at a time, each at a rate of one in all so far
                seen[k] += 1
                c[k] += (x - c[k]) / seen[k]
    np.testing.assert_allclose(got[0], c, atol=1e-6)
    assert (got[1] == seen).all() and seen.sum() == 2 * len(data)


def test_mixture(spark, data, points):
    begin = data[[0, 160, 310]]
    got, level = C.gaussian_mixture(points, starts(spark, begin), 12, tolerance=-np.inf)
    mean, variance, weight = begin.copy(), np.tile(data.var(0) + 1e-6, (3, 1)), np.full(3, 1 / 3)
    for _ in range(12):
        density = np.array([[w * np.prod(np.exp(-((x - m) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v)) for m, v, w in zip(mean, variance, weight)] for x in data])
        before = np.log(density.sum(1)).mean()
        share = density / density.sum(1, keepdims=True)
        mass = share.sum(0)
        weight, mean = mass / len(data), share.T @ data / mass[:, None]
        variance = np.array([(share[:, k, None] * (data - mean[k]) ** 2).sum(0) / mass[k] for k in range(3)]) + 1e-6
    for a, b in zip(model(got, "centroid", "variance", "weight"), (mean, variance, weight)):
        np.testing.assert_allclose(a, b, atol=1e-6)
    assert abs(level - before) < 1e-6
    labels = {r.id: r.cluster for r in C.mixture_labels(points, got).collect()}
    density = np.array([[np.log(w) - (((x - m) ** 2) / v + np.log(v)).sum() / 2 for m, v, w in zip(mean, variance, weight)] for x in data])
    assert [labels[i] for i in range(len(data))] == density.argmax(1).tolist()
    assert np.mean(density.argmax(1) == np.repeat([0, 1, 2], 150)) > 0.95  # the planted groups are found
    assert points.columns == ["id", "token"]


def test_mixture_stops(spark, data, points):
    few, many = (C.gaussian_mixture(points, starts(spark, data[[0, 160, 310]]), n, tolerance=1e-3)[1] for n in (30, 60))
    assert few == many


def test_silhouette_all(spark, data):
    label = np.concatenate((np.repeat([0, 1, 2], 150)[:-1], [7]))
    label[5] = -1
    rows = spark.createDataFrame([(int(k), [float(v) for v in x]) for k, x in zip(label, data)] + [(None, [0.0, 0.0, 0.0])], "label int, v array<double>").repartition(4)
    (got,) = C.silhouette_all(rows).collect()
    x, y = data[label >= 0], label[label >= 0]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i, k in enumerate(y):
        own = y == k
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][y == j].mean() for j in np.unique(y) if j != k)
        s.append((b - a) / max(a, b))
    assert got.n == len(x) and abs(got.silhouette - np.mean(s)) < 1e-9
    assert C.silhouette_all(rows.where("label = 0")).first().silhouette is None and C.silhouette_all(rows.where("false")).first().n == 0
