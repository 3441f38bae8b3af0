"""Clusterers that are steps over sums of the points (VEC8, VEC9), and what sums say about clusters (VEC15, VEC16): a step is one pass, and only sums travel.

Each step sends the model, K rows that ``matrix`` bounds, to all tasks. A batch of points gives its
sums for every cluster, Spark adds them up, and the driver gets K rows of sums. Points may be read
many times, so callers stage or persist what is costly to compute. All of it is deterministic
given its starts: results don't depend on partitioning but for the order of additions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspark.functions.vectors import sum_vector
from cellspark.operators import kernels
from cellspark.operators.sampling import hash_order, subsample
from cellspark.operators.vectors import assign, cluster_sizes, matrix


def vectors_of(column: pa.Array, rows: int) -> np.ndarray:
    """Arrow lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _model(words: np.ndarray, centroids: np.ndarray, session, **more: np.ndarray) -> DataFrame:
    rows = [(int(w), [float(x) for x in c], *(v[i].tolist() if v[i].ndim else float(v[i]) for v in more.values())) for i, (w, c) in enumerate(zip(words, centroids))]
    extra = "".join(f", {n} {'ARRAY<DOUBLE>' if v.ndim > 1 else 'DOUBLE'}" for n, v in more.items())
    return session.createDataFrame(rows, f"word INT, centroid ARRAY<DOUBLE>{extra}")


def cluster_sums(points: DataFrame, sums: Callable[[np.ndarray], np.ndarray], k: int, column: str = "token") -> np.ndarray:
    """Sum over all points of ``sums``, which gives a row of numbers for each of ``k`` clusters from a matrix of points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(vectors_of(batch.column("_v"), batch.num_rows))
                total = part if total is None else total + part
        if total is not None:
            offsets = pa.array(np.arange(k + 1, dtype=np.int32) * total.shape[1])
            yield pa.record_batch([pa.array(np.arange(k, dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], ["at", "part"])

    parts = points.select(F.col(column).cast("array<double>").alias("_v")).mapInArrow(run, "at int, part array<double>")
    rows = parts.groupBy("at").agg(sum_vector(F.col("part")).alias("s")).orderBy("at").collect()
    return np.array([r.s for r in rows], np.float64) if rows else np.zeros((0, 1))


def _hard(centroids: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Of the points nearest to each centroid: how many, the sum of their squared distances, the sum of their vectors."""
    k = len(centroids)

    def sums(points: np.ndarray) -> np.ndarray:
        word, distance = kernels.nearest(points, centroids)
        out = np.zeros((k, 2 + points.shape[1]))
        out[:, 0] = np.bincount(word, minlength=k)
        out[:, 1] = np.bincount(word, distance, k)
        np.add.at(out[:, 2:], word, points)
        return out

    return sums


def lloyd(points: DataFrame, starts: DataFrame, iterations: int, column: str = "token", tolerance: float = 0.0) -> tuple[DataFrame, float]:
    """VEC8: ``word, centroid`` after at most ``iterations`` steps of k-means from the centroids ``starts``, and the mean squared distance to the nearest one.

    A point belongs to its nearest centroid, the first in order on a tie; a centroid without
    points stays where it is. It stops early once no centroid moves farther than ``tolerance``.
    No points: the starts, and 0.
    """
    words, centroids = matrix(starts)
    for _ in range(iterations):
        found = cluster_sums(points, _hard(centroids), len(words), column)
        if not len(found):
            break
        n = found[:, :1]
        moved = np.where(n > 0, found[:, 2:] / np.maximum(n, 1), centroids)
        far = np.sqrt(((moved - centroids) ** 2).sum(1)).max()
        centroids = moved
        if far <= tolerance:
            break
    found = cluster_sums(points, _hard(centroids), len(words), column)
    error = float(found[:, 1].sum() / max(1.0, found[:, 0].sum())) if len(found) else 0.0
    return _model(words, centroids, points.sparkSession), error


def kmeans_restarts(points: DataFrame, starts: list[DataFrame], iterations: int = 100, column: str = "token", tolerance: float = 1e-4) -> tuple[DataFrame, float]:
    """VEC8: the best of several runs of ``lloyd``, one from each set of starts: the one with the lowest error, the first on a tie."""
    return min((lloyd(points, s, iterations, column, tolerance) for s in starts), key=lambda x: x[1])


def mini_batch_kmeans(points: DataFrame, starts: DataFrame, key: str, batches: int, epochs: int = 1, seed: int = 42, column: str = "token") -> DataFrame:
    """VEC9: ``word, centroid, weight`` of mini-batch k-means.

    Points are dealt to ``batches`` by a hash of seed and key. A batch's points are given to the
    nearest centroids as these were before the batch; each centroid then moves to the mean of
    all points it has been given so far, so that its learning rate is its share of new points.
    ``weight`` is how many those are. An epoch takes every batch once.
    """
    words, centroids = matrix(starts)
    seen = np.zeros(len(words))
    batch = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint") % batches
    dealt = points.select(batch.alias("_batch"), column)
    for _ in range(epochs):
        for b in range(batches):
            found = cluster_sums(dealt.where(F.col("_batch") == b), _hard(centroids), len(words), column)
            if len(found):
                n = found[:, 0]
                seen = seen + n
                rate = np.where(n > 0, 1 / np.maximum(seen, 1), 0)[:, None]
                centroids = centroids + rate * (found[:, 2:] - n[:, None] * centroids)
    return _model(words, centroids, points.sparkSession, weight=seen)


def log_densities(points: np.ndarray, weight: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Log of each component's share of each point's density [point, component], diagonal Gaussians."""
    precision = 1 / variance
    square = points**2 @ precision.T - 2 * points @ (mean * precision).T + (mean**2 * precision).sum(1)
    with np.errstate(divide="ignore"):
        return np.log(weight) - 0.5 * (np.log(2 * np.pi * variance).sum(1) + square)


def gaussian_mixture(points: DataFrame, starts: DataFrame, iterations: int, column: str = "token", floor: float = 1e-6, tolerance: float = 0.0) -> tuple[DataFrame, float]:
    """VEC9: ``word, centroid, variance, weight`` of a mixture of Gaussians with diagonal covariances, by EM, and the mean log density of the points before the last step.

    ``starts`` are the first means, with equal weights and the variance of all points. ``floor``
    is added to every variance. It stops early once the mean log density grows by no more than ``tolerance``.
    """
    words, mean = matrix(starts)
    k, d = mean.shape
    whole = cluster_sums(points, lambda x: np.concatenate(([[len(x)], x.sum(0), (x * x).sum(0)]), axis=None)[None], 1, column)
    if not len(whole):
        return _model(words, mean, points.sparkSession, variance=np.full((k, d), floor), weight=np.full(k, 1 / k)), 0.0
    n, first, second = whole[0, 0], whole[0, 1 : 1 + d], whole[0, 1 + d :]
    variance = np.tile(second / n - (first / n) ** 2 + floor, (k, 1))
    weight, level = np.full(k, 1 / k), -np.inf
    for _ in range(iterations):

        def sums(x: np.ndarray, weight=weight, mean=mean, variance=variance) -> np.ndarray:
            logs = log_densities(x, weight, mean, variance)
            top = logs.max(1, keepdims=True)
            whole = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
            share = np.exp(logs - whole)
            out = np.zeros((k, 2 + 2 * d))
            out[:, 0], out[0, 1] = share.sum(0), whole.sum()
            out[:, 2 : 2 + d], out[:, 2 + d :] = share.T @ x, share.T @ (x * x)
            return out

        found = cluster_sums(points, sums, k, column)
        mass = np.maximum(found[:, :1], 10 * np.finfo(float).eps)
        before, level = level, found[0, 1] / n
        weight, mean = mass[:, 0] / mass.sum(), found[:, 2 : 2 + d] / mass
        variance = np.maximum(found[:, 2 + d :] / mass - mean**2, 0) + floor
        if level - before <= tolerance:
            break
    return _model(words, mean, points.sparkSession, variance=variance, weight=weight), float(level)


def mixture_labels(points: DataFrame, model: DataFrame, column: str = "token", name: str = "cluster") -> DataFrame:
    """VEC9: adds the component with the largest share of each point's density, the first on a tie."""
    words, mean = matrix(model)
    _, rest = matrix(model.select("word", F.concat("variance", F.array("weight")).alias("rest")), vector="rest")
    shared = points.sparkSession.sparkContext.broadcast((words.astype(np.int32), rest[:, -1], mean, rest[:, :-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, mean, variance = shared.value
        for batch in batches:
            if batch.num_rows:
                logs = log_densities(vectors_of(batch.column("_v"), batch.num_rows), weight, mean, variance)
                yield pa.record_batch([*[c for n, c in zip(batch.schema.names, batch.columns) if n != "_v"], pa.array(names[logs.argmax(1)])], [*[n for n in batch.schema.names if n != "_v"], name])

    source = points.withColumn("_v", F.col(column).cast("array<double>"))
    return source.mapInArrow(run, points.withColumn(name, F.lit(0)).schema)


def silhouette_all(points: DataFrame, column: str = "v") -> DataFrame:
    """VEC15: ``n, silhouette`` of all points (``label, v``) by squared distances, without sampling; noise (label < 0) and null labels are left out, null with fewer than 3 points or 2 labels.

    The mean squared distance of a point to a cluster follows from the cluster's count, sum of
    vectors and sum of squares, so that two passes do in place of all pairs. A point alone in its
    cluster counts 0. One row for each label goes to all tasks, within the bound of ``matrix``.
    """
    vector = F.col(column).cast("array<double>")
    kept = points.where("label >= 0").select(F.col("label").cast("bigint").alias("label"), vector.alias("_v"))
    square = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)
    clusters = kept.groupBy("label").agg(F.count("*").cast("double").alias("n"), F.sum(square).alias("q"), sum_vector(F.col("_v")).alias("s")).select("label", F.concat(F.array("n", "q"), "s").alias("sums"))
    names, sums = matrix(clusters, "label", "sums")
    spark = points.sparkSession
    if len(names) < 2 or sums[:, 0].sum() < 3:
        return spark.createDataFrame([(int(sums[:, 0].sum()) if len(names) else 0, None)], "n BIGINT, silhouette DOUBLE")
    shared = spark.sparkContext.broadcast((names.astype(np.int64), sums[:, 0], sums[:, 1], sums[:, 2:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, q, s = shared.value
        hits, total = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                x, own = vectors_of(batch.column("_v"), batch.num_rows), np.searchsorted(names, batch.column("label").to_numpy())
                mean = np.maximum((x * x).sum(1)[:, None] - 2 * x @ (s / n[:, None]).T + q / n, 0)
                row = np.arange(len(x))
                a = mean[row, own] * n[own] / np.maximum(n[own] - 1, 1)
                mean[row, own] = np.inf
                b = mean.min(1)
                total += float(np.where(n[own] == 1, 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).sum())
                hits += len(x)
        yield pa.record_batch([pa.array([hits], pa.int64()), pa.array([total])], ["n", "s"])

    return kept.mapInArrow(run, "n bigint, s double").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("silhouette"))


def k_sweep_from(points: DataFrame, starts: DataFrame, ks: list[int], iterations: int = 20, key: str = "id", column: str = "token") -> DataFrame:
    """VEC16: ``k, error, smallest, largest, silhouette`` for each k: ``lloyd`` from the first k of ``starts`` (by word), the silhouette over all points."""
    rows = []
    for k in ks:
        words, error = lloyd(points, starts.where(F.col("word") < k), iterations, column)
        given = assign(points, words, column, carry=(key, column))
        sizes = cluster_sizes(given, words).agg(F.min("size"), F.max("size")).first()
        s = silhouette_all(given.select(F.col("word").alias("label"), F.col(column).alias("v"))).first().silhouette
        rows.append((k, float(error), int(sizes[0]), int(sizes[1]), s))
    return points.sparkSession.createDataFrame(rows, "k INT, error DOUBLE, smallest BIGINT, largest BIGINT, silhouette DOUBLE")


def first_starts(points: DataFrame, key: str, k: int, column: str = "token", seed: int = 42) -> DataFrame:
    """``word, centroid``: the ``k`` points that come first in the hash order of seed and key, K rows."""
    some = subsample(points.select(key, column), key, k, seed)
    return some.select((F.row_number().over(Window.orderBy(hash_order(seed, key), key)) - 1).alias("word"), F.col(column).cast("array<double>").alias("centroid"))
