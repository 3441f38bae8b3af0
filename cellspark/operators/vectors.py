"""Vectors, clustering and histograms (VEC1-VEC22).

Tokens are rows ``cell_id, pos, token``; a vocabulary is ``word, centroid``. Centroids and
fitted models are small (K rows) and go to all tasks; tokens never leave theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspark.functions.vectors import argmax, dot, entropy, l1_distance, l2_normalised, mean_vector, norm, sum_vector, total, variance_vector
from cellspark.operators import kernels
from cellspark.operators.sampling import hash_order, positions, subsample

#: Centroid values that may go to all tasks; larger vocabularies are refused.
MOST_VALUES = 64_000_000
#: Words up to which a histogram is summed bin by bin.
MOST_SUMS = 32


def matrix(table: DataFrame, key: str = "word", vector: str = "centroid") -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a small table, ordered by key."""
    size = table.agg(F.count("*").alias("n"), F.sum(F.size(vector)).alias("values")).first()
    if (size["values"] or 0) > MOST_VALUES:
        raise ValueError(f"{size.n} vectors are too many to send to all tasks")
    rows = table.select(key, F.col(vector).cast("array<double>").alias("v")).orderBy(key).collect()
    return np.array([r[0] for r in rows]), np.array([r.v for r in rows], np.float64)


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def nan_audit(cells: DataFrame, vectors: str = "tokens") -> DataFrame:
    """VEC2: per cell: rows, width, rows with a NaN, share of NaN, whether all are."""
    flat = F.flatten(F.col(vectors))
    bad = F.size(F.filter(flat, F.isnan))
    return cells.select(
        *[c for c in cells.columns if c != vectors], F.size(vectors).alias("n_rows"), F.coalesce(F.size(F.get(F.col(vectors), 0)), F.lit(0)).alias("dim"),
        F.size(F.filter(vectors, lambda v: F.exists(v, F.isnan))).alias("nan_rows"), (bad / F.greatest(F.size(flat), F.lit(1))).alias("nan_share"), (bad == F.size(flat)).alias("all_nan"),
    )


def nan_totals(audit: DataFrame) -> DataFrame:
    """VEC2: totals of an audit and min, median, max and mean of the shares."""
    return audit.agg(F.count("*").alias("cells"), F.sum("n_rows").alias("n_rows"), F.sum("nan_rows").alias("nan_rows"), F.min("nan_share").alias("lo"), F.percentile("nan_share", 0.5).alias("median"), F.max("nan_share").alias("hi"), F.avg("nan_share").alias("mean"))


def without_nan(tokens: DataFrame, token: str = "token") -> DataFrame:
    """VEC2: rows whose vector has no NaN and no null."""
    return tokens.where(F.col(token).isNotNull() & ~F.exists(token, lambda v: v.isNull() | F.isnan(v)))


def refuse_nan(tokens: DataFrame, token: str = "token") -> DataFrame:
    """VEC2: fails when a vector with a NaN comes by, as a writer should."""
    bad = F.exists(token, F.isnan)
    return tokens.withColumn(token, F.when(bad, F.raise_error(F.lit("NaN in a vector"))).otherwise(F.col(token)))


def pool_grid(tokens: DataFrame, side: int) -> DataFrame:
    """VEC3: averages 2 x 2 neighbours of each cell's token grid: ``cell_id, pos, token`` with half the side."""
    row, column = F.floor(F.col("pos") / side), F.col("pos") % side
    pos = (F.floor(row / 2) * (side // 2) + F.floor(column / 2)).cast("int")
    return tokens.groupBy("cell_id", pos.alias("pos")).agg(mean_vector(F.col("token")).alias("token"))


def pooled(tokens: DataFrame, mode: str = "avg", cls: DataFrame | None = None) -> DataFrame:
    """VEC4: ``cell_id, pooled``: the cell's own vector (``cls``), the mean of its tokens, or both end to end."""
    mean = tokens.groupBy("cell_id").agg(mean_vector(F.col("token")).alias("mean"))
    if mode == "avg":
        return mean.select("cell_id", F.col("mean").alias("pooled"))
    if mode not in ("cls", "cls_avg") or cls is None:
        raise ValueError("mode is cls, avg or cls_avg; the first and last need cls vectors")
    own = cls.select("cell_id", F.col("cls").cast("array<double>").alias("cls"))
    return own.select("cell_id", F.col("cls").alias("pooled")) if mode == "cls" else own.join(mean, "cell_id").select("cell_id", F.concat("cls", "mean").alias("pooled"))


def pooled_index(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VEC5: mean vector of each (image, row, col), and of each image's first cell."""
    cells = tokens.groupBy("image", "cell_row", "cell_col").agg(mean_vector(F.col("token")).alias("pooled"))
    images = cells.groupBy("image").agg(F.min_by("pooled", F.struct("cell_row", "cell_col")).alias("pooled"))
    return cells, images


def standardised(train: DataFrame, rows: DataFrame, column: str = "token", least: float = 1e-6) -> DataFrame:
    """VEC6: z-scores by the training rows' mean and population deviation; a deviation below ``least`` counts as 1."""
    stats = train.agg(mean_vector(F.col(column)).alias("_mean"), variance_vector(F.col(column)).alias("_var"), F.count("*").alias("_n"))
    deviation = F.transform("_var", lambda v: F.sqrt(v * (F.col("_n") - 1) / F.col("_n")))
    stats = stats.select("_mean", F.transform(deviation, lambda s: F.when(s < least, 1.0).otherwise(s)).alias("_std"))
    centred = F.zip_with(column, "_mean", lambda x, m: x.cast("double") - m)
    return rows.crossJoin(F.broadcast(stats)).withColumn(column, F.zip_with(centred, "_std", lambda x, s: x / s)).drop("_mean", "_std")  # one row of statistics


def pca(rows: DataFrame, dims: int, column: str = "token", sample: DataFrame | None = None) -> DataFrame:
    """VEC7: unit vectors, centred, projected on the first components and brought to unit length again."""
    unit = lambda d: d.withColumn("_u", array_to_vector(l2_normalised(F.col(column))))
    fitted = PCA(k=dims, inputCol="_u", outputCol="_p").fit(unit(sample or rows))
    mean = unit(sample or rows).select(mean_vector(vector_to_array("_u")).alias("m")).first().m
    shift = np.asarray(mean) @ fitted.pc.toArray()
    moved = F.zip_with(vector_to_array("_p"), F.array(*[F.lit(float(x)) for x in shift]), lambda x, m: x - m)
    return fitted.transform(unit(rows)).withColumn(column, l2_normalised(moved)).drop("_u", "_p")


def kmeans(tokens: DataFrame, k: int, seed: int = 42, iterations: int = 100, restarts: int = 3, column: str = "token") -> tuple[DataFrame, float]:
    """VEC8: ``word, centroid`` of the best of several runs, and the mean squared distance to the nearest centroid."""
    points = tokens.select(array_to_vector(F.col(column).cast("array<double>")).alias("features")).persist()
    try:
        n = points.count()
        best = min((KMeans(k=k, seed=seed + i, maxIter=iterations, initSteps=2).fit(points) for i in range(restarts)), key=lambda m: m.summary.trainingCost)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())]
        return tokens.sparkSession.createDataFrame(centres, "word INT, centroid ARRAY<DOUBLE>"), best.summary.trainingCost / max(1, n)
    finally:
        points.unpersist()


def cluster(tokens: DataFrame, method: str, k: int, seed: int = 42, column: str = "token") -> DataFrame:
    """VEC9: adds ``cluster`` by kmeans, minibatch (k-means on a tenth), bisecting or gmm (full covariance)."""
    points = tokens.withColumn("_f", array_to_vector(F.col(column).cast("array<double>")))
    options = {"k": k, "seed": seed, "featuresCol": "_f", "predictionCol": "cluster"}
    kinds: dict[str, Callable] = {"kmeans": KMeans, "minibatch": KMeans, "bisecting": BisectingKMeans, "gmm": GaussianMixture}
    if method not in kinds:
        raise ValueError(f"unknown method {method}; one of {sorted(kinds)}")
    training = points.where(F.pmod(F.xxhash64("_f", F.lit(seed)), F.lit(10)) == 0) if method == "minibatch" else points
    if method == "minibatch" and training.limit(k).count() < k:
        training = points
    drop = ["_f"] + (["probability"] if method == "gmm" else [])
    return kinds[method](**options).fit(training).transform(points).drop(*drop)


def assign(tokens: DataFrame, vocabulary: DataFrame, column: str = "token", carry: Sequence[str] = ("cell_id", "pos"), digits: int | None = None) -> DataFrame:
    """VEC10: ``carry…, word, distance2``: the nearest centroid of each token, the smallest word on a tie; with ``digits``, distances that are equal to so many decimals tie."""
    words, centroids = matrix(vocabulary)
    shared = tokens.sparkSession.sparkContext.broadcast((words, centroids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, c = shared.value
        for batch in batches:
            if len(batch):
                at, d = kernels.nearest(_stack(batch["_v"]), c, digits)
                yield batch.drop(columns="_v").assign(word=names[at].astype(np.int32), distance2=d)

    source = tokens.select(*carry, F.col(column).cast("array<double>").alias("_v"))
    return source.mapInPandas(run, source.drop("_v").schema.add("word", "integer").add("distance2", "double"))


def cluster_sizes(assigned: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """VEC10: ``word, size, share, dominant`` for all words, empty ones too; dominant: more than 5 % of all."""
    n = F.sum("size").over(Window.partitionBy())
    sizes = vocabulary.select("word").join(assigned.groupBy("word").agg(F.count("*").alias("size")), "word", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return sizes.withColumn("share", F.col("size") / F.greatest(n, F.lit(1))).withColumn("dominant", F.col("share") > 0.05)


def ground_cost(vocabulary: DataFrame) -> DataFrame:
    """VEC11: ``i, j, cost``: cosine distance of all word pairs, in [0, 1], 0 on the diagonal. K rows on either side."""
    a = vocabulary.select(F.col("word").alias("i"), l2_normalised(F.col("centroid")).alias("_a"))
    b = vocabulary.select(F.col("word").alias("j"), l2_normalised(F.col("centroid")).alias("_b"))
    cost = F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - dot(F.col("_a"), F.col("_b")))))
    return a.crossJoin(F.broadcast(b)).select("i", "j", cost.alias("cost"))


def soft_histograms(tokens: DataFrame, vocabulary: DataFrame, beta: float = 10.0, floor: float = 1e-8) -> DataFrame:
    """VEC12: ``cell_id, histogram``: soft assignments of a cell's tokens, summed and brought to sum 1.

    Token-major input: a batch's tokens are summed per cell before anything is shuffled.
    """
    words, centroids = matrix(vocabulary)
    shared = tokens.sparkSession.sparkContext.broadcast(kernels.unit_rows(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = batch.column("cell_id").dictionary_encode()
                at = codes.indices.to_numpy()
                order = np.argsort(at, kind="stable")
                flat = batch.column("_v").flatten().to_numpy().reshape(batch.num_rows, -1)
                w = kernels.soft_weights(kernels.unit_rows(flat[order]), shared.value, beta, floor)
                firsts = np.flatnonzero(np.diff(at[order], prepend=-1))
                sums = np.add.reduceat(w, firsts, axis=0)
                offsets = pa.array(np.arange(len(firsts) + 1, dtype=np.int32) * sums.shape[1])
                yield pa.record_batch([codes.dictionary, pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], ["cell_id", "part"])

    kind = tokens.schema["cell_id"].dataType.simpleString()
    parts = tokens.select("cell_id", F.col("token").cast("array<double>").alias("_v")).mapInArrow(run, f"cell_id {kind}, part array<double>")
    # Few words: one sum for each, in generated code; many: a vector of sums.
    if len(words) <= MOST_SUMS:
        sums = parts.groupBy("cell_id").agg(*[F.sum(F.get("part", F.lit(i))).alias(f"w{i}") for i in range(len(words))]).select("cell_id", F.array(*[F.col(f"w{i}") for i in range(len(words))]).alias("h"))
    else:
        sums = parts.groupBy("cell_id").agg(sum_vector(F.col("part")).alias("h"))
    return sums.select("cell_id", l1_normalised(F.col("h"), floor).alias("histogram"))


def soft_histograms_by_cell(cells: DataFrame, vocabulary: DataFrame, beta: float = 10.0, floor: float = 1e-8, tokens: str = "tokens") -> DataFrame:
    """VEC12 for cell-major rows (``cell_id, tokens``): no shuffle."""
    _, centroids = matrix(vocabulary)
    shared = cells.sparkSession.sparkContext.broadcast(kernels.unit_rows(centroids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rows in batch["_v"]:
                h = kernels.soft_weights(kernels.unit_rows(np.array([np.asarray(r, np.float64) for r in rows])), shared.value, beta, floor).sum(0) if len(rows) else np.zeros(len(shared.value))
                out.append(h / max(h.sum(), floor))
            yield pd.DataFrame({"cell_id": batch["cell_id"], "histogram": out})

    kind = cells.schema["cell_id"].dataType.simpleString()
    return cells.select("cell_id", F.col(tokens).cast("array<array<double>>").alias("_v")).mapInPandas(run, f"cell_id {kind}, histogram array<double>")


def l1_normalised(h: Column, floor: float = 1e-8) -> Column:
    s = F.greatest(total(h), F.lit(floor))
    return F.transform(h, lambda v: v / s)


def histogram_stats(histograms: DataFrame) -> DataFrame:
    """VEC13: one row: bins' min, max, mean and deviation; entropy; nearly empty bins; mass of the top 5 and 10."""
    h = F.col("histogram")
    falling = F.reverse(F.sort_array(h))
    each = histograms.select(
        F.array_min(h).alias("lo"), F.array_max(h).alias("hi"), total(h).alias("s"), dot(h, h).alias("ss"), F.size(h).alias("k"), entropy(h).alias("e"),
        F.size(F.filter(h, lambda v: v < 1e-6)).alias("low"), total(F.slice(falling, 1, 5)).alias("t5"), total(F.slice(falling, 1, 10)).alias("t10"),
    )
    n, mean = F.sum("k"), F.sum("s") / F.sum("k")
    return each.agg(
        F.count("*").alias("cells"), F.min("lo").alias("bin_min"), F.max("hi").alias("bin_max"), mean.alias("bin_mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("ss") / n - mean * mean)).alias("bin_std"),
        F.avg("e").alias("entropy_mean"), F.min("e").alias("entropy_min"), F.max("e").alias("entropy_max"), (F.avg("e") / F.log(F.max("k"))).alias("entropy_share"),
        F.avg("low").alias("empty_bins"), F.avg("t5").alias("top5"), F.avg("t10").alias("top10"),
    )


def random_pair_l1(histograms: DataFrame, pairs: int = 1000, seed: int = 42) -> DataFrame:
    """VEC14: ``n, mean, std, lo, hi, verdict`` of the L1 distance over seeded pairs of cells, never a cell with itself."""
    first = subsample(histograms, "cell_id", pairs, seed).withColumn("_n", F.row_number().over(Window.orderBy(hash_order(seed, "cell_id"), "cell_id")))
    second = subsample(histograms, "cell_id", pairs, seed + 1).withColumn("_n", F.row_number().over(Window.orderBy(hash_order(seed + 1, "cell_id"), "cell_id")))
    both = first.alias("a").join(second.alias("b"), F.col("a._n") == F.col("b._n")).where("a.cell_id <> b.cell_id")
    d = both.select(l1_distance(F.col("a.histogram"), F.col("b.histogram")).alias("d"))
    verdict = F.when(F.avg("d") < 0.1, "alike").when(F.avg("d") > 0.3, "distinct").otherwise("moderate")
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.min("d").alias("lo"), F.max("d").alias("hi"), verdict.alias("verdict"))


def silhouette(points: DataFrame, seed: int = 42, most: int = 20_000, key: str = "id") -> DataFrame:
    """VEC15: ``n, silhouette`` of points (``id, label, v``): noise (label < 0) left out, Euclidean, over at most ``most`` points; null with fewer than 3 points or 2 labels."""
    kept = subsample(points.where("label >= 0"), key, most, seed)
    rows = kept.select(key, "label", F.col("v").cast("array<double>").alias("v")).collect()  # at most ``most``
    label, x = np.array([r.label for r in rows]), np.array([r.v for r in rows], np.float64)
    names, y = np.unique(label, return_inverse=True) if len(rows) else (np.zeros(0), label)
    spark = points.sparkSession
    if len(rows) < 3 or len(names) < 2:
        return spark.createDataFrame([(len(rows), None)], "n BIGINT, silhouette DOUBLE")
    shared = spark.sparkContext.broadcast((x, y, len(names)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, k = shared.value
        size = np.bincount(y, minlength=k)
        total = hits = 0
        for batch in batches:
            for part in np.array_split(batch["i"].to_numpy(), max(1, len(batch) // 256)):
                d = kernels.distances(x[part], x)
                d[np.arange(len(part)), part] = 0
                sums = np.stack([np.bincount(y, weights=row, minlength=k) for row in d])
                own = y[part]
                alone = size[own] == 1
                a = sums[np.arange(len(part)), own] / np.maximum(size[own] - 1, 1)
                means = sums / size
                means[np.arange(len(part)), own] = np.inf
                b = means.min(1)
                s = np.where(alone, 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
                total, hits = total + s.sum(), hits + len(part)
        yield pd.DataFrame({"s": [total], "n": [hits]})

    sums = spark.range(len(rows)).withColumnRenamed("id", "i").mapInPandas(run, "s double, n bigint")
    return sums.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("silhouette"))


def k_sweep(tokens: DataFrame, ks: Sequence[int], seed: int = 42, key: str = "id", restarts: int = 1) -> DataFrame:
    """VEC16: ``k, error, smallest, largest, silhouette`` for each k; tokens are kept in memory between the fits."""
    points = tokens.persist()
    rows = []
    for k in ks:
        words, error = kmeans(points, k, seed, restarts=restarts)
        assigned = assign(points, words, carry=(key, "token"))
        sizes = cluster_sizes(assigned, words).agg(F.min("size"), F.max("size")).first()
        s = silhouette(assigned.select(key, F.col("word").alias("label"), F.col("token").alias("v")), seed, key=key).first().silhouette
        rows.append((k, float(error), int(sizes[0]), int(sizes[1]), None if s is None else float(s)))
    points.unpersist()
    return tokens.sparkSession.createDataFrame(rows, "k INT, error DOUBLE, smallest BIGINT, largest BIGINT, silhouette DOUBLE")


def raw_centroids(assigned: DataFrame, column: str = "token") -> DataFrame:
    """VEC17: ``word, centroid``: unit mean of the raw vectors of each cluster."""
    return assigned.groupBy("word").agg(l2_normalised(mean_vector(F.col(column))).alias("centroid"))


def composition_targets(assigned: DataFrame, vocabulary: DataFrame, cell: str = "cell_id") -> DataFrame:
    """VEC18: ``cell, target, target_index``: unit mean of the centroids of a cell's patches, numbered by cell.

    Words are counted per cell first, so centroids meet counts and not patches.
    """
    counts = assigned.groupBy(cell, "word").agg(F.count("*").alias("_n"))
    weighted = counts.join(vocabulary, "word").select(cell, F.transform("centroid", lambda v: v.cast("double") * F.col("_n")).alias("_v"), "_n")
    means = weighted.groupBy(cell).agg(sum_vector(F.col("_v")).alias("_s"), F.sum("_n").alias("_k"))
    targets = means.select(cell, l2_normalised(F.transform("_s", lambda v: v / F.col("_k"))).alias("target"))
    return numbered(targets, cell, "target_index")


def numbered(rows: DataFrame, key: str, name: str, start: int = 0) -> DataFrame:
    """Adds the rank of ``key`` over all rows, from ``start``: a place in a range sort, so that no task holds all rows and the plan is the same for any number of partitions."""
    return positions(rows, [F.asc(key)], name).withColumn(name, F.col(name) + F.lit(start - 1))


def target_diversity(targets: DataFrame, most: int = 1000, seed: int = 42, key: str = "cell_id") -> DataFrame:
    """VEC19: ``n, mean_cosine, verdict``: mean cosine of different targets, from the sum of unit vectors alone."""
    unit = subsample(targets, key, most, seed).select(l2_normalised(F.col("target")).alias("_u"))
    sums = unit.agg(sum_vector(F.col("_u")).alias("s"), F.sum(dot(F.col("_u"), F.col("_u"))).alias("d"), F.count("*").alias("n"))
    mean = F.when(F.col("n") > 1, (dot(F.col("s"), F.col("s")) - F.col("d")) / (F.col("n") * (F.col("n") - 1)))
    return sums.select("n", mean.alias("mean_cosine"), F.when(mean < 0.5, "diverse").otherwise("alike").alias("verdict"))


def collapse_audit(rows: DataFrame, gamma: float = 1.0, column: str = "token") -> DataFrame:
    """VEC20: ``variance_term`` (mean of max(0, gamma - std)) and ``covariance_term`` (squared off-diagonal covariances over the width).

    Each batch gives its sums of products (a width x width matrix); adding those is all that is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, None, None
        for batch in batches:
            if len(batch):
                x = _stack(batch["_v"])
                n, s, g = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if g is None else g + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})

    parts = rows.select(F.col(column).cast("array<double>").alias("_v")).mapInPandas(run, "n bigint, s array<double>, g array<double>")
    sums = parts.agg(F.sum("n").alias("n"), sum_vector(F.col("s")).alias("s"), sum_vector(F.col("g")).alias("g"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, s, g in batch.itertuples(index=False):
                if n and n > 1:
                    s = np.asarray(s)
                    cov = (np.asarray(g).reshape(len(s), len(s)) - np.outer(s, s) / n) / (n - 1)
                    std = np.sqrt(np.maximum(np.diag(cov), 0))
                    yield pd.DataFrame({"variance_term": [np.maximum(0, gamma - std).mean()], "covariance_term": [((cov**2).sum() - (np.diag(cov) ** 2).sum()) / len(s)]})

    return sums.mapInPandas(finish, "variance_term double, covariance_term double")


def reassign_noise(rows: DataFrame, column: str = "token", label: str = "label") -> DataFrame:
    """VEC21: rows with label -1 get the cluster whose unit mean has the largest cosine (the smaller label on a tie)."""
    means = rows.where(F.col(label) >= 0).groupBy(F.col(label).alias("word")).agg(l2_normalised(mean_vector(F.col(column))).alias("centroid"))
    names, centres = matrix(means)
    shared = rows.sparkSession.sparkContext.broadcast((names, centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, c = shared.value
        for batch in batches:
            noise = (batch[label] < 0).to_numpy()
            if noise.any() and len(names):
                best = (kernels.unit_rows(_stack(batch.loc[noise, column])) @ c.T).argmax(1)
                batch.loc[noise, label] = names[best].astype(batch[label].dtype)
            yield batch

    return rows.mapInPandas(run, rows.schema)


def transport_cost(pairs: DataFrame, cost: DataFrame | None = None, eps: float = 0.05, iterations: int = 50, p: str = "p", q: str = "q", carry: Sequence[str] = ("pair_id",)) -> DataFrame:
    """VEC22: ``carry…, emd`` of pairs of histograms; without ``cost`` (``i, j, cost``) that is the normalised index distance."""
    table = None
    if cost is not None:
        n = cost.count()
        if n > MOST_VALUES:
            raise ValueError(f"{n} costs are too many to send to all tasks")
        rows = cost.orderBy("i", "j").collect()  # K x K
        k = int(round(len(rows) ** 0.5))
        table = np.array([r.cost for r in rows], np.float64).reshape(k, k)
    shared = pairs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = _stack(batch["_p"]), _stack(batch["_q"])
            c = shared.value if shared.value is not None else kernels.index_cost(a.shape[1])
            yield batch.drop(columns=["_p", "_q"]).assign(emd=kernels.sinkhorn(a, b, c, eps, iterations))

    source = pairs.select(*carry, F.col(p).cast("array<double>").alias("_p"), F.col(q).cast("array<double>").alias("_q"))
    return source.mapInPandas(run, source.drop("_p", "_q").schema.add("emd", "double"))
