"""Principal components by a block Krylov method (VEC7): block products over the points, small factors on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.operators import kernels
from cellspark.operators.clustering import cluster_sums, vectors_of


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Columns that span what ``block`` adds to ``basis``; none if it adds nothing."""
    scale = np.abs(block).max(initial=0.0)
    for _ in range(2):  # once more for what rounding leaves
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    return u[:, s > 1e-10 * max(scale, 1e-300)]


def principal_components(rows: DataFrame, dims: int, column: str = "token", unit: bool = True, oversample: int = 8, rounds: int = 30, tolerance: float = 1e-9, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """VEC7: the mean of the vectors, and ``component, value, vector`` of their largest principal components (by sample covariance), best first.

    Vectors are brought to unit length first, unless ``unit`` is False. A pass multiplies the
    covariance by a block of ``dims + oversample`` directions: each batch gives its part of that
    product, which Spark adds up, so that no matrix of all dimensions squared is formed. The
    first block is random, each further one is the last product without what is known; once a
    component's residual is below ``tolerance`` times the largest value for all ``dims``, or the
    directions are complete, or after ``rounds``, the small problem on their span is solved. A
    vector's sign is that of its largest number. Fewer than two rows have no components.
    """
    points = rows.select(F.col(column).cast("array<double>").alias("_v"))
    fitted = (lambda x: kernels.unit_rows(x)) if unit else (lambda x: x)
    whole = cluster_sums(points, lambda x: np.concatenate(([len(x)], fitted(x).sum(0)))[None], 1, "_v")
    spark = rows.sparkSession
    kind = "component INT, value DOUBLE, vector ARRAY<DOUBLE>"
    n = whole[0, 0] if len(whole) else 0
    width = whole.shape[1] - 1
    mean = whole[0, 1:] / n if n else np.zeros(0)
    if n < 2:
        return mean, spark.createDataFrame([], kind)
    dims = min(dims, width)

    def product(block: np.ndarray) -> np.ndarray:
        found = cluster_sums(points, lambda x: (y := fitted(x)).T @ (y @ block), width, "_v")
        return (found - n * np.outer(mean, mean @ block)) / (n - 1)

    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    block = np.random.default_rng(seed).standard_normal((width, min(width, dims + oversample)))
    for _ in range(rounds):
        block = _orthonormal(block, basis)
        if not block.shape[1]:
            break
        image = product(block)
        basis, images = np.hstack((basis, block)), np.hstack((images, image))
        small = basis.T @ images
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1][:dims], turn[:, ::-1][:, :dims]
        residual = np.linalg.norm(images @ turn - basis @ turn * value, axis=0)
        if residual.max() <= tolerance * max(value[0], 1e-300):
            break
        block = image
    vectors = basis @ turn
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return mean, spark.createDataFrame([(i, float(max(v, 0.0)), vectors[:, i].tolist()) for i, v in enumerate(value)], kind)


def projected(rows: DataFrame, mean: np.ndarray, components: DataFrame, column: str = "token", unit: bool = True) -> DataFrame:
    """VEC7: replaces the vectors by their projections, brought to unit length before and after unless ``unit`` is False."""
    directions = np.array([r.vector for r in components.orderBy("component").collect()])  # as many rows as components
    shared = rows.sparkSession.sparkContext.broadcast((mean, directions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, directions = shared.value
        for batch in batches:
            if batch.num_rows:
                x = vectors_of(batch.column("_v"), batch.num_rows)
                y = ((kernels.unit_rows(x) if unit else x) - mean) @ directions.T
                y = kernels.unit_rows(y) if unit else y
                offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                names = [c for c in batch.schema.names if c != "_v"]
                yield pa.record_batch([*[batch.column(c) for c in names], pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], [*names, column])

    others = [c for c in rows.columns if c != column]
    source = rows.select(*others, F.col(column).cast("array<double>").alias("_v"))
    return source.mapInArrow(run, source.withColumnRenamed("_v", column).schema).select(*rows.columns)
