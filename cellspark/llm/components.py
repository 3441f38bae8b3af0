"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.llm.storage import release, staged


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link each vertex's larger (``both_ways``) or all smaller neighbours, and in the second case itself, to its smallest neighbour."""
    seen = edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
    if both_ways:
        seen = seen.unionByName(edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = seen.join(least, "u")
    if both_ways:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("high"), F.col("m").alias("low"))
    else:
        out = joined.select(F.col("v").alias("high"), F.col("m").alias("low")).unionByName(least.select(F.col("u").alias("high"), F.col("m").alias("low")))
    return out.where(F.col("high") > F.col("low")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every vertex that has an edge.

    ``edges`` has two BIGINT columns ``a`` and ``b``; direction, loops, repeats and rows
    with a null are immaterial. Returns ``node``, ``root``: the smallest vertex reachable,
    for all vertices other than roots (a vertex without a row is its own root). Each round
    is staged in the shared folder, and the one before it deleted; nothing but two totals comes to the driver. Raises if
    the rounds, logarithmic in number, run out.
    """
    edges = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").cast("bigint").alias("high"), F.least("a", "b").cast("bigint").alias("low"))
        .distinct()
    )
    edges = staged(edges, "edges")
    before = None
    for _ in range(max_rounds):
        seal = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("h")).first()
        if seal.n == 0 or (seal.n, seal.h) == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
        before = (seal.n, seal.h)
        done, edges = edges, staged(_stars(_stars(edges, True), False), "edges")
        release(done)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of ``a`` and ``b``, edge by edge, in ``label``: for each index the smallest one of its set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up
