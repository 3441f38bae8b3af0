"""The grid join of cells and boxes against all pairs, and a crowded image in linear time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import geometry as G

CELL, BOX = "image bigint, cell_row int, cell_col int, x0 double, y0 double, x1 double, y1 double", "image bigint, label int, x0 double, y0 double, x1 double, y1 double"


def area(r):
    return max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])


def pairs(cells, boxes):
    out = []
    for i, r, c, *a in cells:
        for j, label, *b in boxes:
            if i == j and a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]:
                both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
                union = area(a) + area(b) - both
                out.append((i, r, c, label, round(both / union, 9) if union > 0 else 0.0))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_all_pairs(spark, seed):
    """Boxes of any size and place: outside, touching, empty, turned over, far larger than all images; cells of one size, of mixed sizes, negative places."""
    rng = random.Random(seed)
    cells = [(i, r, c, 10.0 * c, 10.0 * r, 10.0 * c + 10, 10.0 * r + 10) for i in range(3) for r in range(6) for c in range(5)]
    if seed:
        cells += [(1, 100 + k, 0, *(x := (rng.uniform(-40, 40), rng.uniform(-40, 40))), x[0] + rng.choice([0, 0.5, 3, 900]), x[1] + rng.choice([0, 0.5, 3, 90])) for k in range(25)]
    boxes = [(rng.randrange(4), k % 7, *(x := (rng.choice([0.0, 10.0, rng.uniform(-30, 70)]), rng.uniform(-30, 70))), x[0] + rng.choice([0, 10, rng.uniform(-5, 30), 1e9]), x[1] + rng.choice([0, 10, rng.uniform(-5, 30), 1e12])) for k in range(120)]
    boxes += [boxes[0], (1, 9, None, 0.0, 1.0, 1.0), (None, 9, 0.0, 0.0, 5.0, 5.0)]
    got = G.overlaps(spark.createDataFrame(cells, CELL), spark.createDataFrame(boxes, BOX)).withColumn("iou", F.round("iou", 9)).collect()
    assert sorted(map(tuple, got)) == pairs(cells, [b for b in boxes if None not in b])


def test_nothing(spark):
    none = spark.createDataFrame([], CELL)
    assert G.overlaps(none, spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0)], BOX)).count() == 0
    assert G.overlaps(spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 1.0, 1.0)], CELL), spark.createDataFrame([], BOX)).count() == 0


def test_crowded_image(spark):
    """100,000 boxes and 100,000 cells in one image: ten billion pairs of which 300,000 or so meet."""
    side, n = 316, 100_000
    rng = np.random.default_rng(0)
    cells = spark.range(side * side).select(F.lit(1).cast("bigint").alias("image"), F.expr("cast(id div 316 as int)").alias("cell_row"), (F.col("id") % 316).cast("int").alias("cell_col"))
    cells = cells.select("*", *[(F.col(c) * 10.0 + d).alias(k) for k, c, d in (("x0", "cell_col", 0), ("y0", "cell_row", 0), ("x1", "cell_col", 10), ("y1", "cell_row", 10))])
    at, size = rng.uniform(0, 3100, (n, 2)), rng.uniform(1, 12, (n, 2))
    boxes = spark.createDataFrame([(1, 0, float(x), float(y), float(x + w), float(y + h)) for (x, y), (w, h) in zip(at, size)], BOX)
    span = lambda k: np.ceil((at[:, k] + size[:, k]) / 10).astype(int) - np.floor(at[:, k] / 10).astype(int)
    assert G.overlaps(cells, boxes).count() == int((span(0) * span(1)).sum())
