"""Detection precision by threshold intervals and numbered predictions, against a greedy loop; positions against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from cellspark.operators import metrics as M
from cellspark.operators import sampling as S

GRID = (0.1, 0.3, 0.5, 0.75, 0.9)


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0


def greedy(preds, truths, t):
    """Predictions by score; the best truth of each, taken once; area under the envelope."""
    taken, hits = set(), []
    for i, image, _, _, *box in sorted(preds, key=lambda p: (-p[3], p[0])):
        scored = [(overlap(box, g[3:]), -g[0]) for g in truths if g[1] == image]
        v, g = max(scored, default=(0, 0))
        hits.append(v >= t and v > 0 and (image, g) not in taken)
        if hits[-1]:
            taken.add((image, g))
    points, tp = [(0.0, 0.0)], 0
    for n, hit in enumerate(hits, 1):
        tp += hit
        points.append((tp / (len(truths) + 1e-6), tp / (n + 1e-6)))
    area = 0.0
    for k in range(1, len(points)):
        area += (points[k][0] - points[k - 1][0]) * max(p for _, p in points[k:])
    return area if truths else 0.0


def made_up(seed, n):
    rng = random.Random(seed)
    box = lambda: (x := rng.uniform(0, 30), y := rng.uniform(0, 30), x + rng.uniform(1, 12), y + rng.uniform(1, 12))
    truths = [(i, rng.randrange(3), 1, *box()) for i in range(n)]
    preds = []
    for i in range(3 * n):
        g = rng.choice(truths)
        near = [v + rng.uniform(-2, 2) for v in g[3:]] if rng.random() < 0.8 else box()
        preds.append((i, g[1], 1, rng.choice([0.5, 0.5, 0.9, round(rng.random(), 2)]), *near))  # half of the scores are equal
    return preds, truths


@pytest.mark.parametrize("seed, n", [(0, 25), (1, 60), (2, 1)])
def test_against_a_greedy_loop(spark, seed, n):
    preds, truths = made_up(seed, n)
    p = spark.createDataFrame(preds, "pred_id bigint, image_id int, label int, score double, x0 double, y0 double, x1 double, y1 double").repartition(5)
    t = spark.createDataFrame(truths, "gt_id bigint, image_id int, label int, x0 double, y0 double, x1 double, y1 double").repartition(3)
    for ranges in (4096, 7):
        got = {r.threshold: r for r in M.average_precision(p, t, GRID, ranges=ranges).collect()}
        for at in GRID:
            assert abs(got[at].ap - greedy(preds, truths, at)) < 1e-9 and got[at].predictions == len(preds) and got[at].truths == n
    none = M.average_precision(p.where("false"), t, GRID).collect()
    assert [(r.predictions, r.truths, r.ap) for r in none] == [(0, n, 0.0)] * len(GRID)
    assert all(r.ap == 0 for r in M.average_precision(p, t.where("false"), GRID).collect())


def test_positions(spark):
    """Rows that are equal in the first column are split among tasks and still numbered through."""
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("a")).repartition(6)
    got = {r.id: r.place for r in S.positions(rows, [F.desc("a"), F.asc("id")], "place").collect()}
    order = sorted(range(5000), key=lambda i: (-(1 if i % 3 else i % 7), i))
    assert got == {i: n for n, i in enumerate(order, 1)}
    assert S.positions(rows.where("false"), [F.asc("id")], "place").count() == 0
