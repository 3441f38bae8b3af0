"""Best pairs by blocks of scores, in bounded memory (RET1, RET4)."""

import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import kernels as K
from cellspark.operators import retrieval as R


def brute(queries, items, ids, k, folds=None):
    out = []
    for i, q in enumerate(queries):
        score = [(-round(float(q @ v), 9), ids[j], j) for j, v in enumerate(items) if folds is None or folds[0][i] != folds[1][j]]
        out += [(i, j, -s) for s, _, j in sorted(score)[:k]]
    return out


@pytest.mark.parametrize("scores", [1, 600, 10**6])
@pytest.mark.parametrize("folded", [False, True])
def test_best_pairs_against_a_loop(monkeypatch, scores, folded):
    monkeypatch.setattr(K, "SCORES", scores)
    rng = np.random.default_rng(2)
    items = np.concatenate((rng.integers(-2, 3, (60, 3)) / 4, rng.normal(size=(60, 3)))).repeat(2, 0)
    ids, queries = rng.permutation(len(items)), items[::5] + 1e-11
    folds = (np.arange(len(queries)) % 2, np.arange(len(items)) % 2 * (np.arange(len(items)) < 230)) if folded else None
    for k in (1, 7, 500):
        row, column, score = K.best_pairs(queries, items, ids, k, folds, step=10)
        want = brute(queries, items, ids, k, folds)
        assert [(a, b) for a, b in zip(row, column)] == [(a, b) for a, b, _ in want]
        assert np.allclose(score, [s for *_, s in want], atol=2e-9)


def test_memory_does_not_grow_with_pairs():
    x = np.random.default_rng(1).normal(size=(30_000, 4)).astype(np.float32)
    fold = np.arange(len(x)) % 5
    tracemalloc.start()
    K.best_pairs(x[:2000], x, np.arange(len(x)), 10, (fold[:2000], fold))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6  # all scores of 1024 queries, as before: 250 MB, twice


def test_few_copies_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(R, "LEAST_ITEMS", 10)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(200).select(F.col("id").alias("item_id"), (F.col("id") % 5).cast("int").alias("fold"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
        found = R.top_k(rows.withColumnRenamed("item_id", "query_id"), rows, 3, exclude_fold=True)
        plan = found._jdf.queryExecution().analyzed().toString()
        sent = [int(x) + 1 for x in re.findall(r"Generate explode\(sequence\(0, (\d+)", plan)]
        assert len(sent) == 2 and sum(sent) <= 8  # four by four; one block of queries would be sent to sixteen
        v = np.column_stack((np.sin(np.arange(200.0)), np.cos(np.arange(200.0))))
        got = {(r.query_id, r.item_id) for r in found.collect()}
        assert got == {(a, b) for a, b, _ in brute(v, v, np.arange(200), 3, (np.arange(200) % 5,) * 2)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
