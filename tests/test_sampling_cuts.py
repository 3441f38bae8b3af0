"""Exact samples by cuts of hash ranges: the same rows as a full sort, without one."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cellspark.operators import sampling as S


def h(seed, *keys):
    return hashlib.md5(":".join([str(seed), *map(str, keys)]).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    """One class holds two thirds of the rows, one class is null, one has a single row."""
    label = F.when(F.col("id") == 7, "one").when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), (F.col("id") % 5).cast("string")))
    return spark.range(20_000).select(F.col("id").alias("key"), label.alias("label"), (F.col("id") % 11).alias("_quota"), F.lit(1).alias("h")).repartition(7)


@pytest.mark.parametrize("n", [0, 1, 2, 777, 19_999, 20_000, 30_000])
def test_first_by_hash(rows, n):
    got = [r.key for r in S.subsample(rows, "key", n).collect()]
    assert sorted(got) == sorted(sorted(range(20_000), key=lambda k: h(42, k))[:n])


@pytest.mark.parametrize("n", [3, 6, 8, 500, 19_000])
def test_stratified(rows, n):
    """Quotas first, in class order, then the rest by hash, as a full sort gives it."""
    got = sorted(r.key for r in S.sample_stratified(rows, "label", "key", n).collect())
    by_class = {}
    for r in rows.select("key", "label").collect():
        by_class.setdefault(r.label, []).append(r.key)
    names = sorted(by_class, key=lambda c: (c is not None, c or ""))
    quota = max(1, n // len(names))
    extra = max(0, n - quota * len(names))
    first, rest = [], []
    for i, c in enumerate(names):
        order = sorted(by_class[c], key=lambda k: h(42, k))
        cut = min(len(order), quota + (i < extra))
        first += order[:cut]
        rest += order[cut:]
    want = sorted(first, key=lambda k: h(42, k))[:n] if len(first) >= n else first + sorted(rest, key=lambda k: h(42, k))[: n - len(first)]
    assert got == sorted(want)


def test_cuts_by_group(spark, rows):
    quotas = spark.createDataFrame([("hot", 100), (None, 3), ("one", 1), ("c0", 10**6), ("c1", 0)], "label string, _quota int")
    cuts = {r.label: r._cut for r in S.hash_cuts(rows, ["label"], S.hash_order(1, "key"), "key", quotas).collect()}
    assert set(cuts) == {"hot", None, "one"}
    for label, n in (("hot", 100), (None, 3), ("one", 1)):
        keys = [r.key for r in rows.where(F.col("label").eqNullSafe(F.lit(label))).collect()]
        assert tuple(cuts[label]) == sorted((h(1, k), k) for k in keys)[n - 1]


@pytest.mark.parametrize("target", [0, 5, 40, 1000])
def test_tokens(spark, target):
    tokens = spark.range(600).select((F.col("id") % 50).alias("cell_id"), F.expr("id div 50").alias("pos")).repartition(5)
    got = sorted(map(tuple, S.subsample_tokens(tokens, target).collect()))
    quota = max(1, target // 50)
    cells = sorted(range(50), key=lambda c: h(42, c))[: target if quota * 50 > target else 50]
    assert got == sorted((c, p) for c in cells for p in sorted(range(12), key=lambda p: h(42, c, p))[:quota])


def test_no_rows_are_sorted(rows):
    """The plan of a sample is a filter over the source."""
    plan = S.subsample(rows, "key", 500)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and "Window" not in plan
