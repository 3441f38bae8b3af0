"""Principal components against numpy, and joins of stored tables without a shuffle."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import components as P
from cellspark.operators import joins as J
from cellspark.sources.sinks import write_joinable


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    return rng.normal(0, 1, (400, 30)) * (0.8 ** np.arange(30)) @ np.linalg.qr(rng.normal(0, 1, (30, 30)))[0] + 0.3


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(data)], "id bigint, token array<double>").repartition(5).cache()


@pytest.mark.parametrize("unit", [True, False])
@pytest.mark.parametrize("oversample", [0, 4, 100])
def test_components(rows, data, unit, oversample):
    x = data / np.linalg.norm(data, axis=1, keepdims=True) if unit else data
    value, vector = np.linalg.eigh(np.cov(x.T))
    mean, found = P.principal_components(rows, 5, unit=unit, oversample=oversample)
    found = found.orderBy("component").collect()
    np.testing.assert_allclose(mean, x.mean(0), atol=1e-9)
    np.testing.assert_allclose([r.value for r in found], value[::-1][:5], rtol=1e-6)
    cov = np.cov(x.T)
    for k, r in enumerate(found):
        v = np.array(r.vector)
        assert abs(abs(v @ vector[:, -1 - k]) - 1) < 1e-6 and v[np.abs(v).argmax()] > 0
        assert np.abs(cov @ v - r.value * v).max() < 1e-6


def test_projection(rows, data):
    mean, found = P.principal_components(rows, 4)
    out = {r.id: np.array(r.token) for r in P.projected(rows.withColumn("other", F.lit(1)), mean, found).collect()}
    x = data / np.linalg.norm(data, axis=1, keepdims=True)
    y = (x - x.mean(0)) @ np.array([r.vector for r in found.orderBy("component").collect()]).T
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert all(np.abs(out[i] - y[i]).max() < 1e-9 for i in range(len(y)))


def test_few_rows(spark, rows):
    assert P.principal_components(rows.where("false"), 3)[1].count() == 0 and P.principal_components(rows.where("id = 1"), 3)[1].count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id bigint, token array<double>")
    assert all(abs(r.value) < 1e-12 for r in P.principal_components(same, 2)[1].collect())


def test_stored_tables_join_where_they_are(spark, tmp_path):
    def store(kind, rows):
        return write_joinable(rows, f"{kind}_{uuid.uuid4().hex}", f"file://{tmp_path}/{kind}", buckets=6)

    cells = spark.range(300)
    manifest = store("manifest", cells.select(F.col("id").alias("cell_id"), F.concat(F.lit("p"), "id").alias("raw")))
    counts = store("counts", cells.where("id % 3 > 0").select(F.col("id").alias("cell_id"), (F.col("id") * 2).alias("n")))
    labels = store("labels", cells.where("id % 5 = 0").select(F.col("id").alias("cell_id"), F.lit(7).alias("label")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.training_table(manifest, counts, labels, "raw", 0.2)
        rows = {r.cell_id: r for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 2
    assert set(rows) == {i for i in range(300) if i % 3} and all(rows[i].n == 2 * i and rows[i].label == (7 if i % 5 == 0 else -1) for i in rows)
