"""The stored inverted file: recall, what is read, cut lists, odd tables."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import retrieval as R


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/ivf-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 3, (12, 6))
    x = np.array([centres[i % 12 if i % 3 else 0] for i in range(900)]) + rng.normal(0, 0.7, (900, 6))  # one centre has a third of all
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    rows += [(900 + i, rows[i][1]) for i in range(5)]  # equal vectors
    return spark.createDataFrame(rows, "item_id bigint, embedding array<float>").repartition(5).cache()


@pytest.fixture(scope="module")
def queries(items):
    return items.where("item_id % 45 = 0").withColumnRenamed("item_id", "query_id")


def rows(df):
    return sorted((r.query_id, r.rank, r.item_id, round(r.score, 9)) for r in df.collect())


def test_all_lists_of_any_cut_are_exact(spark, items, queries, path):
    want = rows(R.top_k(queries, items, 10))
    R.write_ivf(items, path, 8, copies=2, most=40)
    parts = {r.list: r.parts for r in spark.read.parquet(f"{path}/centroids").collect()}
    assert max(parts.values()) > 3  # the hot list is cut
    assert rows(R.search_ivf(queries, path, 10, 8)) == want


def test_near_lists_are_enough(items, queries, path):
    want = {(q, i) for q, _, i, _ in rows(R.top_k(queries, items, 10))}
    R.write_ivf(items, path, 24)
    got = {(q, i) for q, _, i, _ in rows(R.search_ivf(queries, path, 10, 6))}
    assert len(got & want) >= 0.9 * len(want)


def test_other_lists_are_not_read(spark, items, path):
    R.write_ivf(items, path, 8)
    some = R.probed_items(spark, path, [1, 5])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    read = {r.f.rsplit("/", 2)[1] for r in some.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read <= {"list=1", "list=5"} and 0 < some.count() < items.count()


def test_odd_tables(spark, items, queries, path):
    R.write_ivf(items.limit(3), path, 8, copies=9)  # fewer items than lists, or than asked for
    found = R.search_ivf(queries, path, 10, 20)
    assert found.groupBy("query_id").count().where("count <> 3").count() == 0
    assert R.search_ivf(queries.where("false"), path, 10, 2).count() == 0


def test_quarter_of_the_lists(spark):
    """On nearly random vectors, the table that the bench reads, with the parameters of the query."""
    items = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    queries = items.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    want = {(q, i) for q, _, i, _ in rows(R.top_k(queries, items, 10))}
    got = {(q, i) for q, _, i, _ in rows(R.ivf_top_k(queries, items, 10, lists=128, probes=32, copies=3))}
    assert len(got & want) >= 0.9 * len(want)
