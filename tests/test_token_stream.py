"""Cells whose tokens arrive in many files: the batch's histograms, once each, across restarts, repeats and expiry."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from cellspark.operators.vectors import soft_histograms
from cellspark.streaming.histograms import SETTINGS, stream_token_histograms


@pytest.fixture
def place(tmp_path):
    return [f"file://{tmp_path}/{x}-{uuid.uuid4().hex}" for x in ("tokens", "out", "progress")]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = spark.range(48).select((F.col("id") % 6).alias("cell_id"), F.expr("cast(id div 6 as int)").alias("pos"), F.array(F.sin(F.col("id") * 1.3), F.cos(F.col("id") * 0.7), F.lit(0.3)).alias("token"))
    return rows.cache()


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.2]), (2, [-1.0, 0.1, 0.4])], "word int, centroid array<double>")


def result(spark, out):
    rows = spark.read.parquet(out).collect()
    assert len({r.cell_id for r in rows}) == len(rows)
    return {r.cell_id: r for r in rows}


def run(spark, place, words, size=8, **more):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    assert stream_token_histograms(spark, place[0], words, place[1], place[2], size, **more).awaitTermination(200)
    assert {k: spark.conf.get(k) for k in SETTINGS} == before


def test_cells_over_files_and_runs(spark, tokens, words, place):
    """Half of the tokens, then some of them again and the rest, then all of them once more."""
    batch = {r.cell_id: r.histogram for r in soft_histograms(tokens, words).collect()}
    tokens.where("pos < 4 or cell_id = 5").repartition(3).write.mode("append").parquet(place[0])
    run(spark, place, words, max_files=1)
    assert set(result(spark, place[1])) == {5}
    odd = spark.createDataFrame([(0, None, [1.0, 1.0, 1.0]), (0, 3, None), (None, 1, [1.0, 1.0, 1.0])], "cell_id bigint, pos int, token array<double>")
    tokens.where("pos > 2").unionByName(odd).repartition(2).write.mode("append").parquet(place[0])
    run(spark, place, words)
    tokens.write.mode("append").parquet(place[0])
    run(spark, place, words)
    got = result(spark, place[1])
    assert set(got) == set(batch) and all(r.complete and r.tokens == 8 for r in got.values())
    for cell, h in batch.items():
        assert max(abs(a - b) for a, b in zip(h, got[cell].histogram)) < 1e-9


def test_expiry(spark, tokens, words, place):
    """A cell that waits too long is given out as it is, and what comes later starts nothing while it is remembered."""
    some = tokens.where("cell_id = 0 and pos < 3")
    some.write.mode("append").parquet(place[0])
    run(spark, place, words, expire=20_000)
    time.sleep(21)
    tokens.where("cell_id = 1").write.mode("append").parquet(place[0])
    run(spark, place, words, expire=20_000)
    tokens.where("cell_id = 0 and pos > 2").write.mode("append").parquet(place[0])
    run(spark, place, words, expire=20_000)
    got = result(spark, place[1])
    assert set(got) == {0, 1} and not got[0].complete and got[0].tokens == 3 and got[1].complete
    (batch,) = soft_histograms(some, words).collect()
    assert max(abs(a - b) for a, b in zip(batch.histogram, got[0].histogram)) < 1e-9
