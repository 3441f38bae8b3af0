"""Every registered query of the library against its SQL twin, or for its invariants."""

import pandas as pd
import pytest
from conftest import SF, canonical

from cellspark.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = canonical(QUERIES[name](spark, SF).toPandas())
    want = canonical(duck.sql(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_triplets(spark):
    rows = QUERIES["geo10_triplets"](spark, SF).toPandas()
    many = rows.groupby("image").tile_idx.transform("count") > 1
    assert (rows.pos_tile != rows.tile_idx)[many].all()
    assert (rows.neg_image != rows.image).all()
    assert not rows.duplicated(["image", "tile_idx"]).any()


def test_learned(spark):
    assert QUERIES["vec9_bisecting"](spark, SF).toPandas()["n"].sum() == 500
    pca = QUERIES["vec7_pca"](spark, SF).toPandas()
    assert pca.token.map(lambda v: abs(sum(x * x for x in v) - 1) < 1e-6).all() and pca.token.map(len).eq(8).all()
    emd = QUERIES["vec22_transport"](spark, SF).toPandas()
    assert len(emd) == 31 and (emd.emd >= 0).all()
    ap = QUERIES["met7_multi_threshold_ap"](spark, SF).toPandas().sort_values("threshold")
    assert ap.ap.between(0, 1).all() and ap.ap.is_monotonic_decreasing
    words = QUERIES["anl13_diverse_words"](spark, SF).toPandas().words.str.split(",")
    assert words.map(lambda w: len(set(w)) == 6).all()


def test_ivf_recall(spark):
    ivf = QUERIES["ret2_ivf"](spark, SF).toPandas()
    exact = QUERIES["ret1_top_k"](spark, SF).toPandas()
    assert len(ivf.merge(exact, on=["query_id", "item_id"])) >= 0.9 * len(exact)


def test_metrics_of_every_row(spark):
    got = QUERIES["ret3_metrics"](spark, SF).toPandas()
    assert (got.queries == spark.read.parquet(f"{SF}/embeddings.parquet").count()).all() and len(got) == 3
