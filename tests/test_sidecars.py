"""Files of sidecars stay small however many boxes there are (SRC3)."""

import pandas as pd
from conftest import SF, canonical

from cellspark.queries import ORACLES, files


def test_more_boxes_make_more_files(spark, duck, monkeypatch):
    monkeypatch.setattr(files, "BOXES", 60, raising=False)
    paths = []
    monkeypatch.setattr(files, "fresh", lambda s, name, f=files.fresh: paths.append(f(s, name)) or paths[-1])
    got = files.QUERIES["src3_annotations"](spark, SF)
    boxes = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    sizes = spark.read.text(paths[0], wholetext=True).selectExpr("size(from_json(value, 'array<string>')) AS n").toPandas().n
    assert len(sizes) >= 0.9 * boxes / 60 and sizes.max() < 60
    pd.testing.assert_frame_equal(canonical(got.toPandas()), canonical(duck.sql(ORACLES["src3_annotations"]).df()), check_dtype=False)
