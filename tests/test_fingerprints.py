"""Fingerprints of cells without a row for each patch (PRJ9)."""

from conftest import SF
from pyspark.sql import functions as F

from cellspark.functions import paths as P
from cellspark.operators import geometry as G
from cellspark.queries import QUERIES

KEY = ["image", "cell_row", "cell_col"]


def test_equal_to_patches_as_rows(spark):
    images = spark.createDataFrame([(1, 96, 64), (2, 32, 32), (2, 32, 32), (3, 64, 32)], "image bigint, width int, height int")
    cells = G.cells(images, 32)
    for patch, across, down in ((8, 4, 8), (32, 5, 5), (5, 9, 3)):
        rows = G.patches(cells.select(*KEY, "x0", "y0", "x1", "y1"), 32, patch, across, down)
        want = sorted(P.patch_fingerprint(rows, KEY).collect())
        assert sorted(P.cell_fingerprint(cells, KEY, 32, patch, across, down).collect()) == want
    assert P.cell_fingerprint(cells, KEY, 32, 64, 8, 8).count() == 0


def test_no_patch_is_shuffled(spark):
    plan = QUERIES["prj9_fingerprint"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Generate explode") == 2  # rows and columns of cells
