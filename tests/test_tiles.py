"""Tiles of images of many sizes, cut together (PIX1)."""

import numpy as np
import pytest

from cellspark.sources import files


@pytest.mark.parametrize(("tile", "stride", "most"), [(2, 2, 10**6), (3, 2, 10**6), (2, 3, 10**6), (5, 5, 1), (3, 1, 40)])
def test_tiles_of_mixed_sizes(spark, monkeypatch, tile, stride, most):
    monkeypatch.setattr(files, "TILE_VALUES", most)
    rng = np.random.default_rng(5)
    rows = [(f"i{i}", int(w), int(h), int(c), bytearray(rng.integers(0, 256, w * h * c).astype(np.uint8).tobytes())) for i, (w, h, c) in enumerate(zip(*[rng.integers(1, 8, 40), rng.integers(1, 8, 40), rng.choice([1, 3, 4], 40)]))]
    images = spark.createDataFrame(rows, "origin string, width int, height int, n_channels int, data binary")
    want = {
        (o, y // stride * -(-w // stride) + x // stride, x, y): ((files.pixel_block(bytes(d), w, h, c, x, y, tile) / 255.0 - 0.5) / 0.5).astype(np.float32).ravel().tolist()
        for o, w, h, c, d in rows
        for y in range(0, h, stride)
        for x in range(0, w, stride)
    }
    got = files.pixel_tiles(images, tile, stride).collect()
    assert len(got) == len(want) and {(r.origin, r.tile_idx, r.x, r.y): r.pixels for r in got} == want


def test_many_small_images_come_in_few_batches(spark, monkeypatch):
    images = spark.range(600).selectExpr("cast(id as string) AS origin", "3 AS width", "2 AS height", "3 AS n_channels", "unhex(repeat('07', 18)) AS data")
    # The function of the tasks, run here on one batch.
    run = []
    monkeypatch.setattr(type(images), "mapInArrow", lambda self, f, schema: run.append((self, f)))
    files.pixel_tiles(images, 2, 2)
    out = list(run[0][1](iter(run[0][0].toArrow().to_batches())))
    assert sum(b.num_rows for b in out) == 1200 and len(out) < 20


def test_data_of_another_size_fails(spark):
    images = spark.createDataFrame([("a", 2, 2, 3, bytearray(11))], "origin string, width int, height int, n_channels int, data binary")
    with pytest.raises(Exception, match="reshape"):
        files.pixel_tiles(images, 2, 2).collect()


def test_model_gets_batches_and_sends_no_pixels_back(spark, monkeypatch):
    images = spark.range(7).selectExpr("cast(id as string) AS origin", "3 AS width", "2 AS height", "3 AS n_channels", "unhex(repeat(lpad(hex(id), 2, '0'), 18)) AS data").coalesce(1)

    def make():
        return lambda frame: np.array([[len(frame), p[0]] for p in frame["pixels"]])

    out = files.index_rows(images, 2, 2, make, batch=5)
    assert out.columns == ["origin", "tile_idx", "x", "y", "embedding"]
    assert "pixels" not in out._jdf.queryExecution().optimizedPlan().output().mkString(",")
    rows = out.collect()
    assert sorted(r.embedding[0] for r in rows) == [4] * 4 + [5] * 10
    assert all(abs(r.embedding[1] - (int(r.origin) / 127.5 - 1)) < 1e-6 for r in rows)
    # What goes from Python to Spark.
    ran = []
    monkeypatch.setattr(type(out), "mapInPandas", lambda self, f, schema: ran.append(schema))
    monkeypatch.setattr(type(out), "drop", lambda self, *c: self)
    files.index_rows(images, 2, 2, make)
    assert ran[0].fieldNames() == ["origin", "tile_idx", "x", "y", "embedding"]
