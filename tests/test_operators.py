"""Hand-worked cases, brute-force kernels, refusals and file formats."""

import bz2
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.functions import paths as P
from cellspark.functions.vectors import entropy
from cellspark.operators import geometry as G
from cellspark.operators import joins as J
from cellspark.operators import kernels as K
from cellspark.operators import metrics as M
from cellspark.operators import retrieval as R
from cellspark.operators import sampling as S
from cellspark.operators import vectors as X
from cellspark.sources import files, sinks
from cellspark.streaming.histograms import stream_histograms


def one(df):
    return df.first()


def test_paths(spark):
    d = spark.createDataFrame([("/home/u/data/fmow/train/a/x.jpg",), ("..//train/a/x.jpg",)], "p string")
    assert {r[0] for r in d.select(P.canonical_rel_path(F.col("p"))).collect()} == {"train/a/x.jpg"}
    e = spark.createDataFrame([("data/fmow/train/airport/airport_0/airport_0_0_rgb.jpg",)], "p string")
    assert one(e.select(P.cache_key(F.col("p"), F.lit("w.pth"), F.lit(None), F.lit(None))))[0] == "40cfa3e14926889461467318bc5949f507e25f45"
    b = spark.createDataFrame([("train/airport/airport_0/airport_0_0_rgb.jpg",), ("Hosted-Datasets/fmow/fmow-rgb/train/airport/airport_0/airport_0_0_rgb.jpg",), ("val/port/port_2/port_2_0_rgb.jpg",)], "p string")
    got = [r[0] for r in b.select(P.md5_bucket(F.col("p"))).collect()]
    assert got == [4665, 8955, 7039] == [int(hashlib.md5(r.p.encode()).hexdigest(), 16) % 10000 for r in b.collect()]
    f = spark.createDataFrame([(1, 0, 0, 0, 128, 128), (1, 1, 64, 0, 192, 128)], "k int, patch_pos int, x0 int, y0 int, x1 int, y1 int")
    assert one(P.patch_fingerprint(f, ["k"])).fingerprint == "e2e5fbaa9ebf6fa1dd9c0ce101e10a80126e9fa2"
    with pytest.raises(ValueError):
        P.shard(f, 3, 2)


def test_geometry(spark):
    d = spark.createDataFrame([(768,), (1280,), (100,)], "w int")
    assert [r[0] for r in d.select(G.resized(F.col("w"), 512)).collect()] == [1024, 1024, 512]
    im = spark.createDataFrame([(1, 1024, 512)], "image int, width int, height int")
    cells = G.cells(im, 512)
    assert G.patches(cells.select("image", "cell_row", "cell_col", "x0", "y0", "x1", "y1"), 512, 128, 64, 128).count() == 2 * 28
    with pytest.raises(Exception, match="multiple of the grid"):
        G.cells(spark.createDataFrame([(1, 1000, 512)], "image int, width int, height int"), 512).collect()
    ten = spark.createDataFrame([(1, 10, 4), (2, 3, 4)], "image int, width int, height int")
    assert [(r.image, r.x0) for r in G.sliding_windows(ten, 4, 3).orderBy("x0").collect()] == [(1, 0), (1, 3), (1, 6)]
    with pytest.raises(ValueError):
        G.sliding_windows(ten, 0, 1)
    tiles = G.covering_tiles(spark.createDataFrame([(1, 10, 10)], "image int, width int, height int"), 4, 4).orderBy("tile_idx").collect()
    assert len(tiles) == 9 and (tiles[-1].valid_w, tiles[-1].valid_h) == (2, 2) and [t.tile_idx for t in tiles] == list(range(9))
    cell = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0)], "image int, cell_row int, cell_col int, x0 double, y0 double, x1 double, y1 double")
    box = spark.createDataFrame([(1, 7, 5.0, 5.0, 15.0, 15.0)], "image int, label int, x0 double, y0 double, x1 double, y1 double")
    assert one(G.overlaps(cell, box)).iou == pytest.approx(25 / 175)
    small = spark.createDataFrame([(1, 7, 0.0, 0.0, 1.0, 3.0)] * 2, box.schema)
    r = one(G.assign_labels(cell, small, 0.05))
    assert r.dominant == -1 and r.multi_hot[7] == 1 and sum(r.multi_hot) == 1
    four = spark.createDataFrame([(1, r, c) for r in (0, 1) for c in (0, 1)], "image int, cell_row int, cell_col int")
    assert G.adjacent_pairs(four).count() == 4


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_sampling(spark, parts):
    rows = spark.createDataFrame([(f"{c}{i}", c) for c, n in (("a", 5), ("b", 1), ("c", 4)) for i in range(n)], "k string, c string").repartition(parts)
    got = S.sample_stratified(rows, "c", "k", 7).collect()
    assert len(got) == 7 and sorted(r.k for r in got) == sorted(r.k for r in S.sample_stratified(rows.coalesce(1), "c", "k", 7).collect())
    assert S.sample_stratified(rows, "c", "k", 99).count() == 10
    two = spark.createDataFrame([(i, "x" if i < 10 else "y") for i in range(13)], "k int, c string").repartition(parts)
    assert {r.c: r["count"] for r in S.sample_fraction(two, "c", "k", 0.25).groupBy("c").count().collect()} == {"x": 2, "y": 1}
    nine = spark.createDataFrame([(i, "x" if i < 5 else "y") for i in range(9)], "k int, c string").repartition(parts)
    assert sorted(r["count"] for r in S.stratified_folds(nine, "c", "k", 2).groupBy("fold").count().collect()) == [4, 5]
    with pytest.raises(ValueError):
        S.stratified_folds(nine, "c", "k", 1)
    t = spark.createDataFrame([(c, p) for c in range(3) for p in range(4)], "cell_id int, pos int").repartition(parts)
    assert S.subsample_tokens(t, 7).count() == 6
    assert S.subsample_tokens(t, 2).count() == 2


def vec(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("parts", [1, 4])
def test_vectors(spark, parts):
    words = vec(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])], "word int, centroid array<double>")
    tokens = vec(spark, [(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "cell_id bigint, pos int, token array<double>").repartition(parts)
    assert one(X.soft_histograms(tokens, words)).histogram == pytest.approx([0.666652, 0.333348], abs=1e-6)
    three = vec(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "word int, centroid array<double>")
    assert all(r.cost == (0 if r.i == r.j else 1) for r in X.ground_cost(three).collect())
    h = vec(spark, [(1, [0.5, 0.5, 0.0, 0.0])], "cell_id bigint, histogram array<double>")
    s = one(X.histogram_stats(h))
    assert s.entropy_mean == pytest.approx(0.693147, abs=1e-6) and s.empty_bins == 2
    pts = [(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [10.0]), (3, 1, [11.0])]
    for extra in ([], [(4, -1, [5.0])]):
        got = one(X.silhouette(vec(spark, pts + extra, "id bigint, label int, v array<double>").repartition(parts)))
        assert got.silhouette == pytest.approx(0.899749, abs=1e-6) and got.n == 4
    assert one(X.silhouette(vec(spark, pts[:2], "id bigint, label int, v array<double>"))).silhouette is None
    t = vec(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "cell_id bigint, target array<double>")
    assert one(X.target_diversity(t)).mean_cosine == pytest.approx(1 / 3)
    u = [1 / 3] * 3
    pairs = vec(spark, [(0, u, u), (1, [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]), (2, [0.5, 0.5, 0.0], [0.0, 0.5, 0.5])], "pair_id int, p array<double>, q array<double>")
    assert [r.emd for r in X.transport_cost(pairs).orderBy("pair_id").collect()] == pytest.approx([0.00003, 1.0, 0.5], abs=1e-4)
    nan = vec(spark, [(1, [1.0, float("nan")]), (2, [1.0, 2.0])], "id int, token array<double>")
    assert [r.id for r in X.without_nan(nan).collect()] == [2]
    with pytest.raises(Exception, match="NaN"):
        X.refuse_nan(nan).collect()


def test_numbered_and_kmeans(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    assert all(r.k == r.n for r in X.numbered(rows, "k", "n").collect())
    assert X.numbered(rows.limit(0), "k", "n").count() == 0
    rng = np.random.default_rng(0)
    centres = np.eye(4)[:3] * 5
    pts = [(i, [float(x) for x in centres[i % 3] + rng.normal(0, 0.1, 4)]) for i in range(90)]
    tokens = vec(spark, pts, "id bigint, token array<double>")
    words, error = X.kmeans(tokens, 3, iterations=10, restarts=2)
    assert error < 0.1
    a = {r.id: r.word for r in X.assign(tokens, words, carry=("id",)).collect()}
    assert all(a[i] == a[i % 3] for i in a) and len(set(a.values())) == 3
    noisy = tokens.select("token", F.when(F.col("id") > 80, -1).otherwise(F.col("id") % 3).cast("int").alias("label"), "id")
    assert all(r.label == r.id % 3 for r in X.reassign_noise(noisy).collect())


def test_kernels():
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(50, 8)), rng.normal(size=(5, 8))
    at, d = K.nearest(x, c)
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and np.allclose(d, full.min(1))
    grid = np.arange(16.0)[:, None]
    assert K.pool_2x2(grid, 4).ravel().tolist() == [2.5, 4.5, 10.5, 12.5]
    p, q = rng.dirichlet(np.ones(6), 4), rng.dirichlet(np.ones(6), 4)
    cost = K.index_cost(6)
    exact = np.abs(np.cumsum(p - q, axis=1)).sum(1) / 5  # transport on a line
    assert np.allclose(K.sinkhorn(p, q, cost, 0.005, 2000), exact, atol=0.02)
    assert K.diverse_words(np.array([0.5, 0.3, 0.2]), np.array([[1.0, 1.0, 0.0], [0.0, 0.0, 1.0]]), 2) == [0, 2]


def test_retrieval_and_metrics(spark):
    items = vec(spark, [(1, 1, [0.9]), (2, 0, [0.8]), (3, 0, [0.7])], "item_id bigint, label int, embedding array<double>")
    q = vec(spark, [(9, 0, [1.0])], "query_id bigint, label int, embedding array<double>")
    m = {r.k: (r.recall, r.map) for r in R.retrieval_metrics(R.top_k(q, items, 3), q, items, (1, 3)).collect()}
    assert m[1] == (0, 0) and m[3][0] == 1 and m[3][1] == pytest.approx(0.583333, abs=1e-6)
    c = one(M.classification(vec(spark, [(0, 0), (0, 1), (1, 1)], "y_true int, y_pred int")))
    assert c.top1 == pytest.approx(66.67, abs=0.01) and c.precision == 75 and c.recall == 75 and c.f1 == pytest.approx(66.67, abs=0.01)
    b = vec(spark, [(1, i, x) for i, x in enumerate([3, 5, 5, 3])], "image int, pos int, label int")
    assert one(M.majority_label(b)).label == 3
    px = [(0, 0.9, 255)] * 3 + [(0, 0.9, 0)] + [(0, 0.1, 255)] * 2
    got = M.pixel_change(vec(spark, px, "batch_id int, pred_prob double, mask int")).collect()
    assert all((r.precision, r.recall, r.f1, r.iou) == pytest.approx((0.75, 0.6, 0.666667, 0.5), abs=1e-5) for r in got)
    # IoU .8, .6 with the first truth and .55 with the second, by boxes of height 1.
    truths = vec(spark, [(1, 1, 1, 0.0, 0.0, 10.0, 1.0), (1, 2, 1, 100.0, 0.0, 110.0, 1.0)], "image_id int, gt_id bigint, label int, x0 double, y0 double, x1 double, y1 double")
    preds = vec(spark, [(1, 1, 0.9, 1, 0.0, 0.0, 8.0, 1.0), (1, 2, 0.8, 1, 0.0, 0.0, 6.0, 1.0), (1, 3, 0.7, 1, 100.0, 0.0, 105.5, 1.0)], "image_id int, pred_id bigint, score double, label int, x0 double, y0 double, x1 double, y1 double")
    assert [r.tp for r in M.matched(preds, truths, (0.5,)).orderBy("pred_id").collect()] == [1, 0, 1]
    assert one(M.average_precision(preds, truths)).ap == pytest.approx(0.833333, abs=1e-4)
    assert one(M.average_precision(preds.limit(0), truths)).ap == 0
    assert one(M.average_precision(preds, truths.limit(0))).ap == 0
    with pytest.raises(ValueError):
        M.matched(preds, truths, (1.0,))
    logs = vec(spark, [("l", "Recall@5: 0.1234 ± 0.0123 | mAP@5: 0.5678 ± 0.0456"), ("n", "none")], "log string, text string")
    assert {(r.log, r.metric): r.value for r in M.parse_logs(logs).collect()} == {("l", "recall_at_5"): 0.1234, ("l", "recall_at_5_std"): 0.0123, ("l", "map_at_5"): 0.5678, ("l", "map_at_5_std"): 0.0456}


def test_files(spark, tmp_path):
    with bz2.open(tmp_path / "list.json.bz2", "wt") as f:
        json.dump(["train/a/x/1_rgb.jpg", "val/b/y/2_rgb.jpg"], f)
    assert [(r.pos, r.path) for r in files.read_file_list(spark, str(tmp_path / "list.json.bz2")).collect()] == [(0, "train/a/x/1_rgb.jpg"), (1, "val/b/y/2_rgb.jpg")]
    (tmp_path / "a.json").write_text(json.dumps([{"img_path": "i", "json_path": "j"}]))
    (tmp_path / "b.json").write_text(json.dumps({"k": 3, "cells": [{"image_path": "i", "cell_row": 1, "coords": [0.5, 1.5, 2.5, 3]}, {"image_path": "i", "coords": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}}, {"image_path": "i", "cell_x0": 1, "cell_y0": 2, "cell_x1": 3, "cell_y1": 4}]}))
    assert one(files.read_manifest(spark, str(tmp_path / "a.json"))).img_path == "i"
    assert [(r.cell_id, r.x0, r.y0, r.x1, r.y1) for r in files.read_manifest(spark, str(tmp_path / "b.json")).collect()] == [(0, 0, 2, 2, 3), (1, 1, 2, 3, 4), (2, 1, 2, 3, 4)]
    (tmp_path / "s.json").write_text(json.dumps({"img_width": 10, "img_height": 20, "bounding_boxes": [{"category": "zoo", "box": [1, 2, 3, 4]}, {"category": "zoo", "box": [1, 2, 3, 4], "raw_location": "x"}, {"category": "nope", "box": [0, 0, 1, 1]}]}))
    assert [(r.label, r.bx, r.bh) for r in files.read_annotations(spark, str(tmp_path / "s.json")).collect()] == [(0, 1.0, 4.0)]
    (tmp_path / "img").mkdir()
    for n in ("a.JPG", "b.png", "c.txt"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert files.list_files(spark, str(tmp_path / "img")).count() == 2
    (tmp_path / "t.csv").write_text("label,merged_label,example_path\nMining,Other,e1\nNope,Other,e2\nLogging,Other,\n")
    assert [(r.path, r.label) for r in files.read_split_csv(spark, str(tmp_path / "t.csv"), "12", "/d").collect()] == [("/d/e1/images/visible/composite.png", 7)]
    (tmp_path / "split.txt").write_text("# c\n\nport\\x.jpg extra\nzoo/y.jpg\n")
    classes = P.label_by_name(vec(spark, [("port",), ("zoo",)], "category string"))
    assert {(r.item, r.label) for r in files.read_split_list(spark, str(tmp_path / "split.txt"), classes).collect()} == {("port/x.jpg", 0), ("zoo/y.jpg", 1)}
    (tmp_path / "bad.txt").write_text("nowhere\n")
    with pytest.raises(Exception, match="bad split line"):
        files.read_split_list(spark, str(tmp_path / "bad.txt"), classes).collect()
    (tmp_path / "yolo").mkdir()
    (tmp_path / "yolo" / "im1.txt").write_text("0 0.5 0.5 0.2 0.4\n1 2 2 0.1 0.1\n")
    r = one(files.read_yolo(spark, str(tmp_path / "yolo"), 100, 50))
    assert (r.stem, r.label, r.x0, r.y0, r.x1, r.y1) == ("im1", 1, 40.0, 15.0, 60.0, 35.0)


def test_stores(spark, tmp_path):
    rows = vec(spark, [(i, [float(i)]) for i in range(50)], "key bigint, v array<double>")
    sinks.write_vectors(rows, str(tmp_path / "v"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 50
    h = rows.select(F.col("key").alias("cell_id"), F.col("v").alias("histogram"))
    sinks.write_histograms(h.repartition(5), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 50
    old = vec(spark, [(8, {"a": 1.0}), (4, {"b": 2.0})], "k int, metrics map<string,double>")
    new = vec(spark, [(8, {"c": 3.0})], "k int, metrics map<string,double>")
    table = sinks.upsert_results(old, new)
    sinks.write_summary_csv(table, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True)
    assert back.columns == ["k", "b", "c"] and back.count() == 2


def test_resume_and_stream(spark, tmp_path):
    words = vec(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])], "word int, centroid array<double>")
    cells = vec(spark, [(i, [[1.0, float(i)], [0.5, 1.0]]) for i in range(6)], "cell_id bigint, tokens array<array<float>>")
    cells.where("cell_id < 3").write.parquet(str(tmp_path / "in"))
    run = lambda: stream_histograms(spark, str(tmp_path / "in"), words, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    cells.where("cell_id > 1").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {r.cell_id: r.histogram for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.cell_id: r.histogram for r in X.soft_histograms_by_cell(cells, words).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6 and all(got[k] == pytest.approx(want[k]) for k in want)
    assert J.append_resumed(cells.where("cell_id < 3"), cells, ["cell_id"]).count() == 6


def png(path, pixels):
    """A minimal PNG of 8-bit RGB rows."""
    import struct
    import zlib

    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pixels(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (5, 7, 3))
    for d in ("a", "b", "l"):
        (tmp_path / d).mkdir()
        png(tmp_path / d / "x.png", a if d == "a" else 255 - a)
    images = files.read_images(spark, str(tmp_path / "a"))
    tiles = {r.tile_idx: np.array(r.pixels).reshape(4, 4, 3) for r in files.pixel_tiles(images, 4, 4).collect()}
    assert len(tiles) == 4
    assert np.allclose(tiles[0], (a[:4, :4] / 255 - 0.5) / 0.5, atol=1e-6) and np.allclose(tiles[3][1:], -1)
    made = files.index_rows(images, 4, 4, lambda: lambda frame: np.array([[np.mean(p)] for p in frame["pixels"]]))
    assert made.count() == 4
    with pytest.raises(Exception, match="NaN"):
        files.index_rows(images, 4, 4, lambda: lambda frame: np.full((len(frame), 1), np.nan)).collect()
    both = files.aligned_patches(images, files.read_images(spark, str(tmp_path / "b")), files.read_images(spark, str(tmp_path / "l")), 3, 2).collect()
    assert len(both) == 2 * 3
    r = next(r for r in both if (r.x, r.y) == (2, 0))
    assert np.array_equal(np.array(r.a).reshape(3, 3, 3), a[:3, 2:5]) and np.array_equal(np.array(r.changed).reshape(3, 3), (255 - a[:3, 2:5, 0] > 127).astype(int))


def test_entropy_modes(spark):
    d = spark.createDataFrame([([0.5, 0.5, 0.0],)], "h array<double>")
    r = one(d.select(entropy(F.col("h")).alias("a"), entropy(F.col("h"), False).alias("b")))
    assert r.a == pytest.approx(np.log(2), abs=1e-8) and r.b == pytest.approx(np.log(2), abs=1e-8)
