"""Queries on grids, boxes and pixels (GEO, PRJ9, SRC7, MET2, MET5-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellspark.functions import paths as P
from cellspark.operators import geometry as G
from cellspark.operators import metrics as M
from cellspark.plans import views as V
from cellspark.plans.views import with_
from cellspark.sources.files import yolo_boxes

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _images(spark, sf_dir):
    return V.images(spark, sf_dir).select("image", "width", "height")


def _raw(spark, sf_dir):
    return V.images(spark, sf_dir).select("image", F.col("raw_w").alias("width"), F.col("raw_h").alias("height"))


def _cells(spark, sf_dir):
    return G.cells(_images(spark, sf_dir), 512)


@_query("geo1_resized", f"{with_('images')} SELECT image, greatest(512, round_even(raw_w / 512, 0) * 512)::INT AS w, greatest(512, round_even(raw_h / 512, 0) * 512)::INT AS h FROM images")
def geo1(spark, sf_dir):
    return _raw(spark, sf_dir).select("image", G.resized(F.col("width"), 512).alias("w"), G.resized(F.col("height"), 512).alias("h"))


_PATCHES = "p AS (SELECT image, cell_row, cell_col, (dy * 7 + dx)::INT AS patch_pos, (x0 + dx * 64)::INT AS x0, (y0 + dy * 128)::INT AS y0, (x0 + dx * 64 + 128)::INT AS x1, (y0 + dy * 128 + 128)::INT AS y1 FROM (SELECT *, unnest(range(7)) AS dx FROM (SELECT *, unnest(range(4)) AS dy FROM cells)))"


def _patches(spark, sf_dir):
    return G.patches(_cells(spark, sf_dir).select("image", "cell_row", "cell_col", "x0", "y0", "x1", "y1"), 512, 128, 64, 128)


@_query("geo2_patches", f"{with_('images', 'cells')}, {_PATCHES} SELECT * FROM p")
def geo2(spark, sf_dir):
    return _patches(spark, sf_dir)


@_query("prj9_fingerprint", f"{with_('images', 'cells')}, {_PATCHES}, h AS (SELECT *, [x0, y0, x1, y1] AS v FROM p), x AS (SELECT image, cell_row, cell_col, patch_pos, list_aggregate(list_transform(v, lambda i: printf('%02x%02x%02x%02x', i & 255, (i >> 8) & 255, (i >> 16) & 255, (i >> 24) & 255)), 'string_agg', '') AS hx FROM h) SELECT image, cell_row, cell_col, sha1(unhex(string_agg(hx, '' ORDER BY patch_pos))) AS fingerprint FROM x GROUP BY image, cell_row, cell_col")
def prj9(spark, sf_dir):
    return P.cell_fingerprint(_cells(spark, sf_dir), ["image", "cell_row", "cell_col"], 512, 128, 64, 128)


@_query("geo3_windows", f"{with_('images')} SELECT image, (y * 200)::INT AS y0, (x * 200)::INT AS x0 FROM (SELECT *, unnest(range(greatest(0, (raw_w - 400) // 200 + 1))) AS x FROM (SELECT *, unnest(range(greatest(0, (raw_h - 400) // 200 + 1))) AS y FROM images WHERE raw_h >= 400) WHERE raw_w >= 400)")
def geo3(spark, sf_dir):
    return G.sliding_windows(_raw(spark, sf_dir), 400, 200).select("image", "y0", "x0")


@_query(
    "geo4_tiles",
    f"""{with_('images')} SELECT image, (r * ceil(raw_w / 300) + c)::INT AS tile_idx, (c * 300)::INT AS x, (r * 300)::INT AS y, least(300, raw_w - c * 300)::INT AS valid_w, least(300, raw_h - r * 300)::INT AS valid_h
FROM (SELECT *, unnest(range(ceil(raw_w / 300)::INT)) AS c FROM (SELECT *, unnest(range(ceil(raw_h / 300)::INT)) AS r FROM images))""",
)
def geo4(spark, sf_dir):
    return G.covering_tiles(_raw(spark, sf_dir), 300, 300).select("image", "tile_idx", "x", "y", "valid_w", "valid_h")


@_query(
    "geo5_corners",
    f"""{with_('images', 'boxes')}, j AS (SELECT b.image, b.pos, b.part, b.supp, bx, by_, bw, bh, width / raw_w AS sx, height / raw_h AS sy, 1024.0::DOUBLE / greatest(raw_w, raw_h) AS s FROM boxes b JOIN images i ON i.image = b.image)
SELECT image, pos, part, supp, round(bx * sx, 6) AS x0, round(by_ * sy, 6) AS y0, round((bx + bw) * sx, 6) AS x1, round((by_ + bh) * sy, 6) AS y1, round(s, 6) AS edge_scale FROM j""",
)
def geo5(spark, sf_dir):
    im = V.images(spark, sf_dir).select("image", F.col("raw_w").alias("width"), F.col("raw_h").alias("height"), F.col("width").alias("to_w"), F.col("height").alias("to_h"))
    rows = G.corners(V.boxes(spark, sf_dir).drop("x0", "y0", "x1", "y1").join(im, "image"), F.col("to_w"), F.col("to_h"))
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select("image", "pos", "part", "supp", r("x0"), r("y0"), r("x1"), r("y1"), F.round(G.longest_edge_scale(F.col("width"), F.col("height"), 1024), 6).alias("edge_scale"))


_IOU = """o AS (SELECT c.image, c.cell_row, c.cell_col, b.label, greatest(0, least(c.x1, b.x1) - greatest(c.x0, b.x0)) * greatest(0, least(c.y1, b.y1) - greatest(c.y0, b.y0)) AS inter, b.bw * b.bh + 512 * 512 AS both_
  FROM cells c JOIN boxes b ON c.image = b.image AND c.x0 < b.x1 AND b.x0 < c.x1 AND c.y0 < b.y1 AND b.y0 < c.y1), i AS (SELECT image, cell_row, cell_col, label, inter / (both_ - inter) AS iou FROM o)"""


@_query("geo6_iou", f"{with_('images', 'cells', 'boxes')}, {_IOU} SELECT image, cell_row, cell_col, label, round(iou, 6) AS iou FROM i")
def geo6(spark, sf_dir):
    return G.overlaps(_cells(spark, sf_dir), V.boxes(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


@_query(
    "geo7_labels",
    f"""{with_('images', 'cells', 'boxes')}, {_IOU}, s AS (SELECT image, cell_row, cell_col, label, round(sum(iou), 9) AS total, max(iou) AS most FROM i GROUP BY ALL),
t AS (SELECT image, cell_row, cell_col, max(most) AS most, arg_max(label, (total, -label)) AS label, list_sort(list(label) FILTER (WHERE total > 0.05)) AS hot FROM s GROUP BY ALL)
SELECT c.image, c.cell_row, c.cell_col, CASE WHEN most >= 0.05 THEN label ELSE -1 END::INT AS dominant, coalesce(array_to_string(hot, ','), '') AS hot FROM cells c LEFT JOIN t USING (image, cell_row, cell_col)""",
)
def geo7(spark, sf_dir):
    out = G.assign_labels(_cells(spark, sf_dir), V.boxes(spark, sf_dir), 0.05)
    hot = F.filter(F.transform("multi_hot", lambda v, i: F.when(v == 1, i)), lambda x: x.isNotNull())
    return out.select("image", "cell_row", "cell_col", "dominant", F.array_join(F.transform(hot, lambda x: x.cast("string")), ",").alias("hot"))


@_query("geo8_adjacent", f"{with_('images', 'cells')} SELECT a.image, a.cell_row, a.cell_col, b.cell_row AS cell_row_2, b.cell_col AS cell_col_2 FROM cells a JOIN cells b ON a.image = b.image AND ((b.cell_row = a.cell_row AND b.cell_col = a.cell_col + 1) OR (b.cell_row = a.cell_row + 1 AND b.cell_col = a.cell_col))")
def geo8(spark, sf_dir):
    return G.adjacent_pairs(_cells(spark, sf_dir)).select("image", "cell_row", "cell_col", "cell_row_2", "cell_col_2")


_GRID = "g AS (SELECT cell_id AS image, pos // 4 AS r, pos % 4 AS c, token, label, list_transform(token, lambda x, i: x * (1 + i % 3)) AS target FROM tokens)"


@_query(
    "geo9_smoothness",
    f"""{with_('tokens')}, {_GRID}, p AS (SELECT list_cosine_similarity(a.token, b.token) AS f, list_cosine_similarity(a.target, b.target) * CASE WHEN a.label >= 0 AND b.label >= 0 AND a.label <> b.label THEN 0.5 ELSE 1 END AS t
FROM g a JOIN g b ON a.image = b.image AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c))) SELECT count(*) AS n_pairs, round(avg(greatest(0, t - f)), 6) AS smoothness FROM p""",
)
def geo9(spark, sf_dir):
    t = V.tokens(spark, sf_dir)
    target = F.transform("token", lambda x, i: x * (1 + (i - 1 + 1) % 3))
    rows = t.select(F.col("cell_id").alias("image"), F.expr("pos div 4").cast("int").alias("cell_row"), (F.col("pos") % 4).alias("cell_col"), F.col("token").alias("feature"), F.transform("token", lambda x, i: x * (1 + (i + 1) % 3)).alias("target"), "label")
    return G.smoothness(rows).withColumn("smoothness", F.round("smoothness", 6))


_DRAW = "('0x' || substr(md5('42:{0}:' || id), 1, 8))::BIGINT"


@_query(
    "geo10_triplets",
    f"""{with_('images')}, k AS MATERIALIZED (SELECT image, (r * ceil(raw_w / 300) + c)::INT AS t, c * 300 AS x, r * 300 AS y, image || ':' || (r * ceil(raw_w / 300) + c)::INT AS id FROM (SELECT *, unnest(range(ceil(raw_w / 300)::INT)) AS c FROM (SELECT *, unnest(range(ceil(raw_h / 300)::INT)) AS r FROM images))),
n AS MATERIALIZED (SELECT a.image, a.t, arg_min(b.t, md5('42:' || a.id || ':' || b.t)) AS near FROM k a JOIN k b ON a.image = b.image WHERE a.t <> b.t AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 900 GROUP BY 1, 2),
z AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image ORDER BY t) - 1 AS no FROM k), i AS MATERIALIZED (SELECT image, count(*) AS n, row_number() OVER (ORDER BY md5('42:' || image), image) - 1 AS ino, count(*) OVER () AS m FROM k GROUP BY image),
o AS MATERIALIZED (SELECT z.image, z.t, n, CASE WHEN n > 1 THEN (no + 1 + {_DRAW.format('other')} % (n - 1)) % n ELSE no END AS ono, CASE WHEN m > 1 THEN (ino + 1 + {_DRAW.format('image')} % (m - 1)) % m ELSE ino END AS nno, {_DRAW.format('tile')} AS td FROM z JOIN i USING (image)),
g AS MATERIALIZED (SELECT o.*, i.image AS neg_image, td % i.n AS cno FROM o JOIN i ON i.ino = o.nno)
SELECT g.image, g.t AS tile_idx, coalesce(near, a.t) AS pos_tile, near IS NOT NULL AS pos_near, neg_image, c.t AS neg_tile FROM g JOIN z a ON a.image = g.image AND a.no = g.ono JOIN z c ON c.image = g.neg_image AND c.no = g.cno LEFT JOIN n ON n.image = g.image AND n.t = g.t""",
)
def geo10(spark, sf_dir):
    tiles = G.covering_tiles(_raw(spark, sf_dir), 300, 300).select("image", "tile_idx", "x", "y")
    return G.triplets(tiles, 300)


@_query(
    "src7_yolo",
    f"""{with_('boxes')}, l AS (SELECT image, part, supp, pos, label, (bx % 100) / 100 AS cx, (by_ % 100) / 100 AS cy, bw / 1000 AS w, bh / 1000 AS h FROM boxes),
c AS (SELECT image, part, supp, pos, label + 1 AS label, least(greatest((cx - w / 2) * 640, 0), 639) AS x0, least(greatest((cy - h / 2) * 480, 0), 479) AS y0, least(greatest((cx + w / 2) * 640, 0), 639) AS x1, least(greatest((cy + h / 2) * 480, 0), 479) AS y1 FROM l)
SELECT image, part, supp, pos, label, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM c WHERE x1 > x0 AND y1 > y0""",
)
def src7(spark, sf_dir):
    b = V.boxes(spark, sf_dir)
    line = F.concat_ws(" ", "label", ((F.col("bx") % 100) / 100).cast("string"), ((F.col("by") % 100) / 100).cast("string"), (F.col("bw") / 1000).cast("string"), (F.col("bh") / 1000).cast("string"))
    rows = yolo_boxes(b.select("image", "part", "supp", "pos", line.alias("value")), F.lit(640), F.lit(480))
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select("image", "part", "supp", "pos", "label", r("x0"), r("y0"), r("x1"), r("y1"))


@_query("met2_majority", f"{with_('boxes')}, c AS (SELECT image, label, count(*) AS n, min(pos) AS f FROM boxes GROUP BY ALL) SELECT image, arg_max(label, (n, -f, label))::INT AS label FROM c GROUP BY image")
def met2(spark, sf_dir):
    return M.majority_label(V.boxes(spark, sf_dir))


@_query(
    "met5_pixel_change",
    f"""{with_('pixels')}, s AS (SELECT batch_id, count(*) FILTER (pred_prob > 0.5 AND mask > 127) AS tp, count(*) FILTER (pred_prob > 0.5 AND mask <= 127) AS fp, count(*) FILTER (pred_prob <= 0.5 AND mask > 127) AS fn FROM pixels GROUP BY batch_id),
u AS (SELECT 'batches' AS how, tp, fp, fn FROM s UNION ALL SELECT 'pixels', sum(tp), sum(fp), sum(fn) FROM s),
r AS (SELECT how, tp / (tp + fp + 1e-6) AS p, tp / (tp + fn + 1e-6) AS r, tp / (tp + fp + fn + 1e-6) AS i FROM u)
SELECT how, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(2 * p * r / (p + r + 1e-6)), 6) AS f1, round(avg(i), 6) AS iou FROM r GROUP BY how""",
)
def met5(spark, sf_dir):
    out = M.pixel_change(V.pixels(spark, sf_dir))
    return out.select("how", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "iou")])


@_query("met4_weighted_mean", f"{with_('pixels')} SELECT count(*) AS n_batches, round(sum(v * n) / sum(n), 6) AS mean FROM (SELECT batch_id, avg(value) AS v, count(*) AS n FROM pixels WHERE batch_id <> 0 GROUP BY batch_id)")
def met4(spark, sf_dir):
    each = V.pixels(spark, sf_dir).groupBy("batch_id").agg(F.avg("value").alias("value"), F.count("*").alias("n")).withColumn("label", F.when(F.col("batch_id") == 0, -1).otherwise(0))
    n = each.where("label <> -1").agg(F.count("*").alias("n_batches"))
    return n.crossJoin(M.weighted_mean(each, label="label").select(F.round("mean", 6).alias("mean")))


def _ap(thresholds: str) -> str:
    """Matching and the area under the envelope, thresholds side by side."""
    return f"""{with_('boxes', 'detections')}, o AS (SELECT p.image_id, p.pred_id, t.gt_id, greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0)) AS i, (p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) AS s FROM preds p JOIN truths t ON p.image_id = t.image_id),
b AS (SELECT image_id, pred_id, max(i / (s - i)) AS iou, arg_max(gt_id, (i / (s - i), -gt_id)) AS gt_id FROM o GROUP BY 1, 2), e AS (SELECT p.image_id, p.pred_id, p.score, iou, gt_id, unnest({thresholds}) AS threshold FROM preds p LEFT JOIN b USING (image_id, pred_id)),
m AS (SELECT *, coalesce(iou >= threshold, false) AS reach FROM e), f AS (SELECT *, CASE WHEN reach AND row_number() OVER (PARTITION BY threshold, image_id, CASE WHEN reach THEN gt_id END ORDER BY score DESC, pred_id) = 1 THEN 1 ELSE 0 END AS tp FROM m),
c AS (SELECT threshold, score, pred_id, sum(tp) OVER w / ((SELECT count(*) FROM truths) + 1e-6) AS recall, sum(tp) OVER w / (count(*) OVER w + 1e-6) AS prec FROM f WINDOW w AS (PARTITION BY threshold ORDER BY score DESC, pred_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT threshold, recall - coalesce(lag(recall) OVER (PARTITION BY threshold ORDER BY score DESC, pred_id), 0) AS step, max(prec) OVER (PARTITION BY threshold ORDER BY score, pred_id DESC ROWS UNBOUNDED PRECEDING) AS env FROM c)
SELECT threshold::DOUBLE AS threshold, count(*) AS predictions, (SELECT count(*) FROM truths) AS truths, round(sum(step * env), 6) AS ap FROM a GROUP BY threshold"""


@_query("met6_detection_ap", _ap("[0.5::DOUBLE]"))
def met6(spark, sf_dir):
    p, t = V.detections(spark, sf_dir)
    return M.average_precision(p, t, (0.5,)).withColumn("ap", F.round("ap", 6))


@_query("met7_multi_threshold_ap", _ap("[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]"))
def met7(spark, sf_dir):
    p, t = V.detections(spark, sf_dir)
    return M.average_precision(p, t, tuple(round(0.1 * i, 1) for i in range(1, 10))).withColumn("ap", F.round("ap", 6))
