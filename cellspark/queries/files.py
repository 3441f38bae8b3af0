"""Queries on files: rows of the tables are written in a format and read back (SRC1-SRC6, SNK1, SNK2, STR1, RET6, PIX1, PIX2)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cellspark.plans import views as V
from cellspark.plans.views import table, with_
from cellspark.queries import vocabulary as Q
from cellspark.schemas import CATEGORIES, FINE_LABELS, MERGED_LABELS, category_table
from cellspark.sources import files as S
from cellspark.sources import sinks as K
from cellspark.sources.scratch import fresh
from cellspark.streaming.histograms import stream_histograms, stream_token_histograms

QUERIES: dict = {}
ORACLES: dict = {}
#: Files that a table is written to.
FILES = 16
#: Boxes to a file of sidecars, about: there are as many more files as there are more boxes.
BOXES = 40_000


def _query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _write_documents(rows, key: str, value, path: str, files: int = FILES, compression: str = "none") -> None:
    """One JSON document for each of ``files`` remainders of the key, a file each: ``value`` makes it of the sorted rows."""
    grouped = rows.groupBy((F.col(key) % files).alias("file")).agg(F.sort_array(F.collect_list(F.struct(key, *[c for c in rows.columns if c != key]))).alias("rows"))
    grouped.select("file", value(F.col("rows")).alias("value")).write.partitionBy("file").text(path, compression=compression)


@_query("src1_file_list", f"{with_('paths')} SELECT (row_number() OVER (PARTITION BY pos % {FILES} ORDER BY pos) - 1)::BIGINT AS pos, path FROM paths")
def src1(spark, sf_dir):
    path = fresh(spark, "lists")
    _write_documents(V.paths(spark, sf_dir).select("pos", "path"), "pos", lambda rows: F.to_json(F.transform(rows, lambda r: r.path)), path)
    return S.read_file_list(spark, path).select("pos", "path")


@_query(
    "src2_manifest",
    f"""{with_('images')}, c AS (SELECT image, row_number() OVER (PARTITION BY image % {FILES} ORDER BY image) - 1 AS cell_id, (image % 5)::INT AS cell_row, raw_w / 2 AS a, raw_h / 2 AS b FROM images)
SELECT cell_id::BIGINT AS cell_id, 'img/' || image AS img_path, cell_row, round_even(a, 0)::INT AS x0, round_even(b, 0)::INT AS y0, round_even(a + 64, 0)::INT AS x1, round_even(b + 64, 0)::INT AS y1 FROM c""",
)
def src2(spark, sf_dir):
    """Manifests of the four spellings: a list, or an object with ``cells``; one name of the path or the other; three ways to give a box."""
    path = fresh(spark, "manifests")
    rows = V.images(spark, sf_dir).select("image", (F.col("image") % 5).cast("int").alias("row"), (F.col("raw_w") / 2).alias("a"), (F.col("raw_h") / 2).alias("b"))

    def entry(r):
        name, box = F.concat(F.lit("img/"), r.image.cast("string")), F.array(r.a, r.b, r.a + 64, r.b + 64)
        first, second = r.image % 2 == 0, (r.image % 3).cast("int")
        named = lambda p: [F.when(second == (1 if p else 2), x).alias(f"{p}{n}") for n, x in zip(("x0", "y0", "x1", "y1"), (r.a, r.b, r.a + 64, r.b + 64))]
        return F.struct(F.when(first, name).alias("img_path"), F.when(~first, name).alias("image_path"), r.row.alias("cell_row"), F.when(second == 0, box).alias("coords"), *named("cell_"), *named(""))

    whole = lambda rows: F.to_json(F.transform(rows, entry))
    _write_documents(rows, "image", lambda r: F.when(r[0]["image"] % 2 == 0, whole(r)).otherwise(F.concat(F.lit('{"cells": '), whole(r), F.lit("}"))), path)
    return S.read_manifest(spark, path).select("cell_id", "img_path", "cell_row", "x0", "y0", "x1", "y1")


@_query(
    "src3_annotations",
    f"""{with_('boxes', 'names')}, b AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY pos, part, CASE WHEN label % 9 = 4 THEN 'mystery' ELSE category END, bx, by_, bw, bh) - 1 AS pos, CASE WHEN label % 9 = 4 THEN 'mystery' ELSE category END AS category, n.label, part % 11 = 0 AS raw, bx, by_, bw, bh FROM boxes JOIN names n USING (label))
SELECT (image % 1000)::INT AS width, 500 AS height, pos::INT AS pos, category, label::INT AS label, bx, by_ AS by, bw, bh FROM b WHERE category <> 'mystery' AND NOT raw""",
)
def src3(spark, sf_dir):
    """Sidecars, many to a file; unknown categories and raw locations are left out when they are read."""
    path = fresh(spark, "sidecars")
    b = V.boxes(spark, sf_dir).join(F.broadcast(category_table(spark)), "label")
    category = F.when(F.col("label") % 9 == 4, "mystery").otherwise(F.col("category"))
    box = F.struct("pos", "part", category.alias("category"), F.array("bx", "by", "bw", "bh").alias("box"), F.when(F.col("part") % 11 == 0, "here").alias("raw_location"))
    rows = b.groupBy("image").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    sidecar = lambda r: F.struct((r.image % 1000).cast("int").alias("img_width"), F.lit(500).alias("img_height"), F.transform(r.boxes, lambda x: F.struct(x.category.alias("category"), x.box.alias("box"), x.raw_location.alias("raw_location"))).alias("bounding_boxes"))
    files = max(FILES, -(-table(spark, sf_dir, "lineitem").count() // BOXES))
    _write_documents(rows, "image", lambda r: F.to_json(F.transform(r, sidecar)), path, files, "gzip")
    return S.read_annotations(spark, path).drop("file")


@_query("src4_list_files", "SELECT lang, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes FROM documents GROUP BY lang")
def src4(spark, sf_dir):
    """Sizes of text files below folders, other files left out."""
    path = fresh(spark, "listing")
    d = table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value"))
    d.write.partitionBy("lang").text(path)
    found = S.list_files(spark, path, ("TXT",))
    return found.groupBy(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang")).agg(F.sum("length").alias("bytes"))


_FINE = "[" + ", ".join(f"'{x}'" for x in FINE_LABELS) + "]"
_MERGED = "[" + ", ".join(f"'{x}'" for x in MERGED_LABELS) + "]"


@_query(
    "src5_split_csv",
    f"""SELECT mode, 'root/ex_' || o_orderkey || '/images/visible/composite.png' AS path, (CASE WHEN mode = '12' THEN o_orderkey % 14 ELSE o_custkey % 5 END)::INT AS label FROM orders, (SELECT unnest(['12', '4']) AS mode)
WHERE o_orderkey % 10 <> 3 AND CASE WHEN mode = '12' THEN o_orderkey % 14 < {len(FINE_LABELS)} ELSE o_custkey % 5 < {len(MERGED_LABELS)} END""",
)
def src5(spark, sf_dir):
    path = fresh(spark, "splits")
    pick = lambda names, i: F.coalesce(F.get(F.array(*map(F.lit, names)), i.cast("int")), F.lit("no such label"))
    o = table(spark, sf_dir, "orders")
    o.select(
        F.when(F.col("o_orderkey") % 10 == 3, "").otherwise(F.concat(F.lit("ex_"), "o_orderkey")).alias("example_path"), pick(FINE_LABELS, F.col("o_orderkey") % 14).alias("label"), pick(MERGED_LABELS, F.col("o_custkey") % 5).alias("merged_label")
    ).write.csv(path, header=True)
    parts = [S.read_split_csv(spark, path, m, "root/").withColumn("mode", F.lit(m)) for m in ("12", "4")]
    return parts[0].unionByName(parts[1]).select("mode", "path", "label")


@_query("src6_split_list", f"{with_('names')} SELECT category || '/' || doc_id || '.jpg' AS item, category, label::INT AS label FROM documents JOIN names ON label = doc_id % {len(CATEGORIES)}")
def src6(spark, sf_dir):
    """Lines with back slashes, more columns, comments and blanks."""
    path = fresh(spark, "split-lists")
    d = table(spark, sf_dir, "documents").withColumn("label", (F.col("doc_id") % len(CATEGORIES)).cast("int")).join(F.broadcast(category_table(spark)), "label")
    line = F.concat("category", F.when(F.col("doc_id") % 3 == 0, "\\").otherwise("/"), "doc_id", F.lit(".jpg"), F.when(F.col("doc_id") % 5 == 0, " 12 more").otherwise(""))
    extra = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("# a comment"), F.lit("  "), line)).otherwise(F.array(line))
    d.select(F.explode(extra).alias("value")).write.text(path)
    return S.read_split_list(spark, path, category_table(spark))


@_query("snk1_store", "SELECT ('0x' || substr(md5(vec_id::VARCHAR), 1, 2))::INT % 16 AS bucket, vec_id AS key, label FROM embeddings")
def snk1(spark, sf_dir):
    """Vectors written to the store, read back with their bucket."""
    path = fresh(spark, "vectors")
    K.write_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label", "embedding"), path, "key", 16)
    return spark.read.parquet(path).where("size(embedding) = 64").select("bucket", "key", "label")


@_query("snk2_store", f"{Q._H} SELECT cell_id, word, round(h, 6) AS h FROM hist")
def snk2(spark, sf_dir):
    path = fresh(spark, "histograms")
    K.write_histograms(Q.histograms(spark, sf_dir), path)
    return Q._flat(spark.read.parquet(path), "histogram", ("cell_id",), "word", "h")


@_query("str1_stream", f"{Q._H} SELECT cell_id, word, round(h, 6) AS h FROM hist")
def str1(spark, sf_dir):
    """Files of tokens arrive twice, some cells again in the second lot; the result is the batch's."""
    cells, words = V.cell_major(spark, sf_dir), V.vocabulary(spark, sf_dir)
    source, out, checkpoint = (fresh(spark, x) for x in ("arriving", "streamed", "progress"))
    rows = cells.select("cell_id", F.col("tokens").cast("array<array<float>>").alias("tokens"))
    for some in (rows.where("cell_id % 3 <> 0"), rows.where("cell_id % 2 = 0 or cell_id % 3 = 0")):
        some.write.mode("append").parquet(source)
        stream_histograms(spark, source, words, out, checkpoint).awaitTermination()
    return Q._flat(spark.read.parquet(out), "histogram", ("cell_id",), "word", "h")


@_query("str1_token_stream", f"{Q._H}, n AS (SELECT cell_id, count(*)::INT AS tokens FROM tokens GROUP BY cell_id) SELECT cell_id, tokens, word, round(h, 6) AS h FROM hist JOIN n USING (cell_id) WHERE tokens = 16")
def str1b(spark, sf_dir):
    """Token-major files in two runs: even positions and some others first, then the odd ones and some again; cells of 16 tokens are complete after both."""
    tokens, words = V.tokens(spark, sf_dir).select("cell_id", "pos", "token"), V.vocabulary(spark, sf_dir)
    source, out, checkpoint = (fresh(spark, x) for x in ("arriving", "streamed", "progress"))
    for some in (tokens.where("pos % 2 = 0 or cell_id % 5 = 0"), tokens.where("pos % 2 = 1 or cell_id % 3 = 0")):
        some.write.mode("append").parquet(source)
        stream_token_histograms(spark, source, words, out, checkpoint, 16).awaitTermination()
    return Q._flat(spark.read.parquet(out), "histogram", ("cell_id", "tokens"), "word", "h")


def _pictures(spark, sf_dir, times: int):
    """A small image for each customer, its bytes a pattern of the key, blue first. Keys are dealt to all tasks first: few bytes of customers make many of images."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
    width, height = (3 + F.col("key") % 4).cast("int"), (2 + F.col("key") % 3).cast("int")
    value = lambda i: F.lpad(F.hex((F.col("key") * times + i * 31) % 256), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), width * height * 3 - 1), value), ""))
    return c.select(F.col("key").cast("string").alias("origin"), F.col("key").cast("string").alias("name"), width.alias("width"), height.alias("height"), F.lit(3).alias("n_channels"), data.alias("data"))


_IMAGE = "im AS (SELECT c_custkey AS key, (3 + c_custkey % 4)::INT AS w, (2 + c_custkey % 3)::INT AS h FROM customer)"
#: The byte of a channel (red 0) of a pixel.
_BYTE = "((key * {0} + ((y + {1}) * w + x + {2}) * 93 + (2 - ch) * 31) % 256)"
_TILES = f"""WITH {_IMAGE}, t AS (SELECT *, unnest(range((w + 1) // 2)) * 2 AS x FROM (SELECT *, unnest(range((h + 1) // 2)) * 2 AS y FROM im)),
p AS (SELECT key, w, h, x, y, dy, dx, ch, CASE WHEN x + dx < w AND y + dy < h THEN {_BYTE.format(7, 'dy', 'dx')} ELSE 0 END AS b FROM t, (SELECT unnest(range(2)) AS dy), (SELECT unnest(range(2)) AS dx), (SELECT unnest(range(3)) AS ch))"""


@_query("pix1_tiles", f"{_TILES} SELECT key::VARCHAR AS origin, ((y // 2) * ((w + 1) // 2) + x // 2)::INT AS tile_idx, x::INT AS x, y::INT AS y, (dy * 6 + dx * 3 + ch)::INT AS place, round((b / 255 - 0.5) / 0.5, 4) AS v FROM p")
def pix1(spark, sf_dir):
    out = S.pixel_tiles(_pictures(spark, sf_dir, 7), 2, 2)
    return out.select("origin", "tile_idx", "x", "y", F.posexplode("pixels").alias("place", "v")).withColumn("v", F.round(F.col("v").cast("double"), 4))


def _brightness():
    """A stand-in for a model: mean and largest pixel."""

    def model(frame):
        pixels = np.array(frame["pixels"].tolist(), np.float64)
        return np.column_stack((pixels.mean(1), pixels.max(1)))

    return model


@_query("ret6_index", f"{_TILES} SELECT key::VARCHAR AS origin, ((y // 2) * ((w + 1) // 2) + x // 2)::INT AS tile_idx, x::INT AS x, y::INT AS y, round(avg((b / 255 - 0.5) / 0.5), 4) AS a, round(max((b / 255 - 0.5) / 0.5), 4) AS b FROM p GROUP BY key, w, x, y")
def ret6(spark, sf_dir):
    out = S.index_rows(_pictures(spark, sf_dir, 7), 2, 2, _brightness)
    return out.select("origin", "tile_idx", "x", "y", *[F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(n) for i, n in enumerate(("a", "b"))])


@_query(
    "pix2_patches",
    f"""WITH {_IMAGE}, t AS (SELECT *, unnest(range(w - 1)) AS x FROM (SELECT *, unnest(range(h - 1)) AS y FROM im)), q AS (SELECT * FROM t, (SELECT unnest(range(2)) AS dy), (SELECT unnest(range(2)) AS dx), (SELECT unnest(range(3)) AS ch))
SELECT key::VARCHAR AS name, x::INT AS x, y::INT AS y, sum({_BYTE.format(7, 'dy', 'dx')} * (dy * 6 + dx * 3 + ch + 1))::BIGINT AS a, sum({_BYTE.format(11, 'dy', 'dx')} * (dy * 6 + dx * 3 + ch + 1))::BIGINT AS b, sum(CASE WHEN ch = 0 AND {_BYTE.format(13, 'dy', 'dx')} > 127 THEN 1 ELSE 0 END)::BIGINT AS changed FROM q GROUP BY key, x, y""",
)
def pix2(spark, sf_dir):
    """Windows of three images of one name; pixels are compared as sums weighted by place."""
    out = S.aligned_patches(*[_pictures(spark, sf_dir, t) for t in (7, 11, 13)], 2, 1)
    total = lambda c: F.aggregate(F.transform(c, lambda v, i: v.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return out.select("name", "x", "y", total("a").alias("a"), total("b").alias("b"), F.aggregate("changed", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("changed"))
