"""Views of the driver's tables as inputs of the operators, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspark.schemas import CATEGORIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_id, pos, token, label``: 16 vectors make a 4 x 4 cell."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 16").alias("cell_id"), (F.col("vec_id") % 16).cast("int").alias("pos"), F.col("embedding").cast("array<double>").alias("token"), "label", "vec_id")


def vocabulary(spark: SparkSession, sf_dir: str, words: int = 8) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") < words).select(F.col("vec_id").cast("int").alias("word"), F.col("embedding").cast("array<double>").alias("centroid"))


def cell_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_id, tokens``: a cell's vectors in one row."""
    rows = tokens(spark, sf_dir).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return rows.select("cell_id", F.transform("t", lambda x: x.token).alias("tokens"))


def big_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_id, pos, token``: eight scaled numbers of each line item."""
    v = [F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 10, (F.col("l_partkey") % 97) / 97, (F.col("l_suppkey") % 31) / 31, F.col("l_linenumber") / 7, F.lit(1.0)]
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_linenumber").alias("pos"), F.array(*[x.cast("double") for x in v]).alias("token"))


def big_vocabulary(spark: SparkSession, sf_dir: str, words: int = 16) -> DataFrame:
    """``word, centroid``: mean tokens of the part keys with one remainder."""
    from cellspark.functions.vectors import mean_vector

    rows = big_tokens(spark, sf_dir).withColumn("word", (F.col("cell_id") % words).cast("int"))
    return rows.groupBy("word").agg(mean_vector(F.col("token")).alias("centroid"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, raw, path, category_name``: an image path for each document, some with a prefix, an unknown category or back slashes."""
    d = F.col("doc_id")
    name = F.coalesce(F.get(F.array(*map(F.lit, CATEGORIES)), (d % 70).cast("int")), F.lit("mystery"))
    split = F.when(d % 10 < 2, "val").when(d % 10 == 9, "test").otherwise("train")
    tail = F.when(d % 4 == 0, "_msrgb.jpg").otherwise("_rgb.jpg")
    path = F.format_string("%s/%s/%s_%d/%s_%d_0%s", split, name, name, F.expr("doc_id div 3"), name, F.expr("doc_id div 3"), tail)
    prefix = F.when(d % 3 == 0, "Hosted-Datasets/fmow/fmow-rgb/").when(d % 7 == 1, "..//").when(d % 11 == 2, "/home/u/data/fmow/").when(d % 13 == 3, "Hosted-Datasets\\fmow\\fmow-rgb\\").otherwise("")
    return table(spark, sf_dir, "documents").select(d.alias("pos"), F.concat(prefix, path).alias("raw"), path.alias("path"), name.alias("category_name"), "source", "lang")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, width, height`` (multiples of 512) and ``raw_w, raw_h``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image"), (512 * (1 + F.col("o_custkey") % 3)).cast("int").alias("width"), (512 * (1 + F.col("o_orderkey") % 2)).cast("int").alias("height"),
        (300 + F.col("o_custkey") * 37 % 1500).cast("int").alias("raw_w"), (300 + F.col("o_orderkey") * 53 % 1100).cast("int").alias("raw_h"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, pos, label, bx, by, bw, bh`` and the corners."""
    b = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 63).cast("int").alias("label"),
        (F.col("l_partkey") * 13 % 900).cast("double").alias("bx"), (F.col("l_partkey") * 29 % 400).cast("double").alias("by"), (20 + F.col("l_quantity") * 6).alias("bw"), (20.0 + F.col("l_linenumber") * 40).alias("bh"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
    )
    return b.withColumns({"x0": F.col("bx"), "y0": F.col("by"), "x1": F.col("bx") + F.col("bw"), "y1": F.col("by") + F.col("bh")})


def detections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and truths: boxes of odd and even line numbers, moved together."""
    b = boxes(spark, sf_dir)
    corner = {"x0": F.col("label") * 10.0, "y0": F.col("pos") / 2 * 3.0, "x1": F.col("label") * 10.0 + F.col("bw"), "y1": F.col("pos") / 2 * 3.0 + F.col("bh") * 2}
    keyed = b.withColumns(corner).withColumn("image_id", F.expr("image div 4"))
    row_id = F.col("image") * 1_000_000 + F.col("part") * 7 + F.col("pos")
    keyed = keyed.withColumn("rid", row_id).groupBy("image_id", "rid").agg(*[F.min(c).alias(c) for c in ("pos", "discount", "tax", *corner)])
    base = ["image_id", F.lit(1).alias("label"), *corner]
    score = F.round(F.col("discount") * 5 + F.col("tax") * 3, 6)
    return keyed.where("pos % 2 = 1").select(F.col("rid").alias("pred_id"), score.alias("score"), *base), keyed.where("pos % 2 = 0").select(F.col("rid").alias("gt_id"), *base)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch_id, pred_prob, mask``: a pixel for each event."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 16).alias("batch_id"), (F.col("value") % 1).alias("pred_prob"), F.when(F.col("event_type").isin("click", "purchase", "error"), 255).otherwise(100).alias("mask"), "event_id", F.col("value"))


#: The same views for an engine that has the tables as views: common table expressions.
_NAMES = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
SQL = {
    "tokens": "tokens AS (SELECT vec_id // 16 AS cell_id, (vec_id % 16)::INT AS pos, embedding::DOUBLE[] AS token, label, vec_id FROM embeddings)",
    "vocabulary": "vocabulary AS (SELECT vec_id::INT AS word, embedding::DOUBLE[] AS centroid FROM embeddings WHERE vec_id < 8)",
    "big": "big AS (SELECT l_orderkey AS cell_id, l_linenumber AS pos, [l_quantity / 50, l_extendedprice / 100000, l_discount * 10, l_tax * 10, (l_partkey % 97) / 97, (l_suppkey % 31) / 31, l_linenumber / 7, 1.0]::DOUBLE[] AS token FROM lineitem)",
    "paths": f"""paths AS (SELECT pos, prefix || path AS raw, path, category_name, source, lang FROM (
        SELECT *, split || '/' || category_name || '/' || category_name || '_' || (pos // 3) || '/' || category_name || '_' || (pos // 3) || '_0' || tail AS path FROM (
        SELECT doc_id AS pos, source, lang, coalesce(({_NAMES})[doc_id % 70 + 1], 'mystery') AS category_name,
          CASE WHEN doc_id % 10 < 2 THEN 'val' WHEN doc_id % 10 = 9 THEN 'test' ELSE 'train' END AS split,
          CASE WHEN doc_id % 4 = 0 THEN '_msrgb.jpg' ELSE '_rgb.jpg' END AS tail,
          CASE WHEN doc_id % 3 = 0 THEN 'Hosted-Datasets/fmow/fmow-rgb/' WHEN doc_id % 7 = 1 THEN '..//' WHEN doc_id % 11 = 2 THEN '/home/u/data/fmow/' WHEN doc_id % 13 = 3 THEN 'Hosted-Datasets\\fmow\\fmow-rgb\\' ELSE '' END AS prefix
        FROM documents)))""",
    "names": f"names AS (SELECT unnest({_NAMES}) AS category, unnest(range(63)) AS label)",
    "images": "images AS (SELECT o_orderkey AS image, (512 * (1 + o_custkey % 3))::INT AS width, (512 * (1 + o_orderkey % 2))::INT AS height, (300 + o_custkey * 37 % 1500)::INT AS raw_w, (300 + o_orderkey * 53 % 1100)::INT AS raw_h FROM orders)",
    "boxes": """boxes AS (SELECT *, bx AS x0, by_ AS y0, bx + bw AS x1, by_ + bh AS y1 FROM (SELECT l_orderkey AS image, l_linenumber AS pos, (l_suppkey % 63)::INT AS label, (l_partkey * 13 % 900)::DOUBLE AS bx, (l_partkey * 29 % 400)::DOUBLE AS by_,
        20 + l_quantity * 6 AS bw, (20.0 + l_linenumber * 40)::DOUBLE AS bh, l_discount AS discount, l_tax AS tax, l_partkey AS part, l_suppkey AS supp FROM lineitem))""",
    "cells": "cells AS (SELECT image, r::INT AS cell_row, c::INT AS cell_col, c * 512 AS x0, r * 512 AS y0, (c + 1) * 512 AS x1, (r + 1) * 512 AS y1 FROM (SELECT image, width, r, unnest(range(width // 512)) AS c FROM (SELECT *, unnest(range(height // 512)) AS r FROM images)))",
    "pixels": "pixels AS (SELECT user_id % 16 AS batch_id, value % 1 AS pred_prob, CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 255 ELSE 100 END AS mask, event_id, value FROM events)",
    "detections": """det AS (SELECT image // 4 AS image_id, image * 1000000 + part * 7 + pos AS rid, min(pos) AS pos, min(discount) AS discount, min(tax) AS tax, min(label * 10.0::DOUBLE) AS x0, min(pos / 2 * 3.0::DOUBLE) AS y0, min(label * 10.0::DOUBLE + bw) AS x1, min(pos / 2 * 3.0::DOUBLE + bh * 2) AS y1 FROM boxes GROUP BY 1, 2),
      preds AS (SELECT image_id, rid AS pred_id, round(discount * 5 + tax * 3, 6) AS score, x0, y0, x1, y1 FROM det WHERE pos % 2 = 1), truths AS (SELECT image_id, rid AS gt_id, x0, y0, x1, y1 FROM det WHERE pos % 2 = 0)""",
    "bigv": "bigv AS (SELECT word, list(v ORDER BY i) AS centroid FROM (SELECT (cell_id % 16)::INT AS word, i, avg(v) AS v FROM (SELECT cell_id, unnest(range(8)) AS i, unnest(token) AS v FROM big) GROUP BY 1, 2) GROUP BY word)",
    "bighist": """bsoft AS (SELECT r, cell_id, word, exp(-10 * (1 - list_cosine_similarity(token, centroid))) AS e FROM (SELECT row_number() OVER () AS r, * FROM big), bigv),
      bw AS (SELECT cell_id, word, e / sum(e) OVER (PARTITION BY r) AS w FROM bsoft), bhist AS (SELECT cell_id, word, sum(w) / sum(sum(w)) OVER (PARTITION BY cell_id) AS h FROM bw GROUP BY cell_id, word)""",
    "hist": """soft AS (SELECT cell_id, word, exp(-10 * (1 - list_dot_product(token, centroid) / (greatest(sqrt(list_dot_product(token, token)), 1e-8) * greatest(sqrt(list_dot_product(centroid, centroid)), 1e-8)))) AS e, vec_id, pos FROM tokens, vocabulary),
      weights AS (SELECT cell_id, pos, word, e / greatest(sum(e) OVER (PARTITION BY vec_id), 1e-8) AS w FROM soft),
      hist AS (SELECT cell_id, word, sum(w) / greatest(sum(sum(w)) OVER (PARTITION BY cell_id), 1e-8) AS h FROM weights GROUP BY cell_id, word)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
