"""Queries on retrieval, classification and sweep tables (RET, MET1, MET3, MET8, MET9, SNK3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellspark.operators import metrics as M
from cellspark.operators import retrieval as R
from cellspark.operators.sampling import stratified_folds
from cellspark.plans.views import table
from cellspark.sources import sinks as K
from cellspark.sources.scratch import fresh

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _items(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label", "embedding")


def _queries(spark, sf_dir):
    return _items(spark, sf_dir).where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")


def _base(spark, sf_dir):
    return _items(spark, sf_dir).where("item_id % 10 <> 0")


_SEARCH = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, round(list_dot_product(q.e, d.e), 9) AS score FROM v q JOIN v d ON q.vec_id % 100 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM s QUALIFY rank <= 10) SELECT query_id, rank, item_id, round(score, 6) AS score FROM f"""
_TOP = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, q.label AS want, d.label AS got, round(list_dot_product(q.e, d.e), 9) AS score FROM v q JOIN v d ON q.vec_id % 10 = 0 AND d.vec_id % 10 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM s QUALIFY rank <= 10)"""
_ALL = _TOP.replace("q.vec_id % 10 = 0 AND d.vec_id % 10 <> 0", "true")
_METRICS = """h AS (SELECT query_id, rank, CASE WHEN want = got THEN 1 ELSE 0 END AS hit, {keys} sum(CASE WHEN want = got THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) / rank AS p FROM f),
a AS (SELECT k, query_id, {keys} max(hit) AS recall, coalesce(sum(p) FILTER (hit = 1) / nullif(sum(hit), 0), 0) AS ap FROM h, (SELECT unnest([1, 5, 10]) AS k) WHERE rank <= k GROUP BY ALL)"""


def _search(spark, sf_dir):
    """The rows that searches start from, and all rows."""
    items = _items(spark, sf_dir)
    return items.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id"), items


@_query("ret1_top_k", _SEARCH)
def ret1(spark, sf_dir):
    return R.top_k(*_search(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@_query("ret2_ivf")
def ret2(spark, sf_dir):
    """A quarter of the lists are read for a query; neighbours are nearly random here, so an item is in three lists."""
    return R.ivf_top_k(*_search(spark, sf_dir), 10, lists=128, probes=32, copies=3).withColumn("score", F.round("score", 6))


@_query(
    "ret2_ivf_given",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT v.vec_id, c.vec_id AS list, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_dot_product(v.e, c.e) DESC, c.vec_id) AS near FROM v, v c WHERE c.vec_id < 16),
p AS (SELECT DISTINCT q.vec_id AS query_id, i.vec_id AS item_id FROM s q JOIN s i ON q.list = i.list AND q.near <= 4 AND i.near <= 2 WHERE q.vec_id % 100 = 0),
f AS (SELECT query_id, item_id, round(list_dot_product(a.e, b.e), 9) AS score FROM p JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = item_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank, item_id, round(score, 6) AS score FROM f QUALIFY rank <= 10""",
)
def ret2c(spark, sf_dir):
    """Lists around the first sixteen vectors, of which a query probes four; items are in two, and long lists are cut."""
    queries, items = _search(spark, sf_dir)
    centroids = items.where("item_id < 16").select(F.col("item_id").cast("int").alias("list"), F.col("embedding").cast("array<double>").alias("centroid"))
    path = fresh(spark, "ivf")
    R.write_ivf(items, path, 16, copies=2, most=40, centroids=centroids)
    return R.search_ivf(queries, path, 10, 4).withColumn("score", F.round("score", 6))


@_query("ret2_ivf_all_lists", _SEARCH)
def ret2b(spark, sf_dir):
    """With every list probed the search is exact."""
    return R.ivf_top_k(*_search(spark, sf_dir), 10, lists=16, probes=16).withColumn("score", F.round("score", 6))


@_query("ret3_metrics", f"WITH {_ALL}, {_METRICS.format(keys='')} SELECT k, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(ap), 6) AS map FROM a GROUP BY k")
def ret3(spark, sf_dir):
    """Every row searches all rows."""
    b = _items(spark, sf_dir)
    q = b.withColumnRenamed("item_id", "query_id")
    out = R.retrieval_metrics(R.top_k(q, b, 10), q, b)
    return out.select("k", "queries", F.round("recall", 6).alias("recall"), F.round("map", 6).alias("map"))


@_query(
    "ret4_kfold",
    f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id)) - 1) % 5 AS fold FROM embeddings),
s AS (SELECT q.fold, q.vec_id AS query_id, d.vec_id AS item_id, q.label AS want, d.label AS got, round(list_dot_product(q.e, d.e), 9) AS score FROM v q JOIN v d ON q.fold <> d.fold), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 10), {_METRICS.format(keys='fold,')},
g AS (SELECT k, fold, avg(recall) AS recall, avg(ap) AS map FROM a GROUP BY k, fold)
SELECT k, round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std, round(avg(map), 6) AS map_mean, round(stddev_pop(map), 6) AS map_std FROM g GROUP BY k""",
)
def ret4(spark, sf_dir):
    folded = stratified_folds(_items(spark, sf_dir), "label", "item_id", 5)
    out = R.kfold_retrieval(folded)
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("recall_mean", "recall_std", "map_mean", "map_std")])


@_query(
    "ret5_two_label_sets",
    f"WITH {_TOP}, t AS (SELECT 'fine' AS label_set, query_id, rank, want, got FROM f UNION ALL SELECT 'merged', query_id, rank, want % 3, got % 3 FROM f), h AS (SELECT label_set, query_id, rank, CASE WHEN want = got THEN 1 ELSE 0 END AS hit, sum(CASE WHEN want = got THEN 1 ELSE 0 END) OVER (PARTITION BY label_set, query_id ORDER BY rank) / rank AS p FROM t), a AS (SELECT label_set, k, query_id, max(hit) AS recall, coalesce(sum(p) FILTER (hit = 1) / nullif(sum(hit), 0), 0) AS ap FROM h, (SELECT unnest([1, 5, 10]) AS k) WHERE rank <= k GROUP BY ALL) SELECT label_set, k, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(ap), 6) AS map FROM a GROUP BY ALL",
)
def ret5(spark, sf_dir):
    two = lambda d: d.withColumn("fine", F.col("label")).withColumn("merged", F.col("label") % 3)
    out = R.split_retrieval(two(_queries(spark, sf_dir)), two(_base(spark, sf_dir)), ("fine", "merged"))
    return out.select("label_set", "k", "queries", F.round("recall", 6).alias("recall"), F.round("map", 6).alias("map"))


# Documents stand for samples: quality is the truth, toxicity and length make a prediction.
_PRED = "p AS (SELECT l.doc_id, l.quality + 2 * l.toxic AS y_true, CASE WHEN d.n_chars % 3 = 0 THEN (l.quality + 2 * l.toxic + 1) % 4 ELSE l.quality + 2 * l.toxic END AS y_pred, [d.n_chars % 7, d.n_chars % 11, d.n_chars % 5, d.n_chars % 13]::DOUBLE[] AS scores FROM labels l JOIN documents d USING (doc_id))"


@_query(
    "met1_classification",
    f"""WITH {_PRED}, l AS (SELECT y_true AS label FROM p UNION SELECT y_pred FROM p), e AS (SELECT label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_true <> label AND y_pred = label) AS fp, count(*) FILTER (y_true = label AND y_pred <> label) AS fn FROM l, p GROUP BY label),
r AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM e),
k AS (SELECT len(list_filter(scores, lambda s, i: s > scores[y_true + 1] OR (s = scores[y_true + 1] AND i < y_true + 1))) AS rk, y_true = y_pred AS hit FROM p)
SELECT round((SELECT avg(hit::INT) * 100 FROM k), 6) AS top1, round((SELECT avg((rk < 2)::INT) * 100 FROM k), 6) AS topk, round(avg(p) * 100, 6) AS precision, round(avg(r) * 100, 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) * 100, 6) AS f1 FROM r""",
)
def met1(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    y = F.col("quality") + 2 * F.col("toxic")
    n = F.col("n_chars")
    rows = rows.select(y.alias("y_true"), F.when(n % 3 == 0, (y + 1) % 4).otherwise(y).alias("y_pred"), F.array(*[(n % m).cast("double") for m in (7, 11, 5, 13)]).alias("scores"))
    out = M.classification(rows, 2)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@_query("met3_fold_summary", "WITH f AS (SELECT event_type AS metric, user_id % 5 AS fold, avg(value) AS value FROM events GROUP BY ALL) SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS folds FROM f GROUP BY metric")
def met3(spark, sf_dir):
    each = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("value"))
    out = M.fold_summary(each)
    return out.select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "folds")


def _logs(spark, sf_dir):
    """A retrieval log for each customer, most with deviations, some without, some with neither."""
    c = table(spark, sf_dir, "customer").where("c_custkey is not null")
    n = lambda i: F.format_string("%.4f", (F.col("c_custkey") * i % 1000) / 1000)
    with_std = F.concat(*[F.concat(F.lit(f"x Recall@{k}: "), n(k + 1), F.lit(" ± "), n(k + 2), F.lit(f" | mAP@{k}: "), n(k + 3), F.lit(" ± "), n(k + 4), F.lit("\n")) for k in (1, 5)])
    plain = F.concat(*[F.concat(F.lit(f"Recall@{k}: "), n(k + 1), F.lit(f" | mAP@{k}: "), n(k + 3), F.lit("\n")) for k in (1, 10)])
    return c.select(F.col("c_custkey").alias("log"), F.when(F.col("c_custkey") % 7 == 0, "nothing here").when(F.col("c_custkey") % 3 == 0, plain).otherwise(with_std).alias("text"))


_N = "round((c_custkey * {0} % 1000) / 1000, 4)"
_LOG = "m AS (" + " UNION ALL ".join(
    [f"SELECT c_custkey AS log, '{a}_at_{k}{t}' AS metric, {_N.format(k + i)} AS value FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 <> 0" for k in (1, 5) for a, t, i in (("recall", "", 1), ("recall", "_std", 2), ("map", "", 3), ("map", "_std", 4))]
    + [f"SELECT c_custkey, '{a}_at_{k}', {_N.format(k + i)} FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 = 0" for k in (1, 10) for a, i in (("recall", 1), ("map", 3))]
) + ")"


@_query("met8_parse_logs", f"WITH {_LOG} SELECT log, metric, value FROM m")
def met8(spark, sf_dir):
    return M.parse_logs(_logs(spark, sf_dir))


_SWEEP = ("recall_at_1", "recall_at_5", "recall_at_10", "map_at_1", "map_at_5", "map_at_10")


@_query("met9_sweep_table", f"WITH {_LOG} SELECT log AS k, round(max(log / 7), 6)::DOUBLE AS silhouette, " + ", ".join(f"coalesce(max(value) FILTER (metric = '{m}'), 0) AS {m}" for m in _SWEEP) + " FROM m GROUP BY log")
def met9(spark, sf_dir):
    rows = M.parse_logs(_logs(spark, sf_dir)).select(F.col("log").alias("k"), F.round(F.col("log") / 7, 6).alias("silhouette"), "metric", "value")
    return M.sweep_table(rows, _SWEEP)


@_query("snk3_summary", f"WITH {_LOG}, n AS (SELECT DISTINCT metric FROM m) SELECT log AS k, " + ", ".join(f"max(value) FILTER (metric = '{m}') + CASE WHEN log % 2 = 0 THEN 1 ELSE 0 END AS {m}" for m in sorted({f'{a}_at_{k}{t}' for a in ('recall', 'map') for k, t in ((1, ''), (1, '_std'), (5, ''), (5, '_std'), (10, ''))})) + " FROM m GROUP BY log")
def snk3(spark, sf_dir):
    parsed = M.parse_logs(_logs(spark, sf_dir)).groupBy(F.col("log").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    newer = parsed.where("k % 2 = 0").withColumn("metrics", F.transform_values("metrics", lambda k, v: v + 1))
    return K.summary_columns(K.upsert_results(parsed, newer))


def _lengths():
    """A stand-in for a model: two numbers of each text."""
    import numpy as np

    return lambda frame: np.column_stack((frame["text"].str.len(), frame["text"].str.count(" ")))


@_query("ext1_embed", "SELECT doc_id, len(text)::INT AS a, (len(text) - len(replace(text, ' ', '')))::INT AS b FROM documents")
def ext1(spark, sf_dir):
    from cellspark.sources.files import embed

    out = embed(table(spark, sf_dir, "documents").select("doc_id", "text"), _lengths, ["text"])
    return out.select("doc_id", F.get("embedding", 0).cast("int").alias("a"), F.get("embedding", 1).cast("int").alias("b"))
