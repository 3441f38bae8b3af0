"""Queries on vectors, clustering, histograms and their analysis (VEC, ANL, SNK, STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellspark.functions.vectors import dot, l1_distance, l2_normalised, mean_vector
from cellspark.operators import analytics as A
from cellspark.operators import clustering as C
from cellspark.operators import components as P
from cellspark.operators import vectors as X
from cellspark.plans import views as V
from cellspark.plans.views import with_
from cellspark.schemas import CATEGORIES, THEMES
from cellspark.sources import sinks as K

QUERIES: dict = {}
ORACLES: dict = {}
_H = with_("tokens", "vocabulary", "hist")
_R = "SELECT {0}, round({1}, 6) AS {1}"


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _round(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _flat(df, column: str, keys: tuple[str, ...], index: str = "i", value: str = "v"):
    """Array values as rows, rounded."""
    return df.select(*keys, F.posexplode(column).alias(index, value)).withColumn(value, F.round(value, 6) + 0.0)


def histograms(spark, sf_dir):
    return X.soft_histograms(V.tokens(spark, sf_dir), V.vocabulary(spark, sf_dir))


def labelled(spark, sf_dir):
    """Histograms with the label of the cell's first token."""
    first = V.tokens(spark, sf_dir).where("pos = 0").select("cell_id", "label")
    return histograms(spark, sf_dir).join(first, "cell_id")


_LAB = "lab AS (SELECT cell_id, label FROM tokens WHERE pos = 0)"
_ARR = "arr AS (SELECT cell_id, list(h ORDER BY word) AS histogram FROM hist GROUP BY cell_id)"


@_query("vec1_l2", f"{with_('tokens')}, n AS (SELECT vec_id, token, greatest(sqrt(list_dot_product(token, token)), 1e-8) AS n FROM tokens), u AS (SELECT vec_id, unnest(range(64)) AS i, unnest(token) / n AS v FROM n) SELECT vec_id, i::INT AS i, round(v, 6) + 0.0 AS v FROM u")
def vec1(spark, sf_dir):
    return _flat(V.tokens(spark, sf_dir).select("vec_id", l2_normalised(F.col("token")).alias("u")), "u", ("vec_id",))


_NAN = "CASE WHEN vec_id % 37 = 0 THEN list_transform(token, lambda x, i: CASE WHEN i % 4 = 1 THEN 'nan'::DOUBLE ELSE x END) WHEN cell_id % 11 = 3 THEN list_transform(token, lambda x: 'nan'::DOUBLE) ELSE token END"


def _with_nan(spark, sf_dir):
    nan = float("nan")
    t = V.tokens(spark, sf_dir)
    bad = F.when(F.col("vec_id") % 37 == 0, F.transform("token", lambda x, i: F.when(i % 4 == 0, F.lit(nan)).otherwise(x))).when(F.col("cell_id") % 11 == 3, F.transform("token", lambda x: F.lit(nan))).otherwise(F.col("token"))
    return t.withColumn("token", bad)


@_query(
    "vec2_nan_audit",
    f"""{with_('tokens')}, b AS (SELECT cell_id, {_NAN} AS token FROM tokens), n AS (SELECT cell_id, len(list_filter(token, lambda x: isnan(x))) AS k, len(token) AS d FROM b),
c AS (SELECT cell_id, count(*) AS n_rows, count(*) FILTER (k > 0) AS nan_rows, sum(k) / sum(d) AS s FROM n GROUP BY cell_id)
SELECT count(*) AS cells, sum(n_rows)::BIGINT AS n_rows, sum(nan_rows)::BIGINT AS nan_rows, round(min(s), 6) AS lo, round(quantile_cont(s, 0.5), 6) AS median, round(max(s), 6) AS hi, round(avg(s), 6) AS mean FROM c""",
)
def vec2(spark, sf_dir):
    cells = _with_nan(spark, sf_dir).groupBy("cell_id").agg(F.collect_list("token").alias("tokens"))
    return _round(X.nan_totals(X.nan_audit(cells)), "lo", "median", "hi", "mean")


@_query("vec2_without_nan", f"{with_('tokens')}, b AS (SELECT vec_id, {_NAN} AS token FROM tokens) SELECT vec_id FROM b WHERE len(list_filter(token, lambda x: isnan(x))) = 0")
def vec2b(spark, sf_dir):
    return X.without_nan(_with_nan(spark, sf_dir)).select("vec_id")


_MEAN = "SELECT {k}, i::INT AS i, round(avg(v), 6) + 0.0 AS v FROM (SELECT {k}, unnest(range(64)) AS i, unnest(token) AS v FROM {t}) GROUP BY {k}, i"


@_query("vec3_pool", f"{with_('tokens')}, q AS (SELECT cell_id, ((pos // 8) * 2 + (pos % 4) // 2)::INT AS pos, token FROM tokens) {_MEAN.format(k='cell_id, pos', t='q')}")
def vec3(spark, sf_dir):
    return _flat(X.pool_grid(V.tokens(spark, sf_dir), 4), "token", ("cell_id", "pos"))


@_query("vec4_pooled", f"{with_('tokens')}, m AS ({_MEAN.format(k='cell_id', t='tokens')}), c AS (SELECT cell_id, unnest(range(64)) AS i, unnest(token) AS v FROM tokens WHERE pos = 0) SELECT cell_id, i::INT AS i, round(v, 6) + 0.0 AS v FROM c UNION ALL SELECT cell_id, i + 64, v FROM m")
def vec4(spark, sf_dir):
    t = V.tokens(spark, sf_dir)
    return _flat(X.pooled(t, "cls_avg", t.where("pos = 0").select("cell_id", F.col("token").alias("cls"))), "pooled", ("cell_id",))


@_query("vec5_pooled_index", f"{with_('tokens')}, q AS (SELECT cell_id // 3 AS image, cell_id % 3 AS r, token FROM tokens), f AS (SELECT image, min(r) AS r FROM q GROUP BY image), z AS (SELECT q.image, token FROM q JOIN f USING (image, r)) {_MEAN.format(k='image', t='z')}")
def vec5(spark, sf_dir):
    rows = V.tokens(spark, sf_dir).select(F.expr("cell_id div 3").alias("image"), (F.col("cell_id") % 3).alias("cell_row"), F.lit(0).alias("cell_col"), "token")
    return _flat(X.pooled_index(rows)[1], "pooled", ("image",))


@_query(
    "vec6_standardised",
    f"""{with_('tokens')}, e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(token) AS v FROM tokens), s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM e WHERE vec_id % 2 = 0 GROUP BY i)
SELECT vec_id, i::INT AS i, round((v - m) / CASE WHEN d < 1e-6 THEN 1 ELSE d END, 6) + 0.0 AS v FROM e JOIN s USING (i)""",
)
def vec6(spark, sf_dir):
    t = V.tokens(spark, sf_dir).select("vec_id", "token")
    return _flat(X.standardised(t.where("vec_id % 2 = 0"), t), "token", ("vec_id",))


@_query("vec7_pca_checks", "SELECT vec_id, 8 AS dims, true AS unit FROM embeddings")
def vec7b(spark, sf_dir):
    """Width and length of every projected vector."""
    out = X.pca(V.tokens(spark, sf_dir).select("vec_id", "token"), 8)
    return out.select("vec_id", F.size("token").alias("dims"), (F.abs(dot(F.col("token"), F.col("token")) - 1) < 1e-9).alias("unit"))


@_query(
    "vec7_components",
    f"""{with_('tokens')}, u AS (SELECT vec_id, list_transform(t, lambda x: x / greatest(sqrt(list_dot_product(t, t)), 1e-8)) AS t FROM (SELECT vec_id, token[1:8] AS t FROM tokens)),
e AS (SELECT i, j, t[i] AS x, t[j] AS y FROM u, (SELECT unnest(range(1, 9)) AS i), (SELECT unnest(range(1, 9)) AS j)) SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, round(covar_samp(x, y), 6) + 0.0 AS cov FROM e GROUP BY i, j""",
)
def vec7c(spark, sf_dir):
    """All components of the first eight numbers, put together to the covariance that they come from."""
    _, parts = P.principal_components(V.tokens(spark, sf_dir).select(F.slice("token", 1, 8).alias("token")), 8)
    pairs = parts.select("value", "vector", F.posexplode("vector").alias("i", "x")).select("value", "i", "x", F.posexplode("vector").alias("j", "y"))
    return pairs.groupBy("i", "j").agg((F.round(F.sum(F.col("value") * F.col("x") * F.col("y")), 6) + 0.0).alias("cov"))


@_query("vec8_kmeans_checks", "SELECT 10 AS words, count(*) AS points, true AS nearest, true AS settled FROM embeddings")
def vec8b(spark, sf_dir):
    """The reported error is that of the nearest centroids, and every centroid is the mean of its points."""
    t = V.tokens(spark, sf_dir)
    words, error = X.kmeans(t, 10, iterations=200, restarts=1)
    assigned = X.assign(t, words, carry=("token",))
    means = assigned.groupBy("word").agg(mean_vector(F.col("token")).alias("mean"), F.count("*").alias("n"), F.sum("distance2").alias("d"))
    apart = l1_distance(F.col("mean"), F.col("centroid"))
    both = words.join(means, "word")
    return both.agg(F.count("*").cast("int").alias("words"), F.sum("n").alias("points"), (F.abs(F.sum("d") / F.sum("n") - error) < 1e-6).alias("nearest"), (F.max(apart) < 0.05).alias("settled"))


@_query("vec9_methods", "SELECT m AS method, count(*) AS points, true AS in_range FROM embeddings, (SELECT unnest(['kmeans', 'minibatch', 'bisecting', 'gmm']) AS m) GROUP BY m")
def vec9b(spark, sf_dir):
    """Every method gives every point one of k clusters."""
    short = V.tokens(spark, sf_dir).select("vec_id", F.slice("token", 1, 4).alias("token"))
    out = None
    for m in ("kmeans", "minibatch", "bisecting", "gmm"):
        part = X.cluster(short, m, 4).agg(F.lit(m).alias("method"), F.count("*").alias("points"), ((F.min("cluster") >= 0) & (F.max("cluster") < 4)).alias("in_range"))
        out = part if out is None else out.unionByName(part)
    return out


@_query("vec16_k_sweep_checks", "SELECT k, true AS sized, true AS scored FROM (SELECT unnest([4, 8]) AS k)")
def vec16b(spark, sf_dir):
    """Sizes and silhouettes of a sweep lie where they must."""
    t = V.tokens(spark, sf_dir)
    n = t.count()
    out = X.k_sweep(t.select(F.col("vec_id").alias("id"), "token"), (4, 8))
    return out.select("k", ((F.col("smallest") * F.col("k") <= n) & (F.col("largest") * F.col("k") >= n)).alias("sized"), (F.col("silhouette").between(-1, 1) & (F.col("error") > 0)).alias("scored"))


def lloyd_sql(steps: int, points: str = "pts", start: str = "c0", width: int = 64) -> str:
    """Tables ``c1``, ``c2``, ... of centroids after each step of k-means over ``points`` (``id, token``), and each point's word ``n0``, ``n1``, ..."""
    distance = "list_dot_product(token, token) - 2 * list_dot_product(token, centroid) + list_dot_product(centroid, centroid)"
    out = [f"{start} AS MATERIALIZED (SELECT vec_id::INT AS word, token AS centroid FROM tokens WHERE vec_id < {{k}})"] if start == "c0" else []
    for i in range(steps + 1):
        out.append(f"n{i} AS MATERIALIZED (SELECT id, arg_min(word, (round(d, 12), word)) AS word, min(d) AS d FROM (SELECT id, word, {distance} AS d FROM {points}, c{i}) GROUP BY id)")
        if i < steps:
            out.append(f"m{i} AS (SELECT word, list(v ORDER BY j) AS centroid FROM (SELECT word, j, avg(v) AS v FROM (SELECT word, unnest(range({width})) AS j, unnest(token) AS v FROM n{i} JOIN {points} USING (id)) GROUP BY word, j) GROUP BY word)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT word, coalesce(m.centroid, c.centroid) AS centroid FROM c{i} c LEFT JOIN m{i} m USING (word))")
    return ", ".join(out)


_PTS = "pts AS (SELECT vec_id AS id, token FROM tokens)"


def _starts(spark, sf_dir, k):
    return V.vocabulary(spark, sf_dir, k)


@_query("vec8_lloyd", f"{with_('tokens')}, {_PTS}, {lloyd_sql(4).replace('{k}', '10')} SELECT word, j::INT AS i, round(v, 6) + 0.0 AS v, round(e, 6) AS error FROM (SELECT word, unnest(range(64)) AS j, unnest(centroid) AS v FROM c4), (SELECT avg(d) AS e FROM n4)")
def vec8c(spark, sf_dir):
    """Four steps of k-means from the first ten vectors."""
    words, error = C.lloyd(V.tokens(spark, sf_dir), _starts(spark, sf_dir, 10), 4)
    return _flat(words, "centroid", ("word",)).withColumn("error", F.lit(round(error, 6)))


_BATCH = "('0x' || substr(md5('42:' || id::VARCHAR), 1, 8))::BIGINT % 3"


def _mini_batch_sql() -> str:
    """Three batches, one after another, each moving the centroids before the next."""
    distance = "list_dot_product(token, token) - 2 * list_dot_product(token, centroid) + list_dot_product(centroid, centroid)"
    out = ["c0 AS MATERIALIZED (SELECT vec_id::INT AS word, token AS centroid, 0 AS weight FROM tokens WHERE vec_id < 6)"]
    for b in range(3):
        out.append(f"n{b} AS MATERIALIZED (SELECT id, arg_min(word, (round(d, 12), word)) AS word FROM (SELECT id, word, {distance} AS d FROM pts, c{b} WHERE {_BATCH} = {b}) GROUP BY id)")
        out.append(f"m{b} AS (SELECT word, list(v ORDER BY j) AS total, max(n) AS n FROM (SELECT word, j, sum(v) AS v, count(*) AS n FROM (SELECT word, unnest(range(64)) AS j, unnest(token) AS v FROM n{b} JOIN pts USING (id)) GROUP BY word, j) GROUP BY word)")
        out.append(f"c{b + 1} AS MATERIALIZED (SELECT word, CASE WHEN n IS NULL THEN centroid ELSE list_transform(centroid, lambda x, i: (x * weight + total[i]) / (weight + n)) END AS centroid, weight + coalesce(n, 0) AS weight FROM c{b} LEFT JOIN m{b} USING (word))")
    return ", ".join(out)


@_query("vec9_minibatch", f"{with_('tokens')}, {_PTS}, {_mini_batch_sql()} SELECT word, j::INT AS i, round(v, 6) + 0.0 AS v, weight::DOUBLE AS weight FROM (SELECT word, weight, unnest(range(64)) AS j, unnest(centroid) AS v FROM c3)")
def vec9c(spark, sf_dir):
    """An epoch of mini-batch k-means in three batches."""
    words = C.mini_batch_kmeans(V.tokens(spark, sf_dir), _starts(spark, sf_dir, 6), "vec_id", 3)
    return _flat(words, "centroid", ("word", "weight")).select("word", "i", "v", "weight")


def _mixture_sql(steps: int = 2) -> str:
    whole = "SELECT j, avg(t[j]) AS m, avg(t[j] * t[j]) AS q FROM x, (SELECT unnest(range(1, 5)) AS j) GROUP BY j"
    out = ["x AS MATERIALIZED (SELECT vec_id AS id, token[1:4] AS t FROM tokens)", f"g0 AS MATERIALIZED (SELECT id::INT AS word, t AS mean, (SELECT list(q - m * m + 1e-6 ORDER BY j) FROM ({whole})) AS variance, 1 / 3 AS weight FROM x WHERE id < 3)"]
    for i in range(steps):
        out.append(f"l{i} AS MATERIALIZED (SELECT id, word, t, ln(weight) - 0.5 * list_sum(list_transform(range(1, 5), lambda j: ln(2 * pi() * variance[j]) + (t[j] - mean[j]) ** 2 / variance[j])) AS l FROM x, g{i})")
        out.append(f"r{i} AS MATERIALIZED (SELECT id, word, t, exp(l - max(l) OVER w) / sum(exp(l)) OVER w * exp(max(l) OVER w) AS r FROM l{i} WINDOW w AS (PARTITION BY id))")
        sums = f"SELECT word, j, sum(r) AS n, sum(r * t[j]) / sum(r) AS m, sum(r * t[j] * t[j]) / sum(r) AS q FROM r{i}, (SELECT unnest(range(1, 5)) AS j) GROUP BY word, j"
        out.append(f"g{i + 1} AS MATERIALIZED (SELECT word, list(m ORDER BY j) AS mean, list(greatest(q - m * m, 0) + 1e-6 ORDER BY j) AS variance, max(n) / (SELECT count(*) FROM x) AS weight FROM ({sums}) GROUP BY word)")
    return ", ".join(out)


@_query("vec9_gmm", f"{with_('tokens')}, {_mixture_sql()} SELECT word, unnest(range(4))::INT AS i, round(unnest(mean), 6) + 0.0 AS mean, round(unnest(variance), 6) AS variance, round(weight, 6) AS weight FROM g2")
def vec9d(spark, sf_dir):
    """Two steps of EM for three diagonal Gaussians over the first four numbers."""
    short = V.tokens(spark, sf_dir).select("vec_id", F.slice("token", 1, 4).alias("token"))
    starts = _starts(spark, sf_dir, 3).withColumn("centroid", F.slice("centroid", 1, 4))
    model, _ = C.gaussian_mixture(short, starts, 2)
    flat = model.select("word", F.posexplode(F.arrays_zip("centroid", "variance")).alias("i", "z"), "weight")
    return flat.select("word", "i", (F.round("z.centroid", 6) + 0.0).alias("mean"), F.round("z.variance", 6).alias("variance"), F.round("weight", 6).alias("weight"))


def _silhouette_sql(labels: str) -> str:
    """Mean silhouette by squared distances over all pairs of ``labels`` (``id, label, v``)."""
    return f"""y AS MATERIALIZED ({labels}), pairs AS (SELECT a.id, a.label, b.label AS other, sum(list_dot_product(a.v, a.v) - 2 * list_dot_product(a.v, b.v) + list_dot_product(b.v, b.v)) AS s, count(*) AS n FROM y a, y b GROUP BY ALL),
    own AS (SELECT id, n, s / greatest(n - 1, 1) AS a FROM pairs WHERE label = other), near AS (SELECT id, min(s / n) AS b FROM pairs WHERE label <> other GROUP BY id),
    sil AS (SELECT count(*) AS points, avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM own JOIN near USING (id))"""


@_query("vec15_silhouette_all", f"{with_('tokens')}, {_silhouette_sql('SELECT vec_id AS id, label, token AS v FROM tokens')} SELECT points AS n, round(silhouette, 6) AS silhouette FROM sil")
def vec15b(spark, sf_dir):
    return _round(C.silhouette_all(V.tokens(spark, sf_dir).select("label", F.col("token").alias("v"))), "silhouette")


def _sweep_sql(k: int) -> str:
    sizes = f"SELECT c.word, count(n.id) AS size FROM c3 c LEFT JOIN n3 n USING (word) GROUP BY c.word"
    return f"""({with_('tokens')}, {_PTS}, {lloyd_sql(3).replace('{k}', str(k))}, {_silhouette_sql('SELECT id, word AS label, token AS v FROM n3 JOIN pts USING (id)')}
    SELECT {k} AS k, (SELECT round(avg(d), 6) FROM n3) AS error, min(size) AS smallest, max(size) AS largest, (SELECT round(silhouette, 6) FROM sil) AS silhouette FROM ({sizes}))"""


@_query("vec16_sweep_from_starts", f"{_sweep_sql(4)} UNION ALL {_sweep_sql(8)}")
def vec16c(spark, sf_dir):
    """Three steps from the first vectors for each k."""
    points = V.tokens(spark, sf_dir).select(F.col("vec_id").alias("id"), "token")
    return _round(C.k_sweep_from(points, _starts(spark, sf_dir, 8), [4, 8], 3), "error", "silhouette")


@_query("vec7_pca")
def vec7(spark, sf_dir):
    return X.pca(V.tokens(spark, sf_dir).select("vec_id", "token"), 8)


@_query("vec8_kmeans")
def vec8(spark, sf_dir):
    return X.kmeans(V.tokens(spark, sf_dir), 10, iterations=20, restarts=2)[0]


@_query("vec9_bisecting")
def vec9(spark, sf_dir):
    return X.cluster(V.tokens(spark, sf_dir), "bisecting", 6).groupBy("cluster").agg(F.count("*").alias("n"))


_NEAR = """near AS (SELECT cell_id, vec_id, pos, arg_min(word, (round(d, 12), word)) AS word, min(d) AS d FROM (SELECT cell_id, vec_id, pos, word, list_dot_product(token, token) - 2 * list_dot_product(token, centroid) + list_dot_product(centroid, centroid) AS d FROM tokens, vocabulary) GROUP BY ALL)"""


@_query("vec10_assign", f"{with_('tokens', 'vocabulary')}, {_NEAR} SELECT cell_id, pos, word, round(d, 6) AS distance2 FROM near")
def vec10(spark, sf_dir):
    return _round(X.assign(V.tokens(spark, sf_dir), V.vocabulary(spark, sf_dir)), "distance2")


@_query("vec10_sizes", f"{with_('tokens', 'vocabulary')}, {_NEAR}, s AS (SELECT v.word, count(n.word) AS size FROM vocabulary v LEFT JOIN near n ON n.word = v.word GROUP BY v.word) SELECT word, size, round(size / sum(size) OVER (), 6) AS share, size / sum(size) OVER () > 0.05 AS dominant FROM s")
def vec10b(spark, sf_dir):
    v = V.vocabulary(spark, sf_dir)
    return _round(X.cluster_sizes(X.assign(V.tokens(spark, sf_dir), v), v), "share")


@_query(
    "vec10_assign_big",
    f"""{with_('big', 'bigv')}, n AS (SELECT r, arg_min(word, (round(list_distance(token, centroid), 9), word)) AS word FROM (SELECT row_number() OVER () AS r, * FROM big), bigv GROUP BY r),
s AS (SELECT v.word, count(n.word) AS size FROM bigv v LEFT JOIN n ON n.word = v.word GROUP BY v.word) SELECT word, size, round(size / sum(size) OVER (), 6) AS share, size / sum(size) OVER () > 0.05 AS dominant FROM s""",
)
def vec10c(spark, sf_dir):
    v = V.big_vocabulary(spark, sf_dir)
    return _round(X.cluster_sizes(X.assign(V.big_tokens(spark, sf_dir), v, digits=9), v), "share")


@_query("vec11_ground_cost", f"{with_('vocabulary')} SELECT a.word AS i, b.word AS j, CASE WHEN a.word = b.word THEN 0 ELSE round(least(1, greatest(0, 1 - list_cosine_similarity(a.centroid, b.centroid))), 6) END AS cost FROM vocabulary a, vocabulary b")
def vec11(spark, sf_dir):
    return _round(X.ground_cost(V.vocabulary(spark, sf_dir)), "cost")


@_query("vec12_soft_assign", f"{_H} SELECT cell_id, word, round(h, 6) AS h FROM hist")
def vec12(spark, sf_dir):
    return _flat(histograms(spark, sf_dir), "histogram", ("cell_id",), "word", "h")


@_query("vec12_soft_assign_cells", f"{_H} SELECT cell_id, word, round(h, 6) AS h FROM hist")
def vec12b(spark, sf_dir):
    return _flat(X.soft_histograms_by_cell(V.cell_major(spark, sf_dir), V.vocabulary(spark, sf_dir)), "histogram", ("cell_id",), "word", "h")


_B = with_("big", "bigv", "bighist")


@_query("vec12_soft_assign_big", f"{_B} SELECT cell_id, word, round(h, 6) AS h FROM bhist")
def vec12c(spark, sf_dir):
    return _flat(X.soft_histograms(V.big_tokens(spark, sf_dir), V.big_vocabulary(spark, sf_dir)), "histogram", ("cell_id",), "word", "h")


_STATS = f"""{_H}, c AS (SELECT cell_id, -sum(CASE WHEN h > 0 THEN h * ln(h + 1e-10) ELSE 0 END) AS e, count(*) FILTER (h < 1e-6) AS low, list_sum(list_reverse_sort(list(h))[1:5]) AS t5, list_sum(list_reverse_sort(list(h))[1:10]) AS t10 FROM hist GROUP BY cell_id),
b AS (SELECT min(h) AS bin_min, max(h) AS bin_max, avg(h) AS bin_mean, stddev_pop(h) AS bin_std, count(DISTINCT word) AS k FROM hist)
SELECT count(*) AS cells, round(min(bin_min), 6) AS bin_min, round(min(bin_max), 6) AS bin_max, round(min(bin_mean), 6) AS bin_mean, round(min(bin_std), 6) AS bin_std, round(avg(e), 6) AS entropy_mean, round(min(e), 6) AS entropy_min, round(max(e), 6) AS entropy_max,
 round(avg(e) / ln(min(k)), 6) AS entropy_share, round(avg(low), 6) AS empty_bins, round(avg(t5), 6) AS top5, round(avg(t10), 6) AS top10 FROM c, b"""


@_query("vec13_histogram_stats", _STATS)
def vec13(spark, sf_dir):
    out = X.histogram_stats(histograms(spark, sf_dir))
    return _round(out, *[c for c in out.columns if c != "cells"])


@_query(
    "vec14_random_pairs",
    f"""{_H}, {_ARR}, a AS (SELECT histogram, cell_id, row_number() OVER (ORDER BY md5('42:' || cell_id), cell_id) AS n FROM arr), b AS (SELECT histogram, cell_id, row_number() OVER (ORDER BY md5('43:' || cell_id), cell_id) AS n FROM arr),
d AS (SELECT list_sum(list_transform(list_zip(a.histogram, b.histogram), lambda x: abs(x[1] - x[2]))) AS d FROM a JOIN b USING (n) WHERE n <= 1000 AND a.cell_id <> b.cell_id)
SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS lo, round(max(d), 6) AS hi, CASE WHEN avg(d) < 0.1 THEN 'alike' WHEN avg(d) > 0.3 THEN 'distinct' ELSE 'moderate' END AS verdict FROM d""",
)
def vec14(spark, sf_dir):
    return _round(X.random_pair_l1(histograms(spark, sf_dir)), "mean", "std", "lo", "hi")


@_query(
    "vec15_silhouette",
    f"""{with_('tokens')}, p AS (SELECT vec_id, label, token FROM tokens WHERE label >= 0 ORDER BY md5('42:' || vec_id), vec_id LIMIT 20000), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.token, b.token)) AS s, count(*) AS n FROM p a, p b GROUP BY ALL),
w AS (SELECT vec_id, max(CASE WHEN label = other THEN n END) AS own, max(CASE WHEN label = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM d GROUP BY vec_id)
SELECT count(*) AS n, round(avg(CASE WHEN own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM w""",
)
def vec15(spark, sf_dir):
    return _round(X.silhouette(V.tokens(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", F.col("token").alias("v"))), "silhouette")


@_query("vec16_k_sweep")
def vec16(spark, sf_dir):
    return X.k_sweep(V.tokens(spark, sf_dir).select(F.col("vec_id").alias("id"), "token"), (4, 8))


_CENT = "SELECT word, i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY word)), 1e-8) AS v FROM (SELECT word, i, avg(v) AS v FROM (SELECT word, unnest(range(64)) AS i, unnest(token) AS v FROM {0}) GROUP BY word, i)"


@_query("vec17_raw_centroids", f"{with_('tokens', 'vocabulary')}, {_NEAR}, t AS (SELECT n.word, token FROM near n JOIN tokens USING (vec_id)), c AS ({_CENT.format('t')}) SELECT word, i::INT AS i, round(v, 6) + 0.0 AS v FROM c")
def vec17(spark, sf_dir):
    assigned = X.assign(V.tokens(spark, sf_dir), V.vocabulary(spark, sf_dir), carry=("token",))
    return _flat(X.raw_centroids(assigned), "centroid", ("word",))


_TARGET = f"""{_NEAR}, m AS (SELECT cell_id, i, avg(v) AS v FROM (SELECT cell_id, unnest(range(64)) AS i, unnest(centroid) AS v FROM near JOIN vocabulary USING (word)) GROUP BY cell_id, i), u AS (SELECT cell_id, i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY cell_id)), 1e-8) AS v FROM m)"""


def _targets(spark, sf_dir):
    v = V.vocabulary(spark, sf_dir)
    return X.composition_targets(X.assign(V.tokens(spark, sf_dir), v), v)


@_query("vec18_targets", f"{with_('tokens', 'vocabulary')}, {_TARGET}, k AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS target_index FROM (SELECT DISTINCT cell_id FROM tokens)) SELECT cell_id, target_index::INT AS target_index, i::INT AS i, round(v, 6) + 0.0 AS v FROM u JOIN k USING (cell_id)")
def vec18(spark, sf_dir):
    return _flat(_targets(spark, sf_dir).withColumn("target_index", F.col("target_index").cast("int")), "target", ("cell_id", "target_index"))


@_query("vec19_diversity", f"{with_('tokens', 'vocabulary')}, {_TARGET}, k AS (SELECT cell_id FROM (SELECT DISTINCT cell_id FROM tokens) ORDER BY md5('42:' || cell_id), cell_id LIMIT 1000), s AS (SELECT i, sum(v) AS s, sum(v * v) AS q FROM u JOIN k USING (cell_id) GROUP BY i), n AS (SELECT count(*) AS n FROM k), c AS (SELECT (sum(s * s) - sum(q)) / (min(n) * (min(n) - 1)) AS m FROM s, n) SELECT n, round(m, 6) AS mean_cosine, CASE WHEN m < 0.5 THEN 'diverse' ELSE 'alike' END AS verdict FROM c, n")
def vec19(spark, sf_dir):
    return _round(X.target_diversity(_targets(spark, sf_dir)), "mean_cosine")


@_query(
    "vec20_collapse",
    f"""{with_('tokens')}, e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(token) AS v FROM tokens), v AS (SELECT avg(greatest(0, 1 - s)) AS t FROM (SELECT stddev_samp(v) AS s FROM e GROUP BY i)),
c AS (SELECT sum(c * c) / 64 AS t FROM (SELECT covar_samp(a.v, b.v) AS c FROM e a JOIN e b USING (vec_id) WHERE a.i <> b.i GROUP BY a.i, b.i)) SELECT round(v.t, 6) AS variance_term, round(c.t, 6) AS covariance_term FROM v, c""",
)
def vec20(spark, sf_dir):
    return _round(X.collapse_audit(V.tokens(spark, sf_dir)), "variance_term", "covariance_term")


_NOISE = "z AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label, token FROM tokens)"


@_query(
    "vec21_noise",
    f"""{with_('tokens')}, {_NOISE}, w AS (SELECT label AS word, token FROM z WHERE label >= 0), c AS ({_CENT.format('w')}), a AS (SELECT word, list(v ORDER BY i) AS centroid FROM c GROUP BY word),
s AS (SELECT vec_id, arg_max(word, (round(list_dot_product(token, centroid), 12), -word)) AS word FROM z, a WHERE label < 0 GROUP BY vec_id) SELECT vec_id, coalesce(s.word, z.label)::INT AS label FROM z LEFT JOIN s USING (vec_id)""",
)
def vec21(spark, sf_dir):
    rows = V.tokens(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("label")).alias("label"), "token")
    return X.reassign_noise(rows).select("vec_id", "label")


#: Transport between neighbouring cells by recursion: a round takes new row factors from the second, then column factors from the first histogram.
_TRANSPORT = f"""WITH RECURSIVE {_H.removeprefix('WITH ')}, {_ARR},
c AS MATERIALIZED (SELECT list(row_ ORDER BY i) AS c FROM (SELECT a.word AS i, list(CASE WHEN a.word = b.word THEN 0 ELSE least(1, greatest(0, 1 - list_cosine_similarity(a.centroid, b.centroid))) END ORDER BY b.word) AS row_ FROM vocabulary a, vocabulary b GROUP BY a.word)),
m AS MATERIALIZED (SELECT cell_id, list_transform(clamped, lambda x: ln(x / list_sum(clamped))) AS l FROM (SELECT cell_id, list_transform(histogram, lambda x: greatest(x, 1e-8)) AS clamped FROM arr)),
s AS (SELECT a.cell_id AS pair_id, a.l AS p, b.l AS q, c, 0 AS n, list_transform(range(8), lambda j: 0.0::DOUBLE) AS u, list_transform(range(8), lambda j: 0.0::DOUBLE) AS v FROM m a JOIN m b ON b.cell_id = a.cell_id + 1, c
  UNION ALL
  SELECT pair_id, p, q, c, n + 1, u, list_transform(range(8), lambda j: p[j + 1] - ln(list_sum(list_transform(range(8), lambda i: exp(-c[i + 1][j + 1] / 0.05 + u[i + 1]))))) FROM
  (SELECT pair_id, p, q, c, n, v, list_transform(range(8), lambda i: q[i + 1] - ln(list_sum(list_transform(range(8), lambda j: exp(-c[i + 1][j + 1] / 0.05 + v[j + 1]))))) AS u FROM s WHERE n < 50))
SELECT pair_id, round(list_sum(list_transform(range(8), lambda i: list_sum(list_transform(range(8), lambda j: c[i + 1][j + 1] * exp(-c[i + 1][j + 1] / 0.05 + u[i + 1] + v[j + 1]))))), 6) AS emd FROM s WHERE n = 50"""


@_query("vec22_transport", _TRANSPORT)
def vec22(spark, sf_dir):
    h = histograms(spark, sf_dir)
    pairs = h.alias("a").join(h.alias("b"), F.col("b.cell_id") == F.col("a.cell_id") + 1).select(F.col("a.cell_id").alias("pair_id"), F.col("a.histogram").alias("p"), F.col("b.histogram").alias("q"))
    return _round(X.transport_cost(pairs, X.ground_cost(V.vocabulary(spark, sf_dir))), "emd")


# Analysis.
@_query("anl1_top_categories", "SELECT label::INT AS label, count(*) AS n FROM embeddings WHERE label >= 0 GROUP BY label ORDER BY n DESC, label LIMIT 8")
def anl1(spark, sf_dir):
    return A.top_categories(V.tokens(spark, sf_dir).select("label"))


@_query("anl2_prototypes", f"{_H}, {_LAB}, p AS (SELECT label, word, avg(h) AS v FROM hist JOIN lab USING (cell_id) GROUP BY label, word) SELECT label, word, round(v, 6) + 0.0 AS v, row_number() OVER (PARTITION BY label ORDER BY v DESC, word) <= 5 AS top FROM p")
def anl2(spark, sf_dir):
    out = A.prototypes(labelled(spark, sf_dir)).select("label", "top_bins", F.posexplode("prototype").alias("word", "v"))
    return out.select("label", "word", F.round("v", 6).alias("v"), F.array_contains("top_bins", F.col("word")).alias("top"))


_PAIRS = "list_sum(list_transform(list_zip(a.histogram, b.histogram), lambda x: abs(x[1] - x[2])))"


@_query("anl3_within_l1", f"{_H}, {_LAB}, {_ARR}, j AS (SELECT cell_id, label, histogram FROM arr JOIN lab USING (cell_id)), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || cell_id)) AS r FROM j QUALIFY r <= 240) SELECT a.label, count(*) AS pairs, round(avg({_PAIRS}), 6) AS mean_l1 FROM k a JOIN k b ON a.label = b.label AND a.cell_id < b.cell_id GROUP BY a.label")
def anl3(spark, sf_dir):
    return _round(A.within_l1(labelled(spark, sf_dir)), "mean_l1")


@_query(
    "anl4_separation",
    f"""{_H}, {_LAB}, {_ARR}, j AS (SELECT cell_id, label, histogram FROM arr JOIN lab USING (cell_id)), t AS (SELECT label FROM j WHERE label >= 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 8),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || cell_id)) AS r FROM j WHERE label IN (SELECT label FROM t) QUALIFY r <= 10)
SELECT a.label = b.label AS same, count(*) AS pairs, round(avg({_PAIRS}), 6) AS mean_l1, round(avg(1 - list_cosine_similarity(a.histogram, b.histogram)), 6) AS mean_cosine FROM k a JOIN k b ON a.cell_id < b.cell_id GROUP BY 1""",
)
def anl4(spark, sf_dir):
    return _round(A.separation(labelled(spark, sf_dir)), "mean_l1", "mean_cosine")


_ACT = "act AS (SELECT word, sum(h) AS activation, count(*) FILTER (h > 1.0::DOUBLE / 64) AS support FROM hist GROUP BY word)"


@_query(
    "anl5_votes",
    f"""{_H}, {_LAB}, {_ACT}, b AS (SELECT cell_id, arg_max(word, (h, -word)) AS word FROM hist GROUP BY cell_id), c AS (SELECT word, label, count(*) AS n FROM b JOIN lab USING (cell_id) WHERE label >= 0 GROUP BY ALL), d AS (SELECT word, arg_max(label, (n, -label)) AS l, sum(n) AS v FROM c GROUP BY word)
SELECT act.word, coalesce(l, -1)::INT AS dominant_label, coalesce(v, 0)::BIGINT AS votes, round((activation - min(activation) OVER ()) / (max(activation) OVER () - min(activation) OVER ()), 6) AS activation FROM act LEFT JOIN d USING (word)""",
)
def anl5(spark, sf_dir):
    return _round(A.centroid_votes(labelled(spark, sf_dir)), "activation")


@_query("anl6_activation", f"{_H}, {_ACT} SELECT word, round(activation, 6) AS activation, support FROM act")
def anl6(spark, sf_dir):
    return _round(A.activation_stats(histograms(spark, sf_dir)), "activation")


@_query("anl6_activation_big", f"{_B} SELECT word, round(sum(h), 4) AS activation, count(*) FILTER (h > 1.0::DOUBLE / 128) AS support FROM bhist GROUP BY word")
def anl6b(spark, sf_dir):
    return _round(A.activation_stats(X.soft_histograms(V.big_tokens(spark, sf_dir), V.big_vocabulary(spark, sf_dir))), "activation", digits=4)


@_query(
    "anl7_near_far",
    f"""{_H}, {_ACT}, s AS (SELECT max(CASE WHEN n >= 4 THEN t ELSE 0 END) AS least FROM (SELECT t, count(*) FILTER (support >= t) AS n FROM act, (SELECT unnest([200, 80, 20, 5, 1]) AS t) WHERE activation > 0 GROUP BY t)),
w AS (SELECT act.word, centroid FROM act JOIN vocabulary USING (word), s WHERE support >= least AND activation > 0), p AS (SELECT a.word AS i, b.word AS j, round(list_cosine_similarity(a.centroid, b.centroid), 9) AS c FROM w a JOIN w b ON a.word < b.word),
n AS (SELECT i, j, c FROM p ORDER BY c DESC, i, j LIMIT 1), f AS (SELECT i, j, c FROM p ORDER BY c, i, j LIMIT 1) SELECT 'near' AS kind, i, j, round(c, 6) AS cosine FROM n UNION ALL SELECT 'far', i, j, round(c, 6) FROM f""",
)
def anl7(spark, sf_dir):
    return _round(A.near_far_pairs(V.vocabulary(spark, sf_dir), A.activation_stats(histograms(spark, sf_dir))), "cosine")


@_query("anl8_top_rows", f"{_H} SELECT word, rank, cell_id, round(h, 6) AS weight FROM (SELECT word, cell_id, h, row_number() OVER (PARTITION BY word ORDER BY h DESC, cell_id)::INT AS rank FROM hist WHERE h > 0) WHERE rank <= 5")
def anl8(spark, sf_dir):
    return _round(A.top_rows(histograms(spark, sf_dir), 5), "weight")


@_query(
    "anl9_top_patches",
    f"""{_H}, t AS (SELECT word, cell_id FROM (SELECT word, cell_id, row_number() OVER (PARTITION BY word ORDER BY h DESC, cell_id) AS r FROM hist) WHERE r <= 8),
e AS (SELECT word, cell_id, pos, w, row_number() OVER (PARTITION BY word, cell_id ORDER BY w DESC, pos) AS r FROM weights JOIN t USING (word, cell_id) QUALIFY r <= 6)
SELECT word, rank, cell_id, pos, pos // 4 AS token_row, pos % 4 AS token_col, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY w DESC, cell_id, pos)::INT AS rank FROM e) WHERE rank <= 16""",
)
def anl9(spark, sf_dir):
    h = histograms(spark, sf_dir)
    heavy = A.top_rows(h, 8).select("cell_id").distinct()
    w = A.token_weights(V.tokens(spark, sf_dir).join(heavy, "cell_id", "left_semi"), V.vocabulary(spark, sf_dir))
    out = A.top_patches(h, w, cells=8, side=4)
    return _round(out.withColumns({c: F.col(c).cast("int") for c in ("token_row", "token_col")}), "weight")


_WIDE = _H.replace("vec_id < 8", "vec_id < 16")


@_query(
    "anl10_pair_metrics",
    f"""{_WIDE}, t AS (SELECT word, cell_id FROM (SELECT word, cell_id, row_number() OVER (PARTITION BY word ORDER BY h DESC, cell_id) AS r FROM hist) WHERE r <= 16), m AS (SELECT t.word, h.word AS bin, avg(h) AS v FROM hist h JOIN t ON t.cell_id = h.cell_id GROUP BY t.word, h.word),
b AS (SELECT word, list(bin ORDER BY v DESC, bin)[1:10] AS bins FROM m GROUP BY word)
SELECT a.word AS i, c.word AS j, round(corr(a.v, c.v), 6) AS correlation, round(sum(abs(a.v - c.v)), 6) AS l1, len(list_intersect(any_value(x.bins), any_value(y.bins))) AS overlap FROM m a JOIN m c ON a.bin = c.bin AND a.word < c.word JOIN b x ON x.word = a.word JOIN b y ON y.word = c.word GROUP BY a.word, c.word""",
)
def anl10(spark, sf_dir):
    words = V.vocabulary(spark, sf_dir, 16)
    pairs = words.select(F.col("word").alias("i")).join(F.broadcast(words.select(F.col("word").alias("j"))), F.col("i") < F.col("j"))
    return _round(A.pair_metrics(X.soft_histograms(V.tokens(spark, sf_dir), words), pairs), "correlation", "l1")


#: The greedy choice by recursion over the slots: a theme's best row unless it is taken, the best free one where a theme has none; then others.
_THEMED = ", ".join(f"({k}, '{t}', {CATEGORIES.index(c)})" for k, (t, cs) in enumerate(THEMES.items()) for c in cs)
_PICKS = f"""WITH RECURSIVE {_H.removeprefix('WITH ')}, {_LAB}, e AS MATERIALIZED (SELECT cell_id, label, round(-sum(h * ln(h + 1e-12)), 9) AS e FROM hist JOIN lab USING (cell_id) GROUP BY cell_id, label),
a AS MATERIALIZED (SELECT list({{'c': cell_id, 'e': e}} ORDER BY e DESC, cell_id) AS free FROM e), t(slot, theme, label) AS (VALUES {_THEMED}),
b AS MATERIALIZED (SELECT slot, theme, arg_min({{'c': cell_id, 'e': e}}, (-e, cell_id)) FILTER (cell_id IS NOT NULL) AS best FROM t LEFT JOIN e USING (label) GROUP BY slot, theme),
s AS (SELECT -1 AS slot, (SELECT free FROM a) AS free, [] ::STRUCT(theme VARCHAR, c BIGINT, e DOUBLE)[] AS picked
  UNION ALL
  SELECT slot, list_filter(free, lambda x: x.c <> coalesce(pick.c, -1)), CASE WHEN list_contains(list_transform(free, lambda x: x.c), pick.c) THEN list_append(picked, {{'theme': theme, 'c': pick.c, 'e': pick.e}}) ELSE picked END
  FROM (SELECT b.slot, b.theme, s.free, s.picked, CASE WHEN b.best.c IS NULL THEN s.free[1] ELSE b.best END AS pick FROM s JOIN b ON b.slot = s.slot + 1)),
z AS (SELECT list_concat(picked, list_transform(free[1:greatest(0, 8 - len(picked))], lambda x: {{'theme': NULL::VARCHAR, 'c': x.c, 'e': x.e}})) AS p FROM s WHERE slot = {len(THEMES) - 1})
SELECT (i - 1)::INT AS slot, p[i].theme AS theme, p[i].c AS cell_id, round(p[i].e, 6) AS entropy FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM z)"""


@_query("anl11_themes", _PICKS)
def anl11(spark, sf_dir):
    return _round(A.theme_examples(labelled(spark, sf_dir)), "entropy")


@_query("anl12_sparsest", f"{_H}, e AS (SELECT cell_id, max(h) AS peak, -sum(h * ln(h + 1e-12)) AS e FROM hist GROUP BY cell_id) SELECT cell_id, round(peak, 6) AS peak, round(e, 6) AS entropy FROM e ORDER BY e.peak DESC, e.e, cell_id LIMIT 1")
def anl12(spark, sf_dir):
    return _round(A.sparsest(histograms(spark, sf_dir)), "peak", "entropy")


def _greedy(n: int) -> str:
    """One step for each further word: relative weight minus similarity to the words chosen."""
    steps = ["g1 AS MATERIALIZED (SELECT cell_id, [word] AS chosen FROM o WHERE r = 1)"]
    for k in range(2, n + 1):
        steps.append(
            f"""g{k} AS MATERIALIZED (SELECT cell_id, list_append(chosen, arg_max(word, (rel - 0.82 * sim, -sim, rel, -word))) AS chosen FROM (
  SELECT g.cell_id, g.chosen, o.word, any_value(o.rel) AS rel, max(m.s) AS sim FROM g{k - 1} g JOIN o ON o.cell_id = g.cell_id AND o.inside AND NOT list_contains(g.chosen, o.word) JOIN m ON m.cell_id = o.cell_id AND m.a = o.word AND list_contains(g.chosen, m.b) GROUP BY g.cell_id, g.chosen, o.word) GROUP BY cell_id, chosen)"""
        )
    return ",\n".join(steps)


_DIVERSE = f"""{_H}, r AS MATERIALIZED (SELECT cell_id, word, h, row_number() OVER (PARTITION BY cell_id ORDER BY h DESC, word) AS r, max(h) OVER (PARTITION BY cell_id) AS h0 FROM hist),
o AS MATERIALIZED (SELECT *, h / (h0 + 1e-8) AS rel, (h >= h0 * 0.18) OR count(*) FILTER (h >= h0 * 0.18) OVER (PARTITION BY cell_id) < 6 AS inside FROM r),
x AS MATERIALIZED (SELECT cell_id, word, list(w ORDER BY pos) AS w FROM weights GROUP BY cell_id, word),
m AS MATERIALIZED (SELECT a.cell_id, a.word AS a, b.word AS b, CASE WHEN sqrt(list_dot_product(a.w, a.w)) > 1e-8 AND sqrt(list_dot_product(b.w, b.w)) > 1e-8 THEN list_dot_product(a.w, b.w) / (sqrt(list_dot_product(a.w, a.w)) * sqrt(list_dot_product(b.w, b.w))) ELSE 0 END AS s FROM x a JOIN x b USING (cell_id)),
{_greedy(6)}
SELECT cell_id, array_to_string(chosen, ',') AS words FROM g6"""


@_query("anl13_diverse_words", _DIVERSE)
def anl13(spark, sf_dir):
    w = A.token_weights(V.tokens(spark, sf_dir), V.vocabulary(spark, sf_dir)).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("pos", "weights"))).alias("t"))
    out = A.diverse_words(histograms(spark, sf_dir).join(w.select("cell_id", F.transform("t", lambda x: x.weights).alias("weights")), "cell_id"))
    return out.select("cell_id", F.array_join("words", ",").alias("words"))


@_query(
    "anl14_heat",
    f"""{_H}, p AS (SELECT cell_id, word, quantile_cont(w, 0.55) AS lo, quantile_cont(w, 0.99) AS hi, min(w) AS lo2, max(w) AS hi2 FROM weights GROUP BY ALL), q AS (SELECT cell_id, word, CASE WHEN hi <= lo + 1e-8 THEN lo2 ELSE lo END AS lo, CASE WHEN hi <= lo + 1e-8 THEN hi2 ELSE hi END AS hi FROM p)
SELECT cell_id, word, pos, round(CASE WHEN hi <= lo + 1e-8 THEN 0 ELSE least(1, greatest(0, (w - lo) / (hi - lo + 1e-8))) END, 5) AS heat FROM weights JOIN q USING (cell_id, word)""",
)
def anl14(spark, sf_dir):
    w = A.token_weights(V.tokens(spark, sf_dir), V.vocabulary(spark, sf_dir)).select("cell_id", "pos", F.posexplode("weights").alias("word", "weight"))
    return A.heat(w).select("cell_id", "word", "pos", F.round("heat", 5).alias("heat"))


# Stores.
@_query("snk1_buckets", "SELECT ('0x' || substr(md5(vec_id::VARCHAR), 1, 2))::INT % 16 AS bucket, count(*) AS n FROM embeddings GROUP BY 1")
def snk1(spark, sf_dir):
    return K.bucketed(V.tokens(spark, sf_dir).select("vec_id"), "vec_id", 16).groupBy("bucket").agg(F.count("*").alias("n"))


@_query("snk2_numbered", f"{with_('tokens')} SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS row_no FROM (SELECT DISTINCT cell_id FROM tokens)")
def snk2(spark, sf_dir):
    return X.numbered(V.tokens(spark, sf_dir).select("cell_id").distinct(), "cell_id", "row_no").withColumn("row_no", F.col("row_no").cast("bigint"))
