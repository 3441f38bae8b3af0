"""Queries on paths, joins and sampling (PRJ, JON, SMP)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.functions import paths as P
from cellspark.operators import joins as J
from cellspark.operators import sampling as S
from cellspark.plans.views import images, paths, table, with_
from cellspark.sources.scratch import fresh
from cellspark.sources.sinks import write_joinable

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_STRIP = "CASE WHEN starts_with({0}, 'Hosted-Datasets/fmow/fmow-rgb/') THEN substr({0}, 31) WHEN starts_with({0}, 'Hosted-Datasets/fmow/fmow-rgb-prepped/') THEN substr({0}, 39) ELSE {0} END"
_INNER = "CASE WHEN strpos(s, '/data/fmow/') > 0 THEN substr(s, strpos(s, '/data/fmow/') + 11) ELSE s END"


@_query("prj1_strip_prefix", f"{with_('paths')} SELECT pos, {_STRIP.format('raw')} AS stripped FROM paths")
def prj1(spark, sf_dir):
    return paths(spark, sf_dir).select("pos", P.strip_prefix(F.col("raw")).alias("stripped"))


@_query("prj2_canonical", f"{with_('paths')}, t AS (SELECT pos, {_STRIP.format(chr(39).join(['replace(raw, ', chr(92), ', ', '/', ')']))} AS s FROM paths) SELECT pos, regexp_replace(regexp_replace({_INNER}, '^data/fmow/', ''), '^[./]+', '') AS canonical FROM t")
def prj2(spark, sf_dir):
    return paths(spark, sf_dir).select("pos", P.canonical_rel_path(F.col("raw")).alias("canonical"))


@_query("prj3_category", f"{with_('paths')} SELECT pos, nullif(regexp_extract(raw, '(?:train|val)/([^/]+)/', 1), '') AS category FROM paths")
def prj3(spark, sf_dir):
    return paths(spark, sf_dir).select("pos", P.category_of(F.col("raw")).alias("category"))


@_query("prj4_filter_files", f"{with_('paths')}, t AS (SELECT path FROM paths WHERE len(string_split(path, '/')) >= 2 AND string_split(path, '/')[1] IN ('train', 'val') AND ends_with(path, '_rgb.jpg')) SELECT path FROM t UNION SELECT regexp_replace(path, '\\.jpg$', '.json') FROM t")
def prj4(spark, sf_dir):
    return P.filter_files(paths(spark, sf_dir), ("train", "val"), msrgb=False)


@_query("prj5_manifest", f"{with_('paths')} SELECT path AS img_path, regexp_replace(path, '\\.jpg$', '.json') AS json_path FROM paths WHERE ends_with(path, '_msrgb.jpg') AND len(string_split(path, '/')) >= 3 AND string_split(path, '/')[1] = 'train'")
def prj5(spark, sf_dir):
    return P.build_manifest(paths(spark, sf_dir), "train")


_CAT = "cat AS (SELECT pos, nullif(regexp_extract(path, '(?:train|val)/([^/]+)/', 1), '') AS category, path, source, lang FROM paths)"


def _categories(spark, sf_dir) -> DataFrame:
    return paths(spark, sf_dir).select("pos", P.category_of(F.col("path")).alias("category"), "path", "source", "lang")


@_query("prj6a_label_list", f"{with_('paths', 'names')}, {_CAT} SELECT pos, cat.category, coalesce(label, -1)::INT AS label FROM cat LEFT JOIN names ON cat.category = names.category")
def prj6a(spark, sf_dir):
    return P.label_by_list(_categories(spark, sf_dir)).select("pos", "category", "label")


@_query("prj6b_label_appearance", f"{with_('paths')}, {_CAT} SELECT category, (row_number() OVER (ORDER BY min(pos)) - 1)::INT AS label FROM cat WHERE category IS NOT NULL GROUP BY category")
def prj6b(spark, sf_dir):
    return P.label_by_appearance(_categories(spark, sf_dir))


@_query("prj6c_label_name", f"{with_('paths')}, {_CAT} SELECT category, (row_number() OVER (ORDER BY category) - 1)::INT AS label FROM cat WHERE category IS NOT NULL GROUP BY category")
def prj6c(spark, sf_dir):
    return P.label_by_name(_categories(spark, sf_dir))


@_query("prj7_label_report", f"{with_('paths', 'names')}, {_CAT}, l AS (SELECT cat.category, coalesce(label, -1)::INT AS label FROM cat LEFT JOIN names ON cat.category = names.category) SELECT CASE WHEN category IS NULL THEN 'unlabelled' WHEN label < 0 THEN 'unknown' ELSE 'labelled' END AS kind, label, count(*) AS n FROM l GROUP BY 1, 2")
def prj7(spark, sf_dir):
    return P.label_report(_categories(spark, sf_dir))


@_query("prj8_cache_key", with_("paths") + """ SELECT pos, sha1('{"cell_size": 512, "image": "' || path || '", "output_shape": [256, 1024], "output_type": "patch_tokens_bovw", "weights_mtime": ' || CASE WHEN pos % 2 = 0 THEN 'null' ELSE pos::VARCHAR END || ', "weights_path": "w.pth", "weights_size": null}') AS cache_key FROM paths""")
def prj8(spark, sf_dir):
    key = P.cache_key(F.col("path"), F.lit("w.pth"), F.when(F.col("pos") % 2 != 0, F.col("pos")), F.lit(None))
    return paths(spark, sf_dir).select("pos", key.alias("cache_key"))


@_query("prj10_shard", f"{with_('paths')} SELECT pos, path FROM paths WHERE pos < 500 AND pos % 4 = 1")
def prj10(spark, sf_dir):
    return P.shard(paths(spark, sf_dir), 1, 4, 500).select("pos", "path")


_BUCKET = "(((((('0x' || substr(md5({0}), 1, 8))::BIGINT % 10000) * 4294967296::BIGINT + ('0x' || substr(md5({0}), 9, 8))::BIGINT) % 10000) * 4294967296::BIGINT + ('0x' || substr(md5({0}), 17, 8))::BIGINT) % 10000 * 4294967296::BIGINT + ('0x' || substr(md5({0}), 25, 8))::BIGINT) % 10000"


@_query("prj11_hash_split", f"{with_('paths')} SELECT pos, ({_BUCKET.format('raw')})::BIGINT AS bucket, ({_BUCKET.format('raw')}) < 1000 AS is_val FROM paths")
def prj11(spark, sf_dir):
    return paths(spark, sf_dir).select("pos", P.md5_bucket(F.col("raw")).alias("bucket"), P.is_validation(F.col("raw"), 0.1).alias("is_val"))


@_query(
    "prj12_size_summary",
    f"""{with_('images')}, s AS (SELECT 'width' AS side, raw_w AS v FROM images UNION ALL SELECT 'height', raw_h FROM images),
t AS (SELECT side, count(*) AS n, avg(v) AS mean, median(v)::DOUBLE AS median, min(v) AS lo, max(v) AS hi FROM s GROUP BY side),
b AS (SELECT side, least(39, floor((v - lo) * 40 / (hi - lo)))::INT AS bin, count(*) AS k FROM s JOIN t USING (side) GROUP BY 1, 2),
g AS (SELECT side, unnest(range(40)) AS bin FROM t)
SELECT side, n, round(mean, 6) AS mean, median, lo, hi, bin::INT AS bin, coalesce(k, 0) AS k FROM g JOIN t USING (side) LEFT JOIN b USING (side, bin)""",
)
def prj12(spark, sf_dir):
    out = P.size_summary(images(spark, sf_dir).select(F.col("raw_w").alias("width"), F.col("raw_h").alias("height")))
    return out.select("side", "n", F.round("mean", 6).alias("mean"), "median", "lo", "hi", F.posexplode("counts").alias("bin", "k"))


# Joins. ``labels`` covers part of the documents and stands for the files that exist.
_LISTED = "listing AS (SELECT path FROM paths JOIN labels ON pos = doc_id)"


def _listing(spark, sf_dir) -> DataFrame:
    return paths(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos")), "pos").select("path")


@_query("jon1_existing", f"{with_('paths')}, {_LISTED} SELECT pos, path FROM paths WHERE path IN (SELECT path FROM listing)")
def jon1(spark, sf_dir):
    return J.existing(paths(spark, sf_dir).select("pos", "path"), _listing(spark, sf_dir)).select("pos", "path")


@_query(
    "jon1_coverage",
    f"""{with_('paths')}, {_LISTED}, l AS (SELECT DISTINCT path, 1 AS there FROM listing), c AS (SELECT coalesce(nullif(string_split(path, '/')[2], ''), 'unknown') AS category, there FROM paths LEFT JOIN l USING (path))
SELECT category, count(there) AS found, count(*) - count(there) AS missing, round(count(there) * 100.0 / count(*), 6)::DOUBLE AS percent FROM c GROUP BY ROLLUP (category)""",
)
def jon1_coverage(spark, sf_dir):
    rows = paths(spark, sf_dir).select("path", P.part(F.col("path"), 1).alias("category"))
    return J.coverage(rows, _listing(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@_query("jon2_remaining", f"{with_('paths')} SELECT pos, path FROM paths WHERE pos NOT IN (SELECT doc_id FROM labels)")
def jon2(spark, sf_dir):
    return J.remaining(paths(spark, sf_dir).select("pos", "path"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos")), ["pos"])


@_query("jon3_append", f"{with_('paths')} SELECT doc_id AS pos, 'old' AS run FROM labels UNION ALL SELECT pos, 'new' FROM paths WHERE pos NOT IN (SELECT doc_id FROM labels)")
def jon3(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.lit("old").alias("run"))
    return J.append_resumed(old, paths(spark, sf_dir).select("pos", F.lit("new").alias("run")), ["pos"])


_TRAINING = f"""{with_('paths')} SELECT p.pos AS cell_id, p.raw, c.n AS n_words, coalesce(l.quality, -1)::INT AS label, ({_BUCKET.format('p.raw')}) < 2000 AS is_val
FROM paths p JOIN (SELECT doc_id, n_chars AS n FROM documents WHERE doc_id % 5 <> 0) c ON c.doc_id = p.pos LEFT JOIN labels l ON l.doc_id = p.pos"""


@_query("jon4_training_table", _TRAINING)
def jon4(spark, sf_dir):
    manifest = paths(spark, sf_dir).select(F.col("pos").alias("cell_id"), "raw")
    stored = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("cell_id"), F.col("n_chars").alias("n_words"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cell_id"), F.col("quality").alias("label"))
    return J.training_table(manifest, stored, labels, "raw", 0.2)


@_query("jon4_from_stores", _TRAINING)
def jon4b(spark, sf_dir):
    """The same from three stored tables in buckets of the cell, joined where they are."""
    manifest = paths(spark, sf_dir).select(F.col("pos").alias("cell_id"), "raw")
    counts = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("cell_id"), F.col("n_chars").alias("n_words"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cell_id"), F.col("quality").alias("label"))
    name = uuid.uuid4().hex
    stored = [write_joinable(rows, f"{kind}_{name}", fresh(spark, kind), buckets=8) for kind, rows in (("manifest", manifest), ("counts", counts), ("labels", labels))]
    return J.training_table(*stored, "raw", 0.2)


@_query(
    "jon5_label_fallback",
    f"""{with_('paths', 'names')}, {_CAT} SELECT pos AS cell_id, coalesce(CASE WHEN l.quality > 0 THEN l.quality ELSE NULL END, CASE WHEN pos % 3 = 0 THEN (pos % 63) END, n.label, -1)::INT AS label
FROM cat LEFT JOIN labels l ON l.doc_id = pos LEFT JOIN names n ON n.category = cat.category""",
)
def jon5(spark, sf_dir):
    cells = _categories(spark, sf_dir).select(F.col("pos").alias("cell_id"), "category", F.when(F.col("pos") % 3 == 0, F.col("pos") % 63).otherwise(-1).cast("int").alias("dominant_label"))
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cell_id"), F.when(F.col("quality") > 0, F.col("quality")).otherwise(-1).alias("label"))
    return J.label_fallback(cells, stored).select("cell_id", "label")


@_query(
    "jon6_resolve_keys",
    f"""{with_('paths')}, e AS (SELECT md5(path) AS key, path AS canonical, pos AS entry_id FROM paths WHERE pos % 3 <> 1),
t AS (SELECT pos, path, unnest([md5(path || '?'), md5(raw), md5(path)]) AS key, unnest([0, 1, 2]) AS prio FROM paths WHERE pos % 5 <> 4),
h AS (SELECT pos, min_by(entry_id, (prio, entry_id)) AS entry_id FROM t JOIN e USING (key) GROUP BY pos), f AS (SELECT canonical, min(entry_id) AS entry_id FROM e GROUP BY canonical)
SELECT p.pos AS record_id, coalesce(h.entry_id, f.entry_id) AS entry_id, CASE WHEN h.entry_id IS NOT NULL THEN 'key' WHEN f.entry_id IS NOT NULL THEN 'path' END AS how FROM paths p LEFT JOIN h ON h.pos = p.pos LEFT JOIN f ON f.canonical = p.path""",
)
def jon6(spark, sf_dir):
    p = paths(spark, sf_dir)
    entries = p.where("pos % 3 <> 1").select(F.md5("path").alias("key"), F.col("path").alias("canonical"), F.col("pos").alias("entry_id"))
    tried = F.when(F.col("pos") % 5 != 4, F.array(F.md5(F.concat("path", F.lit("?"))), F.md5("raw"), F.md5("path"))).otherwise(F.array().cast("array<string>"))
    return J.resolve_keys(p.select(F.col("pos").alias("record_id"), tried.alias("candidates"), F.col("path").alias("canonical")), entries)


@_query(
    "jon7_lookup_fallback",
    f"""{with_('images', 'cells')}, pc AS (SELECT image, cell_row, cell_col, image * 10 + cell_row + cell_col AS v FROM cells WHERE image % 3 = 0 OR (image % 3 = 1 AND cell_row = 0 AND cell_col = 0)), pi AS (SELECT image, -image AS v FROM images WHERE image % 2 = 0)
SELECT c.image, c.cell_row, c.cell_col, coalesce(a.v, b.v, d.v)::BIGINT AS v FROM cells c LEFT JOIN pc a USING (image, cell_row, cell_col) LEFT JOIN pi b ON b.image = c.image LEFT JOIN pc d ON d.image = c.image AND d.cell_row = 0 AND d.cell_col = 0""",
)
def jon7(spark, sf_dir):
    from cellspark.operators.geometry import cells

    im = images(spark, sf_dir).select("image", "width", "height")
    c = cells(im, 512).select("image", "cell_row", "cell_col")
    per_cell = c.where("image % 3 = 0 OR (image % 3 = 1 AND cell_row = 0 AND cell_col = 0)").withColumn("v", F.col("image") * 10 + F.col("cell_row") + F.col("cell_col"))
    return J.lookup_fallback(c, per_cell, im.where("image % 2 = 0").select("image", (-F.col("image")).alias("v")), "v").select("image", "cell_row", "cell_col", "v")


_FOLDED = "f AS (SELECT pos, source, (row_number() OVER (PARTITION BY source ORDER BY md5('42:' || pos)) - 1)::INT % 5 AS fold FROM paths)"


@_query("jon8_fold_splits", f"{with_('paths')}, {_FOLDED}, e AS (SELECT *, unnest(range(5))::INT AS eval_fold FROM f) SELECT eval_fold, CASE WHEN fold = eval_fold THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(pos)::BIGINT AS s FROM e GROUP BY 1, 2")
def jon8(spark, sf_dir):
    folded = S.stratified_folds(paths(spark, sf_dir).select("pos", "source"), "source", "pos", 5)
    return J.fold_splits(folded, 5).groupBy("eval_fold", "part").agg(F.count("*").alias("n"), F.sum("pos").alias("s"))


# Sampling.
_RANK = "row_number() OVER (PARTITION BY {0} ORDER BY md5('42:' || pos))"


@_query(
    "smp1_stratified",
    f"""{with_('paths')}, z AS (SELECT lang, count(*) AS size, row_number() OVER (ORDER BY lang) AS no, count(*) OVER () AS classes FROM paths GROUP BY lang),
q AS (SELECT lang, least(size, greatest(1, 300 // classes) + CASE WHEN no <= 300 - greatest(1, 300 // classes) * classes THEN 1 ELSE 0 END) AS quota FROM z),
r AS (SELECT pos, lang, quota, {_RANK.format('lang')} AS rk FROM paths JOIN q USING (lang))
SELECT pos, lang FROM (SELECT pos, lang FROM r ORDER BY CASE WHEN rk <= quota THEN 0 ELSE 1 END, CASE WHEN rk <= quota THEN rk END NULLS FIRST, md5('42:' || pos) LIMIT 300)""",
)
def smp1(spark, sf_dir):
    return S.sample_stratified(paths(spark, sf_dir).select("pos", "lang"), "lang", "pos", 300)


@_query("smp2_fraction", f"{with_('paths')}, r AS (SELECT pos, lang, {_RANK.format('lang')} AS rk, count(*) OVER (PARTITION BY lang) AS n FROM paths) SELECT pos, lang FROM r WHERE rk <= greatest(1, floor(n * 0.25))")
def smp2(spark, sf_dir):
    return S.sample_fraction(paths(spark, sf_dir).select("pos", "lang"), "lang", "pos", 0.25)


@_query("smp3_cap", f"{with_('paths')}, r AS (SELECT pos, lang, {_RANK.format('lang')} AS rk FROM paths) SELECT pos, lang FROM r WHERE rk <= 50")
def smp3(spark, sf_dir):
    return S.cap_per_class(paths(spark, sf_dir).select("pos", "lang"), "lang", "pos", 50)


@_query("smp4_folds", f"{with_('paths')}, {_FOLDED} SELECT pos, source, fold FROM f")
def smp4(spark, sf_dir):
    return S.stratified_folds(paths(spark, sf_dir).select("pos", "source"), "source", "pos", 5)


@_query("smp5_subsample", f"{with_('paths')} SELECT pos, path FROM paths ORDER BY md5('42:' || pos), pos LIMIT 200")
def smp5(spark, sf_dir):
    return S.subsample(paths(spark, sf_dir).select("pos", "path"), "pos", 200)


@_query(
    "smp6_subsample_tokens",
    f"""{with_('tokens')}, n AS (SELECT count(DISTINCT cell_id) AS c FROM tokens), r AS (SELECT cell_id, pos, row_number() OVER (PARTITION BY cell_id ORDER BY md5('42:' || cell_id || ':' || pos), pos) AS rk, greatest(1, 200 // c) AS quota, c FROM tokens, n)
SELECT cell_id, pos FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || cell_id), cell_id, rk) AS o FROM r WHERE rk <= quota) WHERE quota * c <= 200 OR o <= 200""",
)
def smp6(spark, sf_dir):
    from cellspark.plans.views import tokens

    return S.subsample_tokens(tokens(spark, sf_dir).select("cell_id", "pos"), 200)


@_query("smp7_fit_sample", f"{with_('tokens')}, r AS (SELECT cell_id, vec_id, row_number() OVER (PARTITION BY cell_id ORDER BY md5('42:' || vec_id)) AS rk FROM tokens) SELECT cell_id, vec_id FROM r WHERE rk <= 4")
def smp7(spark, sf_dir):
    from cellspark.plans.views import tokens

    return S.fit_sample(tokens(spark, sf_dir).select("cell_id", "vec_id"), "cell_id", "vec_id", 4)


@_query(
    "smp8_group_order",
    f"""{with_('tokens')}, i AS (SELECT cell_id, row_number() OVER (ORDER BY md5('45:' || cell_id), cell_id) - 1 AS no FROM (SELECT DISTINCT cell_id FROM tokens)),
c AS (SELECT cell_id, vec_id, row_number() OVER (PARTITION BY cell_id ORDER BY md5('45:' || cell_id || ':' || vec_id), vec_id) AS k FROM tokens)
SELECT no % 4 AS rank, row_number() OVER (PARTITION BY no % 4 ORDER BY no, k) - 1 AS position, vec_id AS cell_id FROM c JOIN i USING (cell_id) WHERE k <= 6""",
)
def smp8(spark, sf_dir):
    from cellspark.plans.views import tokens

    out = S.group_order(tokens(spark, sf_dir).select(F.col("cell_id").alias("image"), "vec_id"), "image", "vec_id", ranks=4, per_group=6, epoch=3)
    return out.select(F.col("rank").cast("bigint").alias("rank"), F.col("position").cast("bigint").alias("position"), "cell_id")
