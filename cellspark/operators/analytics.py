"""Vocabulary analytics over histograms (ANL1-ANL14).

``histograms`` is ``cell_id, histogram``; labelled ones also have ``label`` (-1: none).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cellspark.functions.vectors import argmax, dot, entropy, l1_distance, mean_vector, norm, sum_vector
from cellspark.operators import kernels
from cellspark.operators.sampling import cap_per_class, hash_order
from cellspark.operators.vectors import matrix
from cellspark.schemas import CATEGORIES, THEMES


def top_categories(labels: DataFrame, n: int = 8) -> DataFrame:
    """ANL1: ``label, n``: the most frequent labels, the smaller first on a tie."""
    return labels.where("label >= 0").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def prototypes(rows: DataFrame, top: int = 5) -> DataFrame:
    """ANL2: ``label, prototype, top_bins``: mean histogram of each label and its heaviest bins."""
    means = rows.where("label >= 0").groupBy("label").agg(mean_vector(F.col("histogram")).alias("prototype"))
    ranked = F.slice(F.array_sort(F.transform("prototype", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), 1, top)
    return means.withColumn("top_bins", F.transform(ranked, lambda x: x.i))


def within_l1(rows: DataFrame, most: int = 240, seed: int = 42) -> DataFrame:
    """ANL3: ``label, pairs, mean_l1`` over at most ``most`` rows of each label."""
    kept = cap_per_class(rows.where("label >= 0"), "label", "cell_id", most, seed).select("label", "cell_id", "histogram")
    a, b = kept.alias("a"), kept.alias("b")
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.cell_id") < F.col("b.cell_id")))
    return pairs.groupBy(F.col("a.label").alias("label")).agg(F.count("*").alias("pairs"), F.avg(l1_distance(F.col("a.histogram"), F.col("b.histogram"))).alias("mean_l1"))


def separation(rows: DataFrame, labels: int = 8, most: int = 10, seed: int = 42) -> DataFrame:
    """ANL4: ``same, pairs, mean_l1, mean_cosine``: distances between rows of equal and of different labels, over at most labels x most rows."""
    top = top_categories(rows, labels).select("label")
    kept = cap_per_class(rows.join(F.broadcast(top), "label", "left_semi"), "label", "cell_id", most, seed).select("label", "cell_id", "histogram")
    a, b = kept.alias("a"), kept.alias("b")
    pairs = a.join(F.broadcast(b), F.col("a.cell_id") < F.col("b.cell_id"))  # at most labels * most rows on either side
    x, y = F.col("a.histogram"), F.col("b.histogram")
    cosine = 1.0 - dot(x, y) / F.greatest(norm(x) * norm(y), F.lit(1e-12))
    return pairs.groupBy((F.col("a.label") == F.col("b.label")).alias("same")).agg(F.count("*").alias("pairs"), F.avg(l1_distance(x, y)).alias("mean_l1"), F.avg(cosine).alias("mean_cosine"))


def activation_stats(histograms: DataFrame) -> DataFrame:
    """ANL6: ``word, activation, support``: sum of weights, and rows with a weight above 1 / (8 K)."""
    each = histograms.select(F.posexplode("histogram").alias("word", "w"), F.size("histogram").alias("k"))
    return each.groupBy("word").agg(F.sum(F.col("w").cast("double")).alias("activation"), F.count_if(F.col("w") > 1.0 / (8 * F.col("k"))).alias("support"))


def centroid_votes(rows: DataFrame) -> DataFrame:
    """ANL5: ``word, dominant_label, votes, activation``: each labelled row votes for its heaviest word; -1 without votes; activation scaled to [0, 1]."""
    counts = rows.where("label >= 0").groupBy(argmax(F.col("histogram")).alias("word"), "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("word").agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("top"), F.sum("n").alias("votes"))
    stats = activation_stats(rows).select("word", "activation")
    whole = Window.partitionBy()
    lo, hi = F.min("activation").over(whole), F.max("activation").over(whole)  # K rows
    scaled = stats.withColumn("activation", F.when(hi > lo, (F.col("activation") - lo) / (hi - lo)).otherwise(0.0))
    return scaled.join(best, "word", "left").select("word", F.coalesce(-F.col("top.neg"), F.lit(-1)).alias("dominant_label"), F.coalesce("votes", F.lit(0)).alias("votes"), "activation")


def near_far_pairs(vocabulary: DataFrame, stats: DataFrame, most: int = 128, supports: Sequence[int] = (200, 80, 20, 5, 1), gaps: Sequence[int] = (24, 40, 64, 96)) -> DataFrame:
    """ANL7: ``kind, i, j, cosine``: the most similar pair of active words whose indices are close, and the least similar pair.

    Works on at most ``most`` active words with the highest support threshold that leaves
    four of them (all active ones if none does). Ties go to the smaller indices.
    """
    active = stats.where("activation > 0").orderBy(F.desc("activation"), F.desc("word")).limit(most)
    passed = F.array(*[F.count_if(F.col("support") >= s) >= 4 for s in supports])
    least = F.element_at(F.array(*map(F.lit, [*supports, 0])), (F.coalesce(F.nullif(F.array_position(passed, True), F.lit(0)), F.lit(len(supports) + 1))).cast("int"))
    kept = active.crossJoin(F.broadcast(active.agg(least.alias("least")))).where("support >= least").select("word")
    words = vocabulary.join(F.broadcast(kept), "word", "left_semi").select("word", "centroid")
    a, b = words.alias("a"), words.alias("b")
    x, y = F.col("a.centroid"), F.col("b.centroid")
    cosine = F.round(dot(x, y) / F.greatest(norm(x) * norm(y), F.lit(1e-12)), 12)
    pairs = a.join(F.broadcast(b), F.col("a.word") < F.col("b.word")).select(F.col("a.word").alias("i"), F.col("b.word").alias("j"), cosine.alias("cosine"))
    gap = F.col("j") - F.col("i")
    stage = F.coalesce(*[F.when(gap <= g, k) for k, g in enumerate(gaps)], F.lit(len(gaps)))
    near = pairs.orderBy(stage, F.desc("cosine"), "i", "j").limit(1).select(F.lit("near").alias("kind"), "i", "j", "cosine")
    others = pairs.join(F.broadcast(near.select("i", "j")), ["i", "j"], "left_anti")
    only = pairs.orderBy("cosine", "i", "j").limit(1).withColumn("_o", F.lit(1))
    far = others.orderBy("cosine", "i", "j").limit(1).withColumn("_o", F.lit(0)).unionByName(only).orderBy("_o").limit(1)
    return near.unionByName(far.select(F.lit("far").alias("kind"), "i", "j", "cosine"))


def top_rows(histograms: DataFrame, n: int) -> DataFrame:
    """ANL8: ``word, rank, cell_id, weight``: the n heaviest rows of each word, for all words at once; rows without weight are left out before the explode meets a window."""
    each = histograms.select("cell_id", F.posexplode("histogram").alias("word", "weight")).where("weight > 0")
    w = Window.partitionBy("word").orderBy(F.desc("weight"), "cell_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("word", "rank", "cell_id", "weight")


def top_patches(histograms: DataFrame, token_weights: DataFrame, cells: int = 8, per_cell: int = 6, overall: int = 16, side: int = 16) -> DataFrame:
    """ANL9: ``word, rank, cell_id, pos, token_row, token_col, weight`` from ``token_weights`` (``cell_id, pos, weights``): strongest tokens of the heaviest cells of each word."""
    heavy = top_rows(histograms, cells).select("word", "cell_id")
    each = token_weights.join(heavy, "cell_id").select("word", "cell_id", "pos", F.get(F.col("weights"), F.col("word")).alias("weight"))
    inside = Window.partitionBy("word", "cell_id").orderBy(F.desc("weight"), "pos")
    across = Window.partitionBy("word").orderBy(F.desc("weight"), "cell_id", "pos")
    kept = each.withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= per_cell).withColumn("rank", F.row_number().over(across)).where(F.col("rank") <= overall)
    return kept.select("word", "rank", "cell_id", "pos", F.floor(F.col("pos") / side).alias("token_row"), (F.col("pos") % side).alias("token_col"), "weight")


def token_weights(tokens: DataFrame, vocabulary: DataFrame, beta: float = 10.0) -> DataFrame:
    """``cell_id, pos, weights``: the soft assignment of every token."""
    _, centroids = matrix(vocabulary)
    shared = tokens.sparkSession.sparkContext.broadcast(kernels.unit_rows(centroids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                w = kernels.soft_weights(kernels.unit_rows(np.array(batch["_v"].tolist(), np.float64)), shared.value, beta)
                yield batch.drop(columns="_v").assign(weights=list(w))

    source = tokens.select("cell_id", "pos", F.col("token").cast("array<double>").alias("_v"))
    return source.mapInPandas(run, source.drop("_v").schema.add("weights", ArrayType(DoubleType())))


def pair_metrics(histograms: DataFrame, pairs: DataFrame, rows: int = 16, top: int = 10) -> DataFrame:
    """ANL10: ``i, j, correlation, l1, overlap`` of the mean histograms over each word's heaviest rows."""
    heavy = top_rows(histograms, rows).select("word", "cell_id")
    means = histograms.join(heavy, "cell_id").groupBy("word").agg(mean_vector(F.col("histogram")).alias("mean"))
    bins = F.transform(F.slice(F.array_sort(F.transform("mean", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), 1, top), lambda x: x.i)
    means = means.withColumn("bins", bins)
    both = pairs.select("i", "j").join(means.select(F.col("word").alias("i"), F.col("mean").alias("a"), F.col("bins").alias("ba")), "i").join(means.select(F.col("word").alias("j"), F.col("mean").alias("b"), F.col("bins").alias("bb")), "j")
    each = both.withColumn("x", F.explode(F.arrays_zip("a", "b")))
    return each.groupBy("i", "j").agg(F.corr("x.a", "x.b").alias("correlation"), F.sum(F.abs(F.col("x.a") - F.col("x.b"))).alias("l1"), F.first(F.size(F.array_intersect("ba", "bb"))).alias("overlap"))


def theme_examples(rows: DataFrame, n: int = 8, themes: Mapping[str, Sequence[str]] = THEMES) -> DataFrame:
    """ANL11: ``slot, theme, cell_id, entropy``: the row of highest entropy of each theme, the overall best where a theme has none, then others up to n, all different."""
    spark = rows.sparkSession
    number = {c: i for i, c in enumerate(CATEGORIES)}
    table = spark.createDataFrame([(k, t, number[c]) for k, (t, cs) in enumerate(themes.items()) for c in cs], "slot INT, theme STRING, label INT")
    slots = spark.createDataFrame([(k, t) for k, t in enumerate(themes)], "slot INT, theme STRING")
    scored = rows.select("cell_id", "label", F.round(entropy(F.col("histogram"), drop_zeros=False), 9).alias("entropy"))
    # A theme's n best and the n best of all are all that can be chosen.
    w = Window.partitionBy("slot").orderBy(F.desc("entropy"), "cell_id")
    of_theme = scored.join(F.broadcast(table), "label").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n + len(themes))
    overall = scored.orderBy(F.desc("entropy"), "cell_id").limit(2 * n + len(themes))
    candidates = {k: [] for k in range(len(themes))}
    for r in of_theme.orderBy("slot", "r").collect():
        candidates[r.slot].append((r.cell_id, r.entropy))
    best = [(r.cell_id, r.entropy) for r in overall.collect()]
    out, used = [], set()
    for k, theme in enumerate(themes):
        pick = candidates[k][0] if candidates[k] else next((x for x in best if x[0] not in used), None)
        if pick and pick[0] not in used:
            used.add(pick[0])
            out.append((len(out), theme, pick[0], pick[1]))
    for cell, e in best:
        if len(out) >= n:
            break
        if cell not in used:
            used.add(cell)
            out.append((len(out), None, cell, e))
    kind = rows.schema["cell_id"].dataType.simpleString()
    return spark.createDataFrame(out, f"slot INT, theme STRING, cell_id {kind}, entropy DOUBLE")


def sparsest(rows: DataFrame) -> DataFrame:
    """ANL12: the row with the largest single weight, of these the one with the lowest entropy."""
    e = F.round(entropy(F.col("histogram"), drop_zeros=False), 9)
    order = F.struct(F.array_max("histogram").alias("m"), (-e).alias("e"), (-F.col("cell_id")).alias("c"))
    return rows.agg(F.max_by(F.struct("cell_id", F.array_max("histogram").alias("peak"), e.alias("entropy")), order).alias("x")).select("x.*")


def diverse_words(cells: DataFrame, n: int = 6, pool: int = 64, cutoff: float = 0.18, penalty: float = 0.82) -> DataFrame:
    """ANL13: ``cell_id, words`` of cell-major rows (``cell_id, histogram, weights`` with one row of weights for each token)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [kernels.diverse_words(np.asarray(h, np.float64), np.array([np.asarray(r, np.float64) for r in w]), n, pool, cutoff, penalty) for h, w in zip(batch["histogram"], batch["weights"])]
            yield pd.DataFrame({"cell_id": batch["cell_id"], "words": words})

    kind = cells.schema["cell_id"].dataType.simpleString()
    return cells.select("cell_id", "histogram", "weights").mapInPandas(run, f"cell_id {kind}, words array<int>")


def heat(token_heat: DataFrame, low: float = 0.55, high: float = 0.99) -> DataFrame:
    """ANL14: adds ``heat`` in [0, 1] to ``cell_id, word, pos, weight``: between two percentiles, or min and max where these coincide, else 0."""
    stats = token_heat.groupBy("cell_id", "word").agg(F.percentile("weight", low).alias("lo"), F.percentile("weight", high).alias("hi"), F.min("weight").alias("lo2"), F.max("weight").alias("hi2"))
    flat, flat2 = F.col("hi") <= F.col("lo") + 1e-8, F.col("hi2") <= F.col("lo2") + 1e-8
    a, b = F.when(flat, F.col("lo2")).otherwise(F.col("lo")), F.when(flat, F.col("hi2")).otherwise(F.col("hi"))
    value = F.when(flat & flat2, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("weight") - a) / (b - a + 1e-8))))
    return token_heat.join(stats, ["cell_id", "word"]).withColumn("heat", value).drop("lo", "hi", "lo2", "hi2")
