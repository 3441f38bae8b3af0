"""Classification, pixel and detection metrics, log parsing and sweep tables (MET1-MET9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspark.operators.geometry import iou
from cellspark.operators.sampling import positions


def classification(rows: DataFrame, k: int = 5) -> DataFrame:
    """MET1: ``top1, topk, precision, recall, f1`` in percent (macro, over labels seen in truth or prediction) of ``y_true, y_pred`` and, for topk, ``scores``."""
    confusion = rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    right = F.col("y_true") == F.col("y_pred")
    sides = confusion.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(0).alias("side")), F.struct(F.col("y_pred").alias("label"), F.lit(1).alias("side")))).alias("x"), "n", right.alias("right"))
    each = sides.groupBy("x.label").agg(
        F.sum(F.when((F.col("x.side") == 0) & F.col("right"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when((F.col("x.side") == 1) & ~F.col("right"), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when((F.col("x.side") == 0) & ~F.col("right"), F.col("n")).otherwise(0)).alias("fn")
    )
    share = lambda a, b: F.when(F.col("tp") + F.col(b) > 0, F.col("tp") / (F.col("tp") + F.col(b))).otherwise(0.0)
    scored = each.withColumn("p", share("tp", "fp")).withColumn("r", share("tp", "fn"))
    scored = scored.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    macro = scored.agg((F.avg("p") * 100).alias("precision"), (F.avg("r") * 100).alias("recall"), (F.avg("f") * 100).alias("f1"))
    rank = F.lit(0)
    if "scores" in rows.columns:
        own = F.get(F.col("scores"), F.col("y_true"))
        rank = F.size(F.filter("scores", lambda s, i: (s > own) | ((s == own) & (i < F.col("y_true")))))
    else:
        rank = F.when(right, 0).otherwise(k)
    tops = rows.agg((F.avg(right.cast("double")) * 100).alias("top1"), (F.avg((rank < k).cast("double")) * 100).alias("topk"))
    return tops.crossJoin(macro)  # one row each


def majority_label(boxes: DataFrame, image: str = "image", label: str = "label", pos: str = "pos") -> DataFrame:
    """MET2: the most common label of each image, the first seen on a tie, the larger label where that is one position."""
    counts = boxes.groupBy(image, label).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counts.groupBy(image).agg(F.max_by(label, F.struct("n", (-F.col("first")).alias("f"), label)).alias("label"))


def fold_summary(rows: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """MET3: mean and population deviation of each metric over the folds."""
    return rows.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("folds"))


def weighted_mean(rows: DataFrame, value: str = "value", weight: str = "n", label: str | None = None) -> DataFrame:
    """MET4: sum of value x weight over sum of weights; rows with label -1 left out."""
    kept = rows.where(F.col(label) != -1) if label else rows
    return kept.agg(F.sum(weight).alias("n"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def pixel_change(pixels: DataFrame, batch: Sequence[str] = ("batch_id",), threshold: float = 0.5, smooth: float = 1e-6) -> DataFrame:
    """MET5: ``how, precision, recall, f1, iou`` of ``pred_prob`` against ``mask > 127``: the mean of the batches' ratios, and the ratios of all pixels."""
    p, y = F.col("pred_prob") > threshold, F.col("mask") > 127
    sums = pixels.groupBy(*batch).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))

    def ratios(tp: Column, fp: Column, fn: Column) -> list[Column]:
        precision, recall = tp / (tp + fp + smooth), tp / (tp + fn + smooth)
        return [precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + smooth)).alias("f1"), (tp / (tp + fp + fn + smooth)).alias("iou")]

    each = sums.select(*ratios(F.col("tp"), F.col("fp"), F.col("fn")))
    macro = each.agg(*[F.avg(c).alias(c) for c in each.columns]).withColumn("how", F.lit("batches"))
    micro = sums.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).select(*ratios(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("how", F.lit("pixels"))
    return macro.unionByName(micro).select("how", "precision", "recall", "f1", "iou")


def match_intervals(predictions: DataFrame, truths: DataFrame, image: str = "image_id", label: int = 1) -> DataFrame:
    """MET7: ``image, pred_id, score, low, high``: a prediction is a true positive at just the thresholds above ``low`` up to ``high``.

    ``high`` is the overlap with its best truth, 0 without one; ``low`` the best overlap of the
    predictions before it that have the same best truth: up to there one of them takes it. So
    one match does for all thresholds. A second-best truth is not tried.
    """
    p, t = predictions.where(F.col("label") == label).alias("p"), truths.where(F.col("label") == label).alias("t")
    meet = (F.col("p.x0") < F.col("t.x1")) & (F.col("t.x0") < F.col("p.x1")) & (F.col("p.y0") < F.col("t.y1")) & (F.col("t.y0") < F.col("p.y1"))
    # Boxes that don't meet have no overlap and reach no threshold.
    pairs = p.join(t, (F.col(f"p.{image}") == F.col(f"t.{image}")) & meet).select(f"p.{image}", "p.pred_id", "t.gt_id", iou("p", "t").alias("iou"))
    best = pairs.groupBy(image, "pred_id").agg(F.max(F.struct("iou", (-F.col("gt_id")).alias("g"))).alias("b")).select(image, "pred_id", F.col("b.iou").alias("high"), F.col("b.g").alias("_truth"))
    each = p.select(image, "pred_id", "score").join(best, [image, "pred_id"], "left")
    before = Window.partitionBy(image, "_truth").orderBy(F.desc("score"), "pred_id").rowsBetween(Window.unboundedPreceding, -1)
    low = F.when(F.col("_truth").isNotNull(), F.max("high").over(before))
    return each.withColumn("low", F.coalesce(low, F.lit(0.0))).select(image, "pred_id", "score", "low", F.coalesce("high", F.lit(0.0)).alias("high"))


def _checked(thresholds: Sequence[float]) -> Column:
    bad = [t for t in thresholds if not 0 < t < 1]
    if bad:
        raise ValueError(f"IoU thresholds must lie in (0, 1): {bad}")
    return F.array(*map(F.lit, thresholds))


def matched(predictions: DataFrame, truths: DataFrame, thresholds: Sequence[float], image: str = "image_id", label: int = 1) -> DataFrame:
    """MET6: every prediction at every threshold with ``tp``: its best truth reaches the threshold and no better-scored prediction has taken that truth."""
    each = match_intervals(predictions, truths, image, label).withColumn("threshold", F.explode(_checked(thresholds)))
    return each.withColumn("tp", ((F.col("threshold") > F.col("low")) & (F.col("threshold") <= F.col("high"))).cast("int")).drop("low", "high")


def average_precision(predictions: DataFrame, truths: DataFrame, thresholds: Sequence[float] = (0.5,), image: str = "image_id", label: int = 1, ranges: int = 4096) -> DataFrame:
    """MET6, MET7: ``threshold, predictions, truths, ap``: area under the precision envelope over recall, from (0, 0) to recall 1.

    Predictions are numbered once, for all thresholds, by score and among equal scores by id;
    a threshold's curve is then made of its true positives alone, since precision only falls
    between them. Their running sums go side by side over ``ranges`` of the numbers.
    """
    grid = _checked(thresholds)
    at = positions(match_intervals(predictions, truths, image, label), [F.desc("score"), F.asc("pred_id")], "seen")
    count = lambda d, name: d.where(F.col("label") == label).agg(F.count("*").alias(name))
    n = count(truths, "truths").crossJoin(count(predictions, "predictions"))  # one row each
    hits = at.select("seen", F.explode(F.filter(grid, lambda t: (t > F.col("low")) & (t <= F.col("high")))).alias("threshold"))
    rows = hits.crossJoin(F.broadcast(n)).withColumn("_range", F.floor((F.col("seen") - 1) * ranges / F.col("predictions")))
    counts = rows.groupBy("threshold", "_range").agg(F.count("*").alias("_tp"))
    before = Window.partitionBy("threshold").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("threshold", "_range", F.coalesce(F.sum("_tp").over(before), F.lit(0)).alias("_tp0"))
    order = Window.partitionBy("threshold", "_range")
    curve = rows.join(base, ["threshold", "_range"]).withColumn("precision", (F.col("_tp0") + F.row_number().over(order.orderBy("seen"))) / (F.col("seen") + 1e-6))
    # The best precision from here on: inside the range, a running maximum in the opposite order; behind it, that of the later ranges.
    back = order.orderBy(F.desc("seen")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("threshold").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    here = curve.withColumn("_here", F.max("precision").over(back))
    best = here.groupBy("threshold", "_range").agg(F.max("precision").alias("_best")).select("threshold", "_range", F.coalesce(F.max("_best").over(later), F.lit(0.0)).alias("_later"))
    found = here.join(best, ["threshold", "_range"]).groupBy("threshold").agg(F.sum(F.greatest("_here", "_later") / (F.col("truths") + 1e-6)).alias("ap"))
    every = n.withColumn("threshold", F.explode(grid))
    return every.join(found, "threshold", "left").select("threshold", "predictions", "truths", F.when(F.col("truths") > 0, F.coalesce("ap", F.lit(0.0))).otherwise(0.0).alias("ap"))


#: The names of the two metrics in a retrieval log, before "@", k and a colon.
RECALL, MEAN_PRECISION = "Recall", "mAP"


def parse_logs(logs: DataFrame, key: str = "log", text: str = "text") -> DataFrame:
    """MET8: ``key, metric, value`` of each log: values with deviations, or plain ones where there are none such; a log without either has no row.

    An entry is a recall and, later on its line, the mean precision at the same k.
    """
    number = lambda c: F.regexp_extract(c, r"^\s+([0-9.]+)", 1)
    spread = lambda c: F.regexp_extract(c, r"^\s+[0-9.]+\s+±\s+([0-9.]+)", 1)
    lines = logs.select(key, F.posexplode(F.split(text, "\n")).alias("_line", "_text"))
    # What follows each "Recall@" of a line.
    parts = F.split("_text", f"{RECALL}@")
    after = F.transform(F.slice(parts, 2, 1_000_000), lambda x, i: F.array_join(F.slice(parts, i + 2, F.size(parts)), f"{RECALL}@"))
    entries = lines.select(key, "_line", F.posexplode(after).alias("_part", "_text"))
    k = F.regexp_extract("_text", r"^(\d+):", 1)
    entries = entries.withColumn("_k", k).where(F.col("_k") != "").withColumn("_recall", F.substring_index(F.expr("substring(_text, length(_k) + 2)"), f"{MEAN_PRECISION}@", 1))
    mark = F.concat(F.lit(f"{MEAN_PRECISION}@"), "_k", F.lit(":"))
    entries = entries.withColumn("_at", F.call_function("locate", mark, F.col("_text"))).where(F.col("_at") > 0).withColumn("_map", F.call_function("substring", F.col("_text"), F.col("_at") + F.length(mark)))
    values = entries.select(key, "_line", "_part", "_k", number("_recall").alias("recall"), spread("_recall").alias("recall_std"), number("_map").alias("map"), spread("_map").alias("map_std")).where((F.col("recall") != "") & (F.col("map") != ""))
    values = values.withColumn("_full", (F.col("recall_std") != "") & (F.col("map_std") != ""))
    with_spread = values.groupBy(key).agg(F.bool_or("_full").alias("_any"))
    kept = values.join(with_spread, key).where(F.col("_full") | ~F.col("_any"))
    metric = lambda name, tail, c: F.struct(F.concat(F.lit(f"{name}_at_"), "_k", F.lit(tail)).alias("metric"), F.col(c).cast("double").alias("value"))
    plain = F.array(metric("recall", "", "recall"), metric("map", "", "map"))
    full = F.array(metric("recall", "", "recall"), metric("recall", "_std", "recall_std"), metric("map", "", "map"), metric("map", "_std", "map_std"))
    rows = kept.select(key, F.struct("_line", "_part").alias("pos"), F.explode(F.when(F.col("_any"), full).otherwise(plain)).alias("x"))
    # A metric that a log names twice has its last value.
    return rows.groupBy(key, "x.metric").agg(F.max_by("x.value", "pos").alias("value"))


def sweep_table(results: DataFrame, metrics: Sequence[str] = ("recall_at_1", "recall_at_5", "recall_at_10", "map_at_1", "map_at_5", "map_at_10")) -> DataFrame:
    """MET9: one row for each k of ``k, silhouette, metric, value``; a missing metric is 0."""
    return results.groupBy("k").agg(F.max("silhouette").alias("silhouette"), *[F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(m) for m in metrics]).orderBy("k")
