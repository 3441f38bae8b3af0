"""Existence, resume, assembly and fallback joins (JON1-JON8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspark.functions.paths import is_validation, label_by_list


def existing(manifest: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """JON1: manifest rows whose file is listed."""
    return manifest.join(listing.select(path), path, "left_semi")


def coverage(manifest: DataFrame, listing: DataFrame, category: str = "category", path: str = "path") -> DataFrame:
    """JON1: ``category, found, missing, percent``, and the total under a null category."""
    found = listing.select(path).distinct().withColumn("_there", F.lit(1))
    joined = manifest.join(found, path, "left").withColumn(category, F.coalesce(category, F.lit("unknown")))
    out = joined.rollup(category).agg(F.count("_there").alias("found"), (F.count("*") - F.count("_there")).alias("missing"))
    return out.withColumn("percent", F.col("found") * 100.0 / (F.col("found") + F.col("missing")))


def remaining(entries: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """JON2: entries whose key has no output yet."""
    return entries.join(done.select(*key), list(key), "left_anti")


def append_resumed(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """JON3: old outputs and the new ones for keys not among them."""
    return old.unionByName(remaining(new, old, key))


def training_table(manifest: DataFrame, histograms: DataFrame, labels: DataFrame, hash_col: str, ratio: float, key: str = "cell_id") -> DataFrame:
    """JON4: manifest rows with a histogram, their label (-1 if none) and whether they are validation rows."""
    joined = manifest.join(histograms, key).join(labels.select(key, F.col("label").alias("_label")), key, "left")
    return joined.withColumn("label", F.coalesce("_label", F.lit(-1))).drop("_label").withColumn("is_val", is_validation(F.col(hash_col), ratio))


def label_fallback(cells: DataFrame, stored: DataFrame, category: str = "category", key: str = "cell_id") -> DataFrame:
    """JON5: the stored label, else the manifest's ``dominant_label``, else that of the path's category, else -1; -1 counts as none."""
    none = lambda c: F.when(F.col(c) >= 0, F.col(c))
    joined = label_by_list(cells.join(stored.select(key, F.col("label").alias("_stored")), key, "left"), category)
    return joined.withColumn("label", F.coalesce(none("_stored"), none("dominant_label"), F.col("label"))).drop("_stored")


def resolve_keys(records: DataFrame, entries: DataFrame, key: str = "record_id") -> DataFrame:
    """JON6: for each record (``candidates`` array, ``canonical`` path) the entry of the first candidate key found, else the first entry of its canonical path. ``entries`` has ``key, canonical, entry_id``."""
    tried = records.select(key, F.posexplode("candidates").alias("_prio", "key"))
    by_key = tried.join(entries.select("key", "entry_id"), "key").groupBy(key).agg(F.min(F.struct("_prio", "entry_id")).alias("hit"))
    by_path = entries.groupBy("canonical").agg(F.min("entry_id").alias("_fallback"))
    return records.join(by_key, key, "left").join(by_path, "canonical", "left").select(key, F.coalesce("hit.entry_id", "_fallback").alias("entry_id"), F.when(F.col("hit").isNotNull(), "key").when(F.col("_fallback").isNotNull(), "path").alias("how"))


def lookup_fallback(cells: DataFrame, per_cell: DataFrame, per_image: DataFrame, value: str) -> DataFrame:
    """JON7: the value of (image, row, col), else of the image, else of (image, 0, 0)."""
    exact = per_cell.select("image", "cell_row", "cell_col", F.col(value).alias("_v1"))
    whole = per_image.select("image", F.col(value).alias("_v2"))
    corner = per_cell.where("cell_row = 0 AND cell_col = 0").select("image", F.col(value).alias("_v3"))
    joined = cells.join(exact, ["image", "cell_row", "cell_col"], "left").join(whole, "image", "left").join(corner, "image", "left")
    return joined.withColumn(value, F.coalesce("_v1", "_v2", "_v3")).drop("_v1", "_v2", "_v3")


def fold_splits(rows: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """JON8: every row once for each fold, as its test or a training row."""
    each = rows.withColumn("eval_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return each.withColumn("part", F.when(F.col(fold) == F.col("eval_fold"), "test").otherwise("train"))


def first_per(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")
