"""Stores for vectors, histograms and sweep results (SNK1-SNK3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_vectors(rows: DataFrame, path: str, key: str = "key", buckets: int = 256, mode: str = "append") -> None:
    """SNK1: Parquet by hash bucket of the key, so that a lookup reads one folder."""
    bucketed(rows, key, buckets).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def bucketed(rows: DataFrame, key: str = "key", buckets: int = 256) -> DataFrame:
    """SNK1: adds the bucket: the first byte of the key's md5, modulo ``buckets``."""
    return rows.withColumn("bucket", (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 2), 16, 10).cast("int") % buckets))


def write_joinable(rows: DataFrame, table: str, path: str, key: str = "cell_id", buckets: int = 256) -> DataFrame:
    """SNK1, SNK2: ``rows`` as the table ``table`` with its files under ``path``, in ``buckets`` by hash of the key and sorted in each: joins of such tables on the key, JON4's among them, move none of their rows.

    Rows are dealt to their buckets first, so that a bucket is one file.
    """
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def write_histograms(histograms: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK2: Parquet in ``cell_id`` order over all files."""
    histograms.repartitionByRange("cell_id").sortWithinPartitions("cell_id").write.mode(mode).parquet(path)


def upsert_results(old: DataFrame, new: DataFrame, key: str = "k") -> DataFrame:
    """SNK3: old rows and new ones; a new row replaces the old one of its key."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_age"))).where("_n = 1").drop("_n", "_age")


def summary_columns(results: DataFrame, key: str = "k", metrics: str = "metrics") -> DataFrame:
    """SNK3: one column for each metric name found in any row's map, in name order, rows by key."""
    each = results.select(key, *[c for c in results.columns if c not in (key, metrics)], F.explode_outer(metrics).alias("metric", "value"))
    names = [r.metric for r in each.where("metric is not null").select("metric").distinct().orderBy("metric").collect()]  # metric names
    others = [c for c in results.columns if c not in (key, metrics)]
    return each.groupBy(key, *others).agg(F.count("value").alias("_n"), *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names]).drop("_n").orderBy(key)


def write_summary_csv(results: DataFrame, path: str) -> None:
    """SNK3: the table as one CSV file with a header (a few rows)."""
    summary_columns(results).coalesce(1).write.mode("overwrite").csv(path, header=True)
