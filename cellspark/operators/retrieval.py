"""Nearest-neighbour retrieval and its metrics (RET1-RET6). Items are ``item_id, label, embedding``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellspark.functions.vectors import l2_normalised
from cellspark.operators import kernels
from cellspark.operators.clustering import first_starts, lloyd
from cellspark.operators.sampling import subsample
from cellspark.operators.vectors import matrix
from cellspark.sources.scratch import fresh

#: Values of one block of vectors, about; a task holds one of queries and one of items.
BLOCK_VALUES = 8_000_000
#: Items of a block that are worth a task of their own.
LEAST_ITEMS = 2_000


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, items: DataFrame, k: int, normalize: bool = False, exclude_fold: bool = False) -> DataFrame:
    """RET1: ``query_id, rank, item_id, score``: exact inner-product top k, by scores to nine decimals, ties by the smaller id.

    Queries (``query_id, embedding`` and, with ``exclude_fold``, ``fold``) and items are dealt
    to blocks of a bounded number of values by hash; each pair of blocks is worked off in one task,
    some queries and items at a time, which keeps the k best items of every query, and only those are
    ranked. Blocks are as many on either side as make the fewest copies of vectors. With
    ``exclude_fold`` items of the query's fold don't count.
    """
    # Vectors travel as they are and become doubles in their task.
    vec = lambda d: l2_normalised(F.col("embedding")) if normalize else F.col("embedding") if d.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    fold = [F.col("fold").cast("int").alias("fold")] if exclude_fold else [F.lit(None).cast("int").alias("fold")]
    left = queries.select(F.col("query_id").alias("id"), *fold, vec(queries).alias("v"))
    right = items.select(F.col("item_id").alias("id"), *fold, vec(items).alias("v"))
    size = lambda d: d.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    q, i = size(left), size(right)
    blocks = lambda x: max(1, -(-x.n * max(1, x.width or 1) // BLOCK_VALUES))
    # Few items are still dealt to some tasks.
    tasks = max(blocks(q) * blocks(i), min(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-i.n // LEAST_ITEMS)))
    across = max(blocks(q), round((tasks * q.n / max(1, i.n)) ** 0.5))
    down = max(blocks(i), -(-tasks // across))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select("*", block(across).alias("column"), to(down).alias("row")).select("id", "fold", "v", (F.col("column") * down + F.col("row")).alias("task"))
    right = right.select("*", block(down).alias("row"), to(across).alias("column")).select("id", "fold", "v", (F.col("column") * down + F.col("row")).alias("task"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        vectors = [t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1)) for t in (a, b)]
        if not (a.num_rows and b.num_rows):
            vectors = [np.zeros((0, 1))] * 2
        folds = tuple(t.column("fold").to_numpy() for t in (a, b)) if exclude_fold else None
        row, column, score = kernels.best_pairs(*vectors, b.column("id").to_numpy(), k, folds)
        return pa.table({"query_id": a.column("id").take(pa.array(row)), "item_id": b.column("id").take(pa.array(column)), "score": pa.array(score)})

    kinds = f"query_id {left.schema['id'].dataType.simpleString()}, item_id {right.schema['id'].dataType.simpleString()}, score double"
    found = left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(best, kinds)
    return _ranked(found, k).select("query_id", "rank", "item_id", "score")


def coarse_centroids(items: DataFrame, lists: int, seed: int = 42, sample: int = 256, iterations: int = 8) -> DataFrame:
    """``list, centroid``: unit centroids of k-means over at most ``sample`` items for each list, taken by hash; it starts from the first of them."""
    vectors = items.select("item_id", l2_normalised(F.col("embedding")).alias("token"))
    some = subsample(vectors, "item_id", sample * lists, seed).persist()
    try:
        words, _ = lloyd(some, first_starts(some, "item_id", lists, seed=seed + 1), iterations)
        return words.select(F.col("word").alias("list"), l2_normalised(F.col("centroid")).alias("centroid"))
    finally:
        some.unpersist()


def _nearest_lists(rows: DataFrame, key: str, centroids: DataFrame, n: int, name: str = "list") -> DataFrame:
    """``key``, ``v`` and ``name``, an array of the ``n`` lists whose centroids have the largest inner products with the vector, best first."""
    names, matrix_ = matrix(centroids, "list")
    shared = rows.sparkSession.sparkContext.broadcast((names.astype(np.int32), matrix_))
    n = min(n, len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, c = shared.value
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                best = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :n]
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n)
                yield pa.record_batch([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(offsets, pa.array(lists[best].ravel()))], ["id", "v", name])

    source = rows.select(F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, v array<double>, {name} array<int>").withColumnRenamed("id", key)


def write_ivf(items: DataFrame, path: str, lists: int, copies: int = 1, seed: int = 42, most: int = 100_000, centroids: DataFrame | None = None) -> None:
    """RET2: the inverted file under ``path``: ``centroids`` (``list, centroid, parts``) and ``items``, a folder for each list.

    An item is in its ``copies`` nearest lists by inner product: more than one where neighbours
    are often in different lists. A list of more than ``most`` items is cut into ``parts`` by hash,
    a task's work each. Centroids are those of ``coarse_centroids`` or given (``list, centroid``).
    """
    spark = items.sparkSession
    centroids = coarse_centroids(items, lists, seed) if centroids is None else centroids
    centroids.write.mode("overwrite").parquet(f"{path}/trained")
    centroids = spark.read.parquet(f"{path}/trained")
    dealt = _nearest_lists(items, "item_id", centroids, copies).select("item_id", F.col("v").cast(items.schema["embedding"].dataType).alias("embedding"), F.explode("list").alias("list"))
    dealt.write.mode("overwrite").parquet(f"{path}/dealt")
    dealt = spark.read.parquet(f"{path}/dealt")
    sizes = dealt.groupBy("list").agg(F.count("*").alias("n"))
    parts = centroids.join(sizes, "list", "left").select("list", "centroid", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / most)).cast("int").alias("parts"))
    parts.write.mode("overwrite").parquet(f"{path}/centroids")
    # As many rows as lists, sent to all tasks where Spark finds them small.
    cut = dealt.join(spark.read.parquet(f"{path}/centroids").select("list", "parts"), "list").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")).drop("parts")
    cut.repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/items")


def probed_items(spark: SparkSession, path: str, lists: Sequence[int]) -> DataFrame:
    """RET2: the stored items of some lists; the folders of the others are not listed or read."""
    return spark.read.parquet(f"{path}/items").where(F.col("list").isin([int(x) for x in lists]))


def search_ivf(queries: DataFrame, path: str, k: int, probes: int) -> DataFrame:
    """RET2: ``query_id, rank, item_id, score``: each query's best items by inner product among those of its best ``probes`` lists.

    Queries travel to the lists they probe, and only those lists are read; a part of a list and a
    block of its queries meet in one task as one matrix product, which keeps the ``k`` best of
    each query. The probed lists' numbers come to the driver, as many as there are centroids at most.
    """
    spark = queries.sparkSession
    centroids = spark.read.parquet(f"{path}/centroids")
    probed = _nearest_lists(queries, "query_id", centroids.select("list", "centroid"), probes, "lists").select("query_id", "v", F.explode("lists").alias("list"))
    loads = probed.groupBy("list").agg(F.count("*").alias("asked"), F.max(F.size("v")).alias("width")).join(centroids.select("list", "parts"), "list").collect()
    # Queries of a list in blocks, so that a task holds one block and one part.
    blocks = spark.createDataFrame([(r.list, r.parts, max(1, -(-r.asked * (r.width or 1) // BLOCK_VALUES))) for r in loads], "list int, parts int, blocks int")
    items = probed_items(spark, path, [r.list for r in loads])
    task = F.struct("list", "part", "block")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = probed.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", every("parts")).select(task.alias("task"), "query_id", "v")
    right = items.join(F.broadcast(blocks), "list").withColumn("block", every("blocks")).select(task.alias("task"), "item_id", F.col("embedding").cast("array<double>").alias("v"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        vectors = [t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1)) for t in (a, b)]
        if not (a.num_rows and b.num_rows):
            vectors = [np.zeros((0, 1))] * 2
        row, column, score = kernels.best_pairs(*vectors, b.column("item_id").to_numpy(), k)
        return pa.table({"query_id": a.column("query_id").take(pa.array(row)), "item_id": b.column("item_id").take(pa.array(column)), "score": pa.array(score)})

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double"
    found = left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(best, kinds)
    # An item may be met in several lists.
    return _ranked(found.groupBy("query_id", "item_id").agg(F.max("score").alias("score")), k).select("query_id", "rank", "item_id", "score")


def ivf_top_k(queries: DataFrame, items: DataFrame, k: int, lists: int, probes: int, seed: int = 42, copies: int = 1, path: str | None = None) -> DataFrame:
    """RET2: ``write_ivf`` and ``search_ivf`` in one, the index in the shared folder unless ``path`` says where."""
    path = path or fresh(items.sparkSession, "ivf")
    write_ivf(items, path, lists, copies, seed)
    return search_ivf(queries, path, k, probes)


def retrieval_metrics(found: DataFrame, queries: DataFrame, items: DataFrame, ks: Sequence[int] = (1, 5, 10), by: Sequence[str] = ()) -> DataFrame:
    """RET3: ``by…, k, queries, recall, map`` : recall is a hit in the first k; average precision divides by the hits within k."""
    q = queries.select("query_id", F.col("label").alias("_want"), *by)
    hits = found.join(items.select("item_id", F.col("label").alias("_got")), "item_id").join(q, "query_id").withColumn("hit", (F.col("_want") == F.col("_got")).cast("int"))
    running = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank"))
    precise = hits.withColumn("p", F.when(F.col("hit") == 1, running / F.col("rank")))
    per_query = precise.groupBy("query_id").agg(*[x for k in ks for x in (F.count_if((F.col("rank") <= k) & (F.col("hit") == 1)).alias(f"n{k}"), F.sum(F.when(F.col("rank") <= k, F.col("p"))).alias(f"s{k}"))])
    every = q.join(per_query, "query_id", "left")
    value = lambda k: F.struct(F.lit(k).alias("k"), F.coalesce((F.col(f"n{k}") > 0).cast("double"), F.lit(0.0)).alias("recall"), F.coalesce(F.when(F.col(f"n{k}") > 0, F.col(f"s{k}") / F.col(f"n{k}")), F.lit(0.0)).alias("ap"))
    flat = every.select(*by, F.explode(F.array(*map(value, ks))).alias("x"))
    return flat.groupBy(*by, "x.k").agg(F.count("*").alias("queries"), F.avg("x.recall").alias("recall"), F.avg("x.ap").alias("map"))


def kfold_retrieval(items: DataFrame, ks: Sequence[int] = (1, 5, 10), normalize: bool = False) -> DataFrame:
    """RET4: ``k, recall_mean, recall_std, map_mean, map_std`` over the folds of ``items`` (column ``fold``): every fold queries the others, in one pass."""
    queries = items.select(F.col("item_id").alias("query_id"), "label", "embedding", "fold")
    found = top_k(queries, items, max(ks), normalize, exclude_fold=True)
    each = retrieval_metrics(found, queries, items, ks, by=("fold",))
    return each.groupBy("k").agg(F.avg("recall").alias("recall_mean"), F.stddev_pop("recall").alias("recall_std"), F.avg("map").alias("map_mean"), F.stddev_pop("map").alias("map_std"))


def split_retrieval(queries: DataFrame, items: DataFrame, labels: Sequence[str], ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """RET5: metrics of one search under several label columns: ``label_set, k, queries, recall, map``."""
    found = top_k(queries, items, max(ks))
    out = None
    for name in labels:
        part = retrieval_metrics(found, queries.withColumn("label", F.col(name)), items.withColumn("label", F.col(name)), ks).withColumn("label_set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
