"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, components.

Equal vectors form one class first; classes are hashed into several tables of sign
patterns. A bucket is as large as one task compares well by matrix products, so that few
tables do and a vector seldom travels; the number of bits follows the number of classes so
that buckets keep their size, and the number of tables follows from the bits and ``recall``:
a pair at exactly the threshold meets in some table with at least that probability, a closer
pair with a higher one. A pair counts in the first table in which it meets, so that no list
of pairs is needed: a bucket gives only counts of links and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.llm.components import connected_components, join
from cellspark.llm.simhash import whole_groups
from cellspark.llm.storage import release, staged

#: Values of all vectors that a bucket of a table holds on average, and bounds on the vectors.
BUCKET_VALUES, BUCKET = 1 << 19, (256, 8192)
#: Buckets with more than this many times the average are cut into pairs of parts of that size.
CELLS = 2


def bucket_size(dimensions: int) -> int:
    return min(BUCKET[1], max(BUCKET[0], BUCKET_VALUES // max(1, dimensions)))


def plan(classes: int, bucket: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a table's key and number of tables. A key has at most 62 bits."""
    bits = min(62, max(0, math.ceil(math.log2(max(1, classes) / bucket))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet)) if bits else 1


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def sign_keys(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Keys (rows, tables) of unit vectors."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs << np.arange(bits)).sum(2, dtype=np.int64)


def compare(left: dict, right: dict | None, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between two parts of a bucket, or inside one: weight of the links of each row, and the edges of a spanning forest."""
    inside = right is None
    right = left if inside else right
    n, m = len(left["id"]), len(right["id"])
    ids = left["id"] if inside else np.concatenate((left["id"], right["id"]))
    shift = 0 if inside else n
    weight, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    step = max(1, 2_000_000 // max(1, m))
    for i in range(0, n, step):
        part = slice(i, min(n, i + step))
        low = i if inside else 0  # inside a part, each pair once
        linked = left["v"][part] @ right["v"][low:].T >= threshold
        if inside:
            linked = np.triu(linked, 1)
        a, b = np.nonzero(linked)
        a, b = a + i, b + low
        earlier = np.zeros(len(a), bool)
        for t in range(table):
            earlier |= left["k"][a, t] == right["k"][b, t]
        a, b = a[~earlier], b[~earlier]
        if len(a):
            weight += np.bincount(a, right["n"][b], len(ids)).astype(np.int64) + np.bincount(b + shift, left["n"][a], len(ids)).astype(np.int64)
            join(label, a, b + shift)
    return weight, ids, ids[label]


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.99, seed: int = 42) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row of ``vectors``.

    Vectors link at a cosine of ``threshold`` or more, in double precision; only vectors of
    one length are compared. Null, empty and zero vectors and those with a null or
    non-finite component link with nothing: 0 links, their own component. ``n_links``
    counts rows, copies included. ``component_id`` is the smallest id reachable (null ids
    are never it); ``kept`` is ``vec_id = component_id``, true for two nulls. Repeated rows
    come out repeated and link with each other; an empty table gives an empty result; other
    columns are not read. Vectors are known as equal by 128 bits of hash.
    """
    v = F.col("v")
    finite = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    kind, width = ("float", "<f4") if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else ("double", "<f8")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).withColumn("v", F.when(finite, v))
    named_rows = rows.select("id", "v", F.when(v.isNotNull(), F.xxhash64("v")).alias("k1"), F.when(v.isNotNull(), F.xxhash64(F.lit(7), "v")).alias("k2"))
    grouped = named_rows.where("v is not null").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = staged(grouped.select(F.monotonically_increasing_id().alias("class"), "k1", "k2", "v", "least", "n"), "classes")
    total = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
    cell = CELLS * bucket_size(total["size"] or 1)
    bits, tables = plan(total.n, bucket_size(total["size"] or 1), threshold, recall)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            first = np.cumsum(lengths) - lengths
            for size in np.unique(lengths):
                who = np.flatnonzero(lengths == size)
                values = flat[(first[who][:, None] + np.arange(size)).ravel()].reshape(-1, size)
                key = sign_keys(unit(values), bits, tables, seed)
                offsets = pa.array(np.arange(len(who) + 1, dtype=np.int32) * tables)
                data = np.hstack((key.view(np.uint8), np.ascontiguousarray(values.astype(width)).view(np.uint8)))
                yield pa.record_batch(
                    [batch.column("class").take(pa.array(who)), batch.column("n").take(pa.array(who)), pa.ListArray.from_arrays(offsets, pa.array(key.ravel())), pa.array(np.full(len(who), size, np.int32)), _binary(data)], ["class", "n", "keys", "size", "data"]
                )

    hashed = staged(classes.select("class", "n", "v").mapInArrow(keys, "class bigint, n bigint, keys array<bigint>, size int, data binary"), "hashed")
    met = hashed.select("class", "n", "size", "data", F.posexplode("keys").alias("table", "key"))
    bucket = ["size", "table", "key"]
    # Few rows; the join is a broadcast one only as long as Spark finds them small.
    large = hashed.select("size", F.posexplode("keys").alias("table", "key")).groupBy(bucket).count().where(F.col("count") > cell).select(*bucket, F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    dealt = (
        met.join(large, bucket, "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("task", F.xxhash64(*bucket, F.least("part", "other"), F.greatest("part", "other")))
        .select("task", "size", "table", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "class", "n", "data")
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, cell):
            edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in group[:6]], axis=0)) + 1
            for a, b in zip([0, *edge], [*edge, len(group[0])]):
                size, table, _, p, q, part, ids, n, data = (c[a:b] for c in group[1:])
                sides = []
                for own in (part == p[0],) if p[0] == q[0] else (part == p[0], part == q[0]):
                    raw = np.frombuffer(b"".join(data[own]), np.uint8).reshape(int(own.sum()), tables * 8 + int(size[0]) * np.dtype(width).itemsize)
                    k, values = raw[:, : tables * 8], raw[:, tables * 8 :]
                    sides.append({"id": ids[own], "n": n[own], "k": np.ascontiguousarray(k).view("<i8"), "v": unit(np.ascontiguousarray(values).view(width)) if own.any() else np.zeros((0, int(size[0])))})
                weight, every, root = compare(sides[0], None if p[0] == q[0] else sides[1], int(table[0]), threshold)
                some = np.flatnonzero(weight)
                if len(some):
                    yield pa.record_batch([pa.array(every[some]), pa.array(weight[some]), pa.array(root[some])], ["class", "links", "root"])

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = staged(dealt.repartition(parts, "task").sortWithinPartitions("task", "size", "table", "key", "p", "q").mapInArrow(links, "class bigint, links bigint, root bigint"), "links")
    roots = connected_components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("class").agg(F.sum("links").alias("links"))
    slim = classes.select("class", "k1", "k2", "least", "n")
    rooted = slim.join(counted, "class", "left").join(roots, F.col("class") == F.col("node"), "left").select("class", "k1", "k2", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = staged(rooted.join(smallest, "root").select("k1", "k2", (F.col("links") + F.col("n") - 1).alias("links"), "component"), "components")
    release(classes, hashed, found)
    return named_rows.drop("v").join(named, ["k1", "k2"], "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary array."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])
