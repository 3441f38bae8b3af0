"""Deterministic sampling (SMP1-SMP8): order is that of md5(seed:key), whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspark.sources.scratch import fresh


def hash_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _first_per(rows: DataFrame, group: list[str], order: Column, n: int | Column, most: int | None = None, name: str = "_rank", salts: int = 16) -> DataFrame:
    """Rows with rank (from 1) up to ``n`` in their group. With ``most``, a bound of ``n``, groups are cut down in ``salts`` parts before they meet, so that one large group isn't one task's work."""
    if most is not None:
        salt = F.pmod(F.xxhash64(order), F.lit(salts))
        inner = Window.partitionBy(*group, salt).orderBy(order)
        rows = rows.withColumn("_local", F.row_number().over(inner)).where(F.col("_local") <= most).drop("_local")
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col(name) <= n)


def numbered(rows: DataFrame, group: str, order: Column, name: str) -> DataFrame:
    """Adds a number, from 1, in the hash order of the row's group. Ranges of the hash are counted first and numbered side by side, so that no task sorts a whole group; groups may be null."""
    keyed = rows.withColumn("_h", order).withColumn("_range", F.substring("_h", 1, 3))
    counts = keyed.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_group", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = keyed.withColumn("_in", F.row_number().over(Window.partitionBy(group, "_range").orderBy("_h")))
    joined = inside.join(base, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn(name, F.col("_base") + F.col("_in")).drop("_h", "_range", "_group", "_of", "_base", "_in")


#: Hex digits of the hash ranges that are counted, first over all rows, then inside the range of each cut.
RANGES = (3, 6)


def hash_cuts(rows: DataFrame, group: list[str], order: Column, key: str, quotas: DataFrame) -> DataFrame:
    """``group…, _cut``: struct ``h, k`` of the row that is number ``_quota`` in its group's order of hash and key.

    ``quotas`` has ``group…`` (one row where ``group`` is empty) and ``_quota``; a group of no more
    rows than that has no cut, nor has a quota below 1. Rows are counted by ranges of their
    hash, then by finer ranges inside the one that a cut falls into, and only what is left is
    sorted: of 10 billion rows some 600. What travels is hashes and keys, never whole rows.
    Groups may be null.
    """
    one = group or ["_all"]
    slim = rows.select(*[F.col(g) for g in group], *([] if group else [F.lit(0).alias("_all")]), order.alias("h"), F.col(key).alias("k"))
    # Groups under names of their own, so that nulls meet and no name clashes.
    names = [f"_g{i}" for i in range(len(one))]
    slim = slim.select(*[F.col(g).alias(n) for g, n in zip(one, names)], F.struct("h", "k").alias("_at"))
    left = quotas.select(*[(F.col(g) if group else F.lit(0)).alias(n) for g, n in zip(one, names)], F.col("_quota").cast("bigint").alias("_left"), F.lit("").alias("_range"))

    def inside(points: DataFrame, at: DataFrame, digits: int) -> DataFrame:
        other = at.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("_left"), F.col("_range").alias("_of"))
        same = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
        return points.join(other, same & (F.substring("_at.h", 1, digits) == F.col("_of"))).drop(*[f"{n}_" for n in names], "_of")

    digits = 0
    for width in RANGES:
        counts = inside(slim, left, digits).groupBy(*names, F.substring("_at.h", 1, width).alias("_range")).agg(F.count("*").alias("_n"), F.first("_left").alias("_left"))
        upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_range"))
        cut = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")) & (F.col("_left") > 0))
        left, digits = cut.select(*names, (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), "_range"), width
    ranked = inside(slim, left, digits).withColumn("_no", F.row_number().over(Window.partitionBy(*names).orderBy("_at")))
    return ranked.where(F.col("_no") == F.col("_left")).select(*[F.col(n).alias(g) for n, g in zip(names, one) if group], F.col("_at").alias("_cut"))


def first_by_hash(rows: DataFrame, order: Column, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of hash and key (all if there are fewer), as a filter: no task sorts or holds them. ``key`` names a row; rows of one key stay together."""
    if n < 1:
        return rows.where(F.lit(False))
    return rows.where(_upto(rows, order, key, n))


def _place(order: Column, key: str) -> Column:
    return F.struct(order.alias("h"), F.col(key).alias("k"))


def _upto(rows: DataFrame, order: Column, key: str, n: int) -> Column:
    """Whether a row is among the first ``n`` in the order of hash and key; one cut comes to the driver."""
    quota = rows.sparkSession.range(1).select(F.lit(n).alias("_quota"))
    cut = hash_cuts(rows, [], order, key, quota).first()
    return F.lit(True) if cut is None else _place(order, key) <= F.struct(F.lit(cut["_cut"]["h"]).alias("h"), F.lit(cut["_cut"]["k"]).alias("k"))


def positions(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the position, from 1, of each row in ``order`` over all rows.

    Rows are sorted over all tasks by ranges, so that no task holds more than its share, however
    many rows are equal in the first columns, and staged in the shared folder with their place in
    their task; a task's first position is the sum of the counts before it, one row for each task.
    """
    spark, path = rows.sparkSession, fresh(rows.sparkSession, "ordered")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The number that Spark gives: the task's in the upper bits, the row's in the lower 33.
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("_task", F.shiftright("_at", 33))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = kept.groupBy("_task").agg(F.count("*").alias("_n")).select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return kept.join(base, "_task").withColumn(name, F.col("_base") + F.col("_at") - F.shiftleft("_task", 33) + 1).drop("_task", "_at", "_base")


def cap_per_class(rows: DataFrame, label: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """SMP3: at most ``cap`` rows of each class."""
    return _first_per(rows, [label], hash_order(seed, key), cap, cap).drop("_rank")


def sample_stratified(rows: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """SMP1: n rows spread evenly over the classes; what small classes lack comes from the rest."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    total, classes = sizes.agg(F.sum("_size"), F.count("*")).first()
    if not classes or n >= total:
        return rows
    quota = max(1, n // classes)
    extra = max(0, n - quota * classes)
    number = F.row_number().over(Window.orderBy(label))
    quotas = sizes.withColumn("_quota", F.least(F.col("_size"), F.lit(quota) + F.when(number <= extra, 1).otherwise(0)))
    order = hash_order(seed, key)
    # Each class's first rows lie up to a cut of its own.
    cuts = hash_cuts(rows, [label], order, key, quotas).select(F.col(label).alias("_class"), "_cut")
    marked = rows.join(cuts, F.col(label).eqNullSafe(F.col("_class")), "left")
    first = F.coalesce(_place(order, key) <= F.col("_cut"), F.lit(True))
    taken = quotas.agg(F.sum("_quota")).first()[0]
    early = marked.where(first).drop("_class", "_cut")
    if taken >= n:  # more classes than rows asked for
        return first_by_hash(early, order, key, n)
    # The others up to a cut of theirs.
    late = marked.where(~first).drop("_class", "_cut")
    return marked.where(first | _upto(late, order, key, n - taken)).drop("_class", "_cut")


def sample_fraction(rows: DataFrame, label: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """SMP2: ``max(1, int(count * fraction))`` rows of each class."""
    sizes = rows.groupBy(label).agg(F.greatest(F.lit(1), F.floor(F.count("*") * fraction)).alias("_quota")).withColumnRenamed(label, "_class")
    ranked = numbered(rows, label, hash_order(seed, key), "_rank")
    return ranked.join(sizes, F.col(label) == F.col("_class")).where(F.col("_rank") <= F.col("_quota")).drop("_class", "_quota", "_rank")


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int, seed: int = 42) -> DataFrame:
    """SMP4: adds ``fold``, shuffled in class, then dealt round."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    return numbered(rows, label, hash_order(seed, key), "_no").withColumn("fold", ((F.col("_no") - 1) % folds).cast("int")).drop("_no")


def subsample(rows: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """SMP5: exactly ``most`` rows without replacement (all if fewer); ``key`` names a row."""
    return first_by_hash(rows, hash_order(seed, key), key, most)


def subsample_tokens(tokens: DataFrame, target: int, seed: int = 42, cell: str = "cell_id", pos: str = "pos") -> DataFrame:
    """SMP6: ``max(1, target // cells)`` tokens of each cell, cells in hash order, cut at the target."""
    cells = tokens.select(cell).distinct()
    n = cells.count()
    if not n:
        return tokens
    quota = max(1, target // n)
    if quota * n > target:  # one token of each of the first cells
        tokens = tokens.where(_upto(cells, hash_order(seed, cell), cell, target) if target > 0 else F.lit(False))
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(hash_order(seed, cell, pos), pos))
    return tokens.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank")


def fit_sample(tokens: DataFrame, image: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """SMP7: up to ``most`` vectors of each image."""
    return _first_per(tokens, [image], hash_order(seed, key), most, most).drop("_rank")


def group_order(cells: DataFrame, image: str, cell: str, ranks: int, per_group: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """SMP8: ``rank, position, cell_id``: images shuffled per epoch and dealt round, at most ``per_group`` cells of each."""
    s = seed + epoch
    images = cells.select(image).distinct()
    # Image numbers over hash ranges: buckets of the hash are counted first, so that no task sorts all images.
    h = images.withColumn("_h", hash_order(s, image)).withColumn("_bucket", F.substring("_h", 1, 3))
    base = h.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_bucket", "_base")
    numbered = h.join(F.broadcast(base), "_bucket").withColumn("_image_no", F.col("_base") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", image)) - 1)
    inside = cells.withColumn("_in", F.row_number().over(Window.partitionBy(image).orderBy(hash_order(s, image, cell), cell))).where(F.col("_in") <= per_group)
    dealt = inside.join(numbered.select(image, "_image_no"), image).select((F.col("_image_no") % ranks).alias("rank"), "_image_no", "_in", F.col(cell).alias("cell_id"))
    # Positions over all ranks, less those of the ranks before.
    placed = positions(dealt, [F.col("rank"), F.col("_image_no"), F.col("_in")], "_place")
    first = placed.groupBy("rank").agg(F.min("_place").alias("_first"))
    return placed.join(first, "rank").select("rank", (F.col("_place") - F.col("_first")).alias("position"), "cell_id")
