"""Mixing sources to target weights by capped water-filling.

Every source's weighted share of the total is clamped at ``max_epochs`` times its size;
what that leaves goes to the other sources by weight until none is above. A source's
target is taken as whole repetitions of all its documents and a fractional one: documents
in seeded hash order as long as they fit into the rest of the target, and of the others
the one that fills the gap best, if that comes closer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspark.llm.storage import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row for each source.

    Weights go to the sources by code point, null last, and repeat. Sorted by capacity over
    weight, the capped sources come first: source i is capped if the level at which the
    water stands once the sources before it are full would reach its own capacity.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int")).cast("bigint"))
    capped = weighted.withColumn("cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        capped.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("rest") * F.col("weight") >= F.col("cap") * F.col("left"))
    )
    # The first source that isn't full fixes the level for itself and all after it.
    is_open = ~F.col("full")
    rest, left = F.max(F.when(is_open, F.col("rest"))).over(whole), F.max(F.when(is_open, F.col("left"))).over(whole)
    return level.withColumn("level_rest", rest).withColumn("level_left", left).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level_rest") * F.col("weight") / F.col("level_left")).alias("target"),
    )


def mixed(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = 3, seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies`` and the columns of ``carry``, with that prefix, for each row of ``docs``.

    ``copies`` is how often the mix repeats the row: whole repetitions of its source, one
    more for the rows of the fractional repetition. Null sources form one source; a source
    without words has target 0 and is taken 0 times; rows with equal ids and sizes are
    interchangeable. Reruns agree: the order is that of md5(seed:id).
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key")
    each = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.col(source_col).alias("source"), key, *[F.col(c).alias(f"carry_{c}") for c in carry])
    small = staged(each.select("doc_id", "size", "source", "key", F.substring("key", 1, 3).alias("bucket")), "sizes")
    # One row for each source and at most 4,096 hash buckets; prefix sums over buckets, then inside the one at the border.
    buckets = small.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = staged(targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs), "targets")
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("int")).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .join(F.broadcast(sources.select("source", "rest")) if _few(sources) else sources.select("source", "rest"), buckets.source.eqNullSafe(sources.source))
        .drop(sources.source)
        .where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("bucket_size") >= F.col("rest")))
        .select(F.col("source").alias("border_source"), F.col("bucket").alias("border"), "start")
    )
    plan = sources.join(at, sources.source.eqNullSafe(at.border_source), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", "rest", F.coalesce("border", F.lit("")).alias("border"), F.coalesce("start", F.lit(0)).alias("start"))
    plan = staged(plan, "plan")
    inside = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = small.join(plan, small.source.eqNullSafe(plan.of) & (small.bucket == plan.border)).withColumn("end", F.col("start") + F.sum("size").over(inside))
    last = border.groupBy("source").agg(F.max(F.when(F.col("end") <= F.col("rest"), F.struct("key", "doc_id", "size", "end"))).alias("last"))
    plan = plan.join(last, plan.of.eqNullSafe(last.source), "left").select(
        "of", "source_size", "target", "whole", "border", "rest", F.struct("last.key", "last.doc_id", "last.size").alias("last"), F.col("last").isNotNull().alias("some"), (F.col("rest") - F.coalesce("last.end", "start")).alias("gap")
    )
    plan = staged(plan, "plan")
    mine = F.struct("key", "doc_id", "size")
    fits = (F.col("rest") > 0) & ((F.col("bucket") < F.col("border")) | ((F.col("bucket") == F.col("border")) & F.col("some") & (mine <= F.col("last"))))
    miss = F.abs(F.col("size") - F.col("gap"))
    others = small.join(F.broadcast(plan) if _few(plan) else plan, small.source.eqNullSafe(plan.of)).where(~fits & (F.col("rest") > 0) & (F.col("size") > 0) & (miss < F.col("gap")))
    filler = others.groupBy("of").agg(F.min(F.struct(miss.alias("miss"), "key", "doc_id", "size")).alias("f")).select(F.col("of").alias("filled"), F.struct("f.key", "f.doc_id", "f.size").alias("filler"))
    plan = staged(plan.join(filler, plan.of.eqNullSafe(F.col("filled")), "left").drop("filled"), "plan")
    extra = fits | F.coalesce(mine == F.col("filler"), F.lit(False))
    return (
        each.withColumn("bucket", F.substring("key", 1, 3))
        .join(F.broadcast(plan) if _few(plan) else plan, each.source.eqNullSafe(plan.of))
        .select("doc_id", "size", "source", "source_size", "target", (F.col("whole") + F.when(extra, 1).otherwise(0)).alias("copies"), *[f"carry_{c}" for c in carry])
    )


def _few(table: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table of one short row for each source is small enough to send to all tasks."""
    return table.limit(rows + 1).count() <= rows


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = WEIGHTS, max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as the mix takes it.

    A null text has size 0; a row of size 0 is in the mix as often as its source's whole
    repetitions, or once more by its place in the hash order. Null sources form one source.
    Equal rows are mixed like any others; an empty table stays empty; other columns may have
    any name.
    """
    plan = mixed(docs, word_count(F.col(text_col)), id_col, source_col, weights, max_epochs, seed, carry=docs.columns)
    row = F.struct(*[F.col(f"carry_{c}").alias(c) for c in docs.columns]).alias("row")
    return plan.where("copies > 0").select(row, F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def op5_rows(docs: DataFrame) -> DataFrame:
    plan = mixed(docs, word_count(F.col("text")))
    return plan.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same mix in SQL: one window over each source in place of the two-step prefix sums.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *,
        sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS lft
      FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, rest * weight >= cap * lft AS is_full FROM f),
t AS (SELECT source, source_size,
        CASE WHEN is_full THEN cap::DOUBLE
             ELSE (max(CASE WHEN NOT is_full THEN rest END) OVER ())::DOUBLE * weight / (max(CASE WHEN NOT is_full THEN lft END) OVER ())::DOUBLE END AS target FROM g),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM t),
e AS (SELECT d.*, r.source_size, r.target, r.whole, greatest(r.target - r.whole * r.source_size, 0) AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS at_end
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
h AS (SELECT *, rest - coalesce(max(CASE WHEN at_end <= rest THEN at_end END) OVER (PARTITION BY source), 0) AS gap FROM e),
i AS (SELECT *, CASE WHEN rest > 0 AND at_end > rest AND size > 0 AND abs(size - gap) < gap THEN 1 ELSE 0 END AS could FROM h),
j AS (SELECT *, row_number() OVER (PARTITION BY source, could ORDER BY abs(size - gap), k, doc_id, size) AS place FROM i)
SELECT doc_id, size, source, source_size, target,
       (size * (whole + CASE WHEN (rest > 0 AND at_end <= rest) OR (could = 1 AND place = 1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
"""
