"""Path scalars, manifests, class ids and hash splits (PRJ1-PRJ12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspark.schemas import PREFIXES, category_table


def strip_prefix(path: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    """The path without the first known prefix that it starts with."""
    out = path
    for p in reversed(prefixes):
        out = F.when(path.startswith(p), F.substring(path, len(p) + 1, 1_000_000)).otherwise(out)
    return out


def canonical_rel_path(path: Column, marker: str = "data/fmow/", prefixes: Sequence[str] = PREFIXES) -> Column:
    """Forward slashes, no known prefix, nothing up to the data folder, no run of dots and slashes in front."""
    slashed = strip_prefix(F.translate(path, "\\", "/"), prefixes)
    at = F.locate(f"/{marker}", slashed)
    inner = F.when(at > 0, F.substring(slashed, at + len(marker) + 1, F.length(slashed))).otherwise(slashed)
    return F.regexp_replace(F.regexp_replace(inner, f"^{marker}", ""), "^[./]+", "")


def category_of(path: Column) -> Column:
    """The folder after the first ``train/`` or ``val/``; null if there is none."""
    found = F.regexp_extract(path, "(?:train|val)/([^/]+)/", 1)
    return F.when(found != "", found)


def part(path: Column, i: int) -> Column:
    return F.get(F.split(path, "/"), i)


def image_suffix(msrgb: bool) -> str:
    return "_msrgb.jpg" if msrgb else "_rgb.jpg"


def filter_files(files: DataFrame, splits: Sequence[str], msrgb: bool = True, path: str = "path") -> DataFrame:
    """Images of the splits and their annotation files, distinct: ``path``."""
    p = F.col(path)
    suffix = image_suffix(msrgb)
    images = files.where((F.size(F.split(p, "/")) >= 2) & part(p, 0).isin(*splits) & p.endswith(suffix))
    return images.select(F.explode(F.array(p, F.regexp_replace(p, r"\.jpg$", ".json"))).alias("path")).distinct()


def build_manifest(files: DataFrame, split: str, msrgb: bool = True, path: str = "path") -> DataFrame:
    """``img_path, json_path`` of the images of one split with at least three path parts."""
    p = F.col(path)
    return files.where(p.endswith(image_suffix(msrgb)) & (F.size(F.split(p, "/")) >= 3) & (part(p, 0) == split)).select(p.alias("img_path"), F.regexp_replace(p, r"\.jpg$", ".json").alias("json_path"))


def label_by_list(rows: DataFrame, category: str = "category") -> DataFrame:
    """Adds ``label`` from the fixed list; unknown and null give -1."""
    names = category_table(rows.sparkSession).withColumnRenamed("category", "_name")
    return rows.join(F.broadcast(names), F.col(category) == F.col("_name"), "left").drop("_name").withColumn("label", F.coalesce("label", F.lit(-1)))


def label_by_appearance(rows: DataFrame, category: str = "category", pos: str = "pos") -> DataFrame:
    """``category, label``: classes numbered by first position."""
    first = rows.where(F.col(category).isNotNull()).groupBy(category).agg(F.min(pos).alias("_first"))
    return first.select(category, (F.row_number().over(Window.orderBy("_first")) - 1).alias("label"))


def label_by_name(rows: DataFrame, category: str = "category") -> DataFrame:
    """``category, label``: classes numbered in name order."""
    names = rows.where(F.col(category).isNotNull()).select(category).distinct()
    return names.withColumn("label", F.row_number().over(Window.orderBy(category)) - 1)


def label_report(rows: DataFrame, category: str = "category") -> DataFrame:
    """Rows per class, and for all: labelled, unlabelled (no category) and unknown ones."""
    labelled = label_by_list(rows, category)
    kind = F.when(F.col(category).isNull(), "unlabelled").when(F.col("label") < 0, "unknown").otherwise("labelled")
    each = labelled.groupBy(kind.alias("kind"), F.col("label")).agg(F.count("*").alias("n"))
    return each


def json_string(c: Column) -> Column:
    """A string in JSON's plain ASCII form: other characters as ``\\u`` and four hex digits of each of their UTF-16 units; null for null."""
    unit = lambda u: F.conv(u, 16, 10).cast("bigint")
    short = F.create_map(*[F.lit(x) for pair in (("0022", '\\"'), ("005c", "\\\\"), ("000a", "\\n"), ("000d", "\\r"), ("0009", "\\t"), ("0008", "\\b"), ("000c", "\\f")) for x in pair])
    plain = lambda u: F.when((u >= "0020") & (u <= "007e"), F.chr(unit(u))).otherwise(F.concat(F.lit("\\u"), u))
    units = F.regexp_extract_all(F.lower(F.hex(F.encode(c, "UTF-16BE"))), F.lit("([0-9a-f]{4})"), F.lit(1))
    return F.concat(F.lit('"'), F.array_join(F.transform(units, lambda u: F.coalesce(short[u], plain(u))), ""), F.lit('"'))


def json_number(c: Column) -> Column:
    """A number in JSON's form: integers as they are, doubles from 0.0001 to below 1e16 by their shortest digits with a point, zero as ``0.0``; other sizes fail. Null for null. Java before 19 writes a few doubles with a digit more than needed, and so does this."""
    text = c.cast("string")
    digits = F.regexp_replace(c.cast("double").cast("string").cast("decimal(38, 20)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(c.cast("double"))
    double = F.when((size == 0) | ((size >= 1e-4) & (size < 1e16)), digits)
    return F.when(c.isNull(), F.lit(None)).when(F.typeof(c).isin("float", "double"), F.coalesce(double, F.raise_error(F.concat(F.lit("not a JSON number here: "), text)).cast("string"))).otherwise(text)


def cache_key(image: Column, weights: Column, mtime: Column, size: Column, cell: int = 512, kind: str = "patch_tokens_bovw", shape: Sequence[int] = (256, 1024)) -> Column:
    """SHA-1 of the payload as JSON with sorted keys, ``", "`` and ``": "`` between, in plain ASCII: byte-equal for integers, doubles of ``json_number``, any strings and nulls."""
    value = lambda c: F.coalesce(json_number(c), F.lit("null"))
    quoted = json_string
    body = F.concat(
        F.lit(f'{{"cell_size": {cell}, "image": '), quoted(image), F.lit(f', "output_shape": [{", ".join(map(str, shape))}], "output_type": "{kind}", "weights_mtime": '),
        value(mtime), F.lit(', "weights_path": '), quoted(weights), F.lit(', "weights_size": '), value(size), F.lit("}"),
    )
    return F.sha1(body.cast("binary"))


def little_endian_hex(x: Column) -> Column:
    """Hex of an INT's four bytes, lowest first."""
    h = F.lpad(F.hex(F.pmod(x.cast("bigint"), F.lit(1 << 32))), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def patch_fingerprint(patches: DataFrame, key: Sequence[str], pos: str = "patch_pos") -> DataFrame:
    """``key, fingerprint``: SHA-1 over the int32 corners of each group's patches in order."""
    corners = F.array_sort(F.collect_list(F.struct(pos, "x0", "y0", "x1", "y1")))
    hexed = F.array_join(F.transform(corners, lambda r: F.concat(*[little_endian_hex(r[c]) for c in ("x0", "y0", "x1", "y1")])), "")
    return patches.groupBy(*key).agg(F.sha1(F.unhex(hexed)).alias("fingerprint"))


def cell_fingerprint(cells: DataFrame, key: Sequence[str], grid: int, patch: int, stride_x: int, stride_y: int) -> DataFrame:
    """``patch_fingerprint`` of the patches of ``geometry.patches``, from the cells' corners ``x0, y0``: cells are counted by key, and only then are a cell's patches written out in its task, once for all cells of a batch at one place, so that no patch is a row. A key names one place; a cell that comes n times has each patch n times."""
    starts = [[x, y] for y in range(0, grid - patch + 1, stride_y) for x in range(0, grid - patch + 1, stride_x)]
    counted = cells.groupBy(*key, "x0", "y0").agg(F.count("*").alias("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corners = np.array([[x, y, x + patch, y + patch] for x, y in starts], np.int64)
        for batch in batches:
            if batch.num_rows:
                places, at = np.unique(np.column_stack([batch.column(c).to_numpy() for c in ("x0", "y0", "_n")]).astype(np.int64), axis=0, return_inverse=True)
                hashes = [hashlib.sha1((corners + [x, y, x, y]).astype("<i4").repeat(n, 0).tobytes()).hexdigest() for x, y, n in places.tolist()]
                yield pa.record_batch([*[batch.column(k) for k in key], pa.array(hashes).take(pa.array(at.ravel()))], [*key, "fingerprint"])

    out = counted.select(*key).schema.add("fingerprint", "string")
    return counted.where(F.lit(bool(starts))).mapInArrow(run, out)


def shard(rows: DataFrame, index: int, shards: int, max_samples: int | None = None, pos: str = "pos") -> DataFrame:
    """Every ``shards``-th position from ``index``, of the first ``max_samples``."""
    if not 0 <= index < shards:
        raise ValueError("index must lie in [0, shards)")
    kept = rows.where(F.col(pos) < max_samples) if max_samples else rows
    return kept.where(F.col(pos) % shards == index)


def md5_bucket(key: Column, buckets: int = 10_000) -> Column:
    """The md5 of a string as a 128-bit number, modulo ``buckets``: 32-bit pieces by Horner's rule."""
    out: Column = F.lit(0).cast("bigint")
    for i in (1, 9, 17, 25):
        out = (out * F.lit((1 << 32) % buckets) + F.conv(F.substring(F.md5(key), i, 8), 16, 10).cast("bigint")) % buckets
    return out


def is_validation(key: Column, ratio: float, buckets: int = 10_000) -> Column:
    return md5_bucket(key, buckets) < int(ratio * buckets)


def size_summary(images: DataFrame, bins: int = 40) -> DataFrame:
    """``side, n, mean, median, lo, hi, counts`` for widths and heights; ``counts`` has one entry for each bin."""
    sides = images.select(F.explode(F.array(F.struct(F.lit("width").alias("side"), F.col("width").alias("v")), F.struct(F.lit("height").alias("side"), F.col("height").alias("v")))).alias("x")).select("x.*")
    stats = sides.groupBy("side").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))))
    binned = sides.join(F.broadcast(stats), "side").groupBy("side", at.cast("int").alias("bin")).agg(F.count("*").alias("k"))
    filled = binned.groupBy("side").agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at(F.col("m"), b), F.lit(0)))
    return stats.join(filled, "side").select("side", "n", "mean", "median", "lo", "hi", counts.alias("counts"))
