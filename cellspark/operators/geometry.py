"""Grids, windows, boxes and their joins (GEO1-GEO10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspark.operators.sampling import hash_order


def resized(size: Column, grid: int) -> Column:
    """GEO1: the nearest multiple of the grid (half to even), at least one grid."""
    return F.greatest(F.lit(grid), (F.bround(size / grid) * grid).cast("int"))


def _range(stop: Column, step: int) -> Column:
    """0, step, … below ``stop``; empty if stop is not positive."""
    return F.when(stop > 0, F.sequence(F.lit(0), (stop - 1).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def cells(images: DataFrame, grid: int) -> DataFrame:
    """GEO2: adds ``cell_row, cell_col, x0, y0, x1, y1`` for non-overlapping cells; fails where an image isn't divisible."""
    fine = (F.col("width") % grid == 0) & (F.col("height") % grid == 0)
    checked = images.withColumn("width", F.when(fine, F.col("width")).otherwise(F.raise_error(F.lit("image size is not a multiple of the grid")).cast("int")))
    each = checked.withColumn("cell_row", F.explode(_range(F.floor(F.col("height") / grid), 1))).withColumn("cell_col", F.explode(_range(F.floor(F.col("width") / grid), 1)))
    return each.withColumns({"x0": F.col("cell_col") * grid, "y0": F.col("cell_row") * grid, "x1": (F.col("cell_col") + 1) * grid, "y1": (F.col("cell_row") + 1) * grid})


def patches(cell_rows: DataFrame, grid: int, patch: int, stride_x: int, stride_y: int) -> DataFrame:
    """GEO2: patches inside each cell, row by row; ``patch_pos`` is the position in the cell."""
    per_row = max(0, (grid - patch) // stride_x + 1) if patch <= grid else 0
    down = cell_rows.withColumn("_py", F.explode(_range(F.lit(grid - patch + 1), stride_y)))
    both = down.withColumn("_px", F.explode(_range(F.lit(grid - patch + 1), stride_x)))
    x, y = F.col("x0") + F.col("_px"), F.col("y0") + F.col("_py")
    pos = (F.col("_py") / stride_y).cast("int") * per_row + (F.col("_px") / stride_x).cast("int")
    return both.select(*[c for c in cell_rows.columns if c not in ("x0", "y0", "x1", "y1")], pos.alias("patch_pos"), x.alias("x0"), y.alias("y0"), (x + patch).alias("x1"), (y + patch).alias("y1"))


def sliding_windows(images: DataFrame, patch: int, stride: int) -> DataFrame:
    """GEO3: top-left corners ``y0, x0`` of whole windows; images smaller than a window have none."""
    if patch <= 0 or stride <= 0:
        raise ValueError("patch and stride must be positive")
    return images.withColumn("y0", F.explode(_range(F.col("height") - patch + 1, stride))).withColumn("x0", F.explode(_range(F.col("width") - patch + 1, stride)))


def covering_tiles(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """GEO4: ``tile_idx, x, y, valid_w, valid_h`` of tiles that start at every stride inside the image."""
    across = F.ceil(F.col("width") / stride).cast("int")
    each = images.withColumn("y", F.explode(_range(F.col("height"), stride))).withColumn("x", F.explode(_range(F.col("width"), stride)))
    return each.withColumns({
        "tile_idx": (F.col("y") / stride).cast("int") * across + (F.col("x") / stride).cast("int"),
        "valid_w": F.least(F.lit(tile), F.col("width") - F.col("x")),
        "valid_h": F.least(F.lit(tile), F.col("height") - F.col("y")),
    })


def corners(boxes: DataFrame, to_width: Column | None = None, to_height: Column | None = None) -> DataFrame:
    """GEO5: adds ``x0, y0, x1, y1`` of ``bx, by, bw, bh``, scaled from ``width`` x ``height`` to the given size."""
    sx = to_width / F.col("width") if to_width is not None else F.lit(1.0)
    sy = to_height / F.col("height") if to_height is not None else F.lit(1.0)
    return boxes.withColumns({"x0": F.col("bx") * sx, "y0": F.col("by") * sy, "x1": (F.col("bx") + F.col("bw")) * sx, "y1": (F.col("by") + F.col("bh")) * sy})


def longest_edge_scale(width: Column, height: Column, max_edge: int) -> Column:
    """GEO5: the factor that brings the longer edge to ``max_edge``."""
    return F.lit(float(max_edge)) / F.greatest(width, height)


def iou(a: str, b: str) -> Column:
    """GEO6: intersection over union of two aliased boxes; 0 if the union is empty."""
    c = lambda t, n: F.col(f"{t}.{n}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda t: F.greatest(F.lit(0.0), c(t, "x1") - c(t, "x0")) * F.greatest(F.lit(0.0), c(t, "y1") - c(t, "y0"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


#: Squares that a cell may touch along one side, at most, about.
SPREAD = 64


def square_side(cell_rows: DataFrame) -> tuple[float, dict[str, float]] | None:
    """Side of the squares for ``overlaps`` and the extents of all cells: one row of sums comes to the driver. The mean side of a cell, larger only where some cell is ``SPREAD`` times as large; None without cells."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    row = cell_rows.agg(
        F.avg(F.when(side > 0, side)).alias("mean"), F.max(side).alias("most"), F.min(F.least("x0", "x1")).alias("x_low"), F.max(F.greatest("x0", "x1")).alias("x_high"), F.min(F.least("y0", "y1")).alias("y_low"), F.max(F.greatest("y0", "y1")).alias("y_high")
    ).first()
    if row.x_low is None or row.y_low is None:
        return None
    return max(float(row.mean or 1.0), float(row.most) / SPREAD), {k: float(row[k]) for k in ("x_low", "x_high", "y_low", "y_high")}


def overlaps(cell_rows: DataFrame, boxes: DataFrame, image: str = "image") -> DataFrame:
    """GEO6: ``image, cell_row, cell_col, label, iou`` of boxes that meet cells.

    A grid join: cells and boxes go to every square of a grid that they touch, and only those
    of one square of an image are compared, so that the work grows with what meets and not
    with cells times boxes of an image. A pair that shares several squares counts in the one that
    holds the top left corner of its intersection. Boxes count within the extents of all cells.
    """
    found = square_side(cell_rows)
    side, ends = found or (1.0, dict.fromkeys(("x_low", "x_high", "y_low", "y_high"), 0.0))
    index = lambda v: F.floor(v / F.lit(side)).cast("bigint")

    def touched(axis: str) -> Column:
        a, b = F.col(f"{axis}0").cast("double"), F.col(f"{axis}1").cast("double")
        low, high = F.greatest(F.least(a, b), F.lit(ends[f"{axis}_low"])), F.least(F.greatest(a, b), F.lit(ends[f"{axis}_high"]))
        # A corner of an intersection lies before its right and lower edges, so a square that only begins there isn't touched.
        last = F.when((a < b) & (b == high), F.ceil(high / F.lit(side)).cast("bigint") - 1).otherwise(index(high))
        return F.when(low <= high, F.sequence(index(low), F.greatest(index(low), last))).otherwise(F.array().cast("array<bigint>"))

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn("_sx", F.explode(touched("x"))).withColumn("_sy", F.explode(touched("y"))).alias(name)

    c, b = dealt(cell_rows.select(image, "cell_row", "cell_col", "x0", "y0", "x1", "y1"), "c"), dealt(boxes.select(image, "label", "x0", "y0", "x1", "y1"), "b")
    same = (F.col(f"c.{image}") == F.col(f"b.{image}")) & (F.col("c._sx") == F.col("b._sx")) & (F.col("c._sy") == F.col("b._sy"))
    meet = (F.col("c.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("c.x1")) & (F.col("c.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("c.y1"))
    corner = lambda axis: index(F.greatest(F.col(f"c.{axis}0"), F.col(f"b.{axis}0")).cast("double")) == F.col(f"c._s{axis}")
    return c.join(b, same & meet & corner("x") & corner("y")).select(f"c.{image}", "c.cell_row", "c.cell_col", "b.label", iou("c", "b").alias("iou"))


def assign_labels(cell_rows: DataFrame, boxes: DataFrame, threshold: float = 0.05, classes: int = 63, image: str = "image") -> DataFrame:
    """GEO7: ``dominant`` (class of the largest summed IoU, the smaller on a tie, if any single IoU reaches the threshold, else -1) and ``multi_hot`` (classes whose summed IoU exceeds it) for every cell."""
    key = [image, "cell_row", "cell_col"]
    sums = overlaps(cell_rows, boxes, image).groupBy(*key, "label").agg(F.sum("iou").alias("total"), F.max("iou").alias("most"))
    best = sums.groupBy(*key).agg(
        F.max(F.struct("total", (-F.col("label")).alias("neg"))).alias("top"), F.max("most").alias("most"), F.collect_set(F.when(F.col("total") > threshold, F.col("label"))).alias("hot")
    )
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce(F.array_contains(F.col("hot"), i), F.lit(False)).cast("int"))
    return cell_rows.join(best, key, "left").select(*key, F.when(F.col("most") >= threshold, -F.col("top.neg")).otherwise(-1).alias("dominant"), hot.alias("multi_hot"))


def adjacent_pairs(cell_rows: DataFrame, image: str = "image", carry: tuple[str, ...] = ()) -> DataFrame:
    """GEO8: neighbouring cells, right and below, each pair once; columns of the neighbour end in ``_2``."""
    other = cell_rows.select(*[F.col(c).alias(f"{c}_2") for c in (image, "cell_row", "cell_col", *carry)])
    mine = cell_rows.select(image, "cell_row", "cell_col", *carry)
    # One equi-join: each cell looks for two keys.
    looks = mine.withColumn("_to", F.explode(F.array(F.struct(F.col("cell_row").alias("r"), (F.col("cell_col") + 1).alias("c")), F.struct((F.col("cell_row") + 1).alias("r"), F.col("cell_col").alias("c")))))
    return looks.join(other, (F.col(image) == F.col(f"{image}_2")) & (F.col("_to.r") == F.col("cell_row_2")) & (F.col("_to.c") == F.col("cell_col_2"))).drop("_to")


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(eps))
    return dot(a, b) / (norm(a) * norm(b))


def smoothness(cell_rows: DataFrame, image: str = "image") -> DataFrame:
    """GEO9: ``n_pairs, smoothness``: mean over neighbours of max(0, target cosine - feature cosine), the first halved if both have labels and these differ."""
    pairs = adjacent_pairs(cell_rows, image, ("target", "feature", "label"))
    differ = (F.col("label") >= 0) & (F.col("label_2") >= 0) & (F.col("label") != F.col("label_2"))
    wanted = cosine(F.col("target"), F.col("target_2")) * F.when(differ, 0.5).otherwise(1.0)
    return pairs.agg(F.count("*").alias("n_pairs"), F.avg(F.greatest(F.lit(0.0), wanted - cosine(F.col("feature"), F.col("feature_2")))).alias("smoothness"))


def triplets(tiles: DataFrame, tile: int, seed: int = 42, image: str = "image") -> DataFrame:
    """GEO10: for each tile a positive (by hash: a tile of its image within 3 tile sizes, else any other, else itself) and a negative (a tile of another image, if there is one).

    Tiles of a grid square of that size meet those of the nine squares around it as arrays, so
    that near pairs are never rows; the other choices pick a number by hash from an image's
    list of tiles.
    """
    reach = 3.0 * tile
    square = lambda v: F.floor(F.col(v) / reach)
    name = lambda t: F.concat_ws(":", F.col(image).cast("string"), t.cast("string"))
    member = F.struct(F.col("tile_idx").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    squares = tiles.groupBy(image, square("x").alias("_sx"), square("y").alias("_sy")).agg(F.collect_list(member).alias("_tiles"))
    steps = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    # Each square sends its tiles to the squares around it.
    sent = squares.select(image, "_sx", "_sy", "_tiles", F.explode(steps).alias("_s")).select(image, (F.col("_sx") + F.col("_s.x")).alias("_sx"), (F.col("_sy") + F.col("_s.y")).alias("_sy"), F.when((F.col("_s.x") == 0) & (F.col("_s.y") == 0), F.col("_tiles")).alias("_own"), "_tiles")
    met = sent.groupBy(image, "_sx", "_sy").agg(F.flatten(F.collect_list("_own")).alias("_own"), F.flatten(F.collect_list("_tiles")).alias("_all")).where(F.size("_own") > 0)
    pick = lambda a, b: F.md5(F.concat_ws(":", F.lit(str(seed)), name(a.t), b.t.cast("string")))
    close = lambda a, b: (a.t != b.t) & (F.sqrt(F.pow(a.x - b.x, 2) + F.pow(a.y - b.y, 2)) <= reach)
    nearest = lambda a: F.array_min(F.transform(F.filter("_all", lambda b: close(a, b)), lambda b: F.struct(pick(a, b).alias("h"), b.t.alias("t"))))
    near = met.select(image, F.explode(F.transform("_own", lambda a: F.struct(a.t.alias("t"), nearest(a).t.alias("near")))).alias("_n")).select(image, F.col("_n.t").alias("tile_idx"), F.col("_n.near").alias("_near"))
    # Images by number, over ranges of the hash; another image or tile is a hashed step ahead, cyclically.
    lists = tiles.groupBy(image).agg(F.sort_array(F.collect_list("tile_idx")).alias("_ts"))
    hashed = lists.withColumn("_h", hash_order(seed, image)).withColumn("_range", F.substring("_h", 1, 3))
    base = hashed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_images"))  # at most 4096 rows
    images = hashed.join(F.broadcast(base), "_range").withColumn("_image_no", F.col("_base") + F.row_number().over(Window.partitionBy("_range").orderBy("_h", image)) - 1).select(image, "_ts", "_image_no", "_images")
    draw = lambda salt, t: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{salt}"), name(t))), 1, 8), 16, 10).cast("bigint")
    n = F.size("_ts")
    other = lambda t, i: F.when(n > 1, F.get("_ts", ((i + 1 + draw("other", t) % (n - 1)) % n).cast("int"))).otherwise(t)
    step = lambda t: F.when(F.col("_images") > 1, (F.col("_image_no") + 1 + draw("image", t) % (F.col("_images") - 1)) % F.col("_images")).otherwise(F.col("_image_no"))
    drawn = images.select(image, F.explode(F.transform("_ts", lambda t, i: F.struct(t.alias("t"), other(t, i).alias("other"), step(t).alias("no"), draw("tile", t).alias("draw")))).alias("_d"))
    drawn = drawn.select(image, F.col("_d.t").alias("tile_idx"), F.col("_d.other").alias("_other"), F.col("_d.no").alias("_no"), F.col("_d.draw").alias("_draw"))
    there = images.select(F.col("_image_no").alias("_no"), F.col(image).alias("neg_image"), F.col("_ts").alias("_neg"))
    # Tiles are many times the rows that Spark expects from the size of the images' files, so neither side may be broadcast.
    full = drawn.join(there.hint("merge"), "_no").select(image, "tile_idx", "_other", "neg_image", F.get("_neg", (F.col("_draw") % F.size("_neg")).cast("int")).alias("neg_tile")).join(near.hint("merge"), [image, "tile_idx"])
    return full.select(image, "tile_idx", F.coalesce("_near", "_other").alias("pos_tile"), F.col("_near").isNotNull().alias("pos_near"), "neg_image", "neg_tile")
