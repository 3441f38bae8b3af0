"""Readers of the file formats of an image dataset (SRC1-SRC7) and pixel tiles (PIX1, PIX2, EXT1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from cellspark.schemas import ANNOTATION, CELL, FINE_LABELS, MERGED_LABELS, category_table


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: ``pos, path`` of a (compressed) JSON array of strings. One file is one task: write the result to Parquet before further work."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "path")).withColumn("pos", F.col("pos").cast("bigint"))


def normalised_cells(cells: DataFrame) -> DataFrame:
    """SRC2: one spelling of path and box from ``pos`` and a struct ``c``: ``img_path`` or ``image_path``; ``cell_x0…``, ``coords`` as list or object, or ``x0…``, rounded half to even."""
    c = lambda n: F.col(f"c.{n}")
    box = F.coalesce(F.from_json(c("coords"), "array<double>"))
    named = F.from_json(c("coords"), "struct<x0: double, y0: double, x1: double, y1: double>")
    corner = lambda i, n: F.bround(F.coalesce(c(f"cell_{n}"), F.get(box, i), named[n], c(n)), 0).cast("int").alias(n)
    return cells.select(
        F.col("pos").cast("bigint").alias("cell_id"), F.coalesce(c("img_path"), c("image_path")).alias("img_path"), c("json_path").alias("json_path"), c("cell_row").alias("cell_row"), c("cell_col").alias("cell_col"),
        *[corner(i, n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], c("dominant_label").alias("dominant_label"), c("target_index").alias("target_index"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: a manifest, either a list of entries or an object with ``cells``; ``cell_id`` is the position."""
    text = spark.read.text(path, wholetext=True)
    entries = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{CELL}>")).otherwise(F.from_json("value", f"struct<cells: array<{CELL}>>")["cells"])
    return normalised_cells(text.select(F.posexplode(entries).alias("pos", "c")))


def read_annotations(spark: SparkSession, paths: str | Sequence[str], skip_raw: bool = True) -> DataFrame:
    """SRC3: ``file, pos, width, height, category, label, bx, by, bw, bh`` of all sidecars; unknown categories and, by default, raw-location boxes are left out."""
    raw = spark.read.schema(ANNOTATION).json(paths, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.col("img_width").alias("width"), F.col("img_height").alias("height"), F.posexplode("bounding_boxes").alias("pos", "b"))
    kept = raw.where(F.col("b.raw_location").isNull()) if skip_raw else raw
    names = category_table(spark)
    return kept.join(F.broadcast(names), F.col("b.category") == names.category).select("file", "pos", "width", "height", names.category, "label", *[F.get(F.col("b.box"), i).alias(n) for i, n in enumerate(("bx", "by", "bw", "bh"))])


def list_files(spark: SparkSession, root: str, extensions: Sequence[str] = ("jpg", "jpeg", "png", "tif", "tiff")) -> DataFrame:
    """SRC4: ``path, length`` of all files below ``root`` with an extension, any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.where(F.col("path").rlike(r"(?i)\.(" + "|".join(extensions) + ")$"))


def read_split_csv(spark: SparkSession, path: str, mode: str, root: str, listing: DataFrame | None = None) -> DataFrame:
    """SRC5: ``path, label`` of a split; mode "12" reads the fine label, "4" the merged one. Unknown labels, empty paths and, given a listing, missing files are left out."""
    if mode not in ("12", "4"):
        raise ValueError(f"unknown label mode {mode}")
    column, names = ("label", FINE_LABELS) if mode == "12" else ("merged_label", MERGED_LABELS)
    rows = spark.read.csv(path, header=True, schema=None)
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "_name STRING, _label INT")
    out = rows.where(F.coalesce(F.col("example_path"), F.lit("")) != "").join(F.broadcast(table), F.col(column) == F.col("_name")).select(F.concat(F.lit(root.rstrip("/") + "/"), "example_path", F.lit("/images/visible/composite.png")).alias("path"), F.col("_label").alias("label"))
    return out.join(listing.select("path"), "path", "left_semi") if listing is not None else out


def read_split_list(spark: SparkSession, path: str, classes: DataFrame) -> DataFrame:
    """SRC6: ``item, category, label`` from lines ``class/file …``; blanks and ``#`` lines are skipped; a malformed line or unknown class fails when it is read. ``classes`` has ``category, label``."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    item = F.translate(F.get(F.split("line", r"\s+"), 0), "\\", "/")
    parts = lines.select("line", item.alias("item")).withColumn("category", F.when(F.size(F.split("item", "/")) >= 2, F.get(F.split("item", "/"), 0)))
    joined = parts.join(classes.select("category", "label"), "category", "left")
    return joined.select("item", "category", F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("bad split line: "), "line")).cast("int")).otherwise(F.col("label")).alias("label"))


def yolo_boxes(lines: DataFrame, width: Column, height: Column, line: str = "value") -> DataFrame:
    """SRC7: adds ``label, x0, y0, x1, y1`` to lines ``class cx cy w h`` in shares of the image: corners, clipped to [0, size - 1], empty boxes dropped, class + 1."""
    p = F.split(F.trim(F.col(line)), r"\s+")
    v = lambda i: F.get(p, i).cast("double")
    edge = lambda c, half, size: F.least(F.greatest((c + half) * size, F.lit(0.0)), size - 1.0)
    out = lines.where(F.size(p) >= 5).withColumns({
        "label": v(0).cast("int") + 1, "x0": edge(v(1), -v(3) / 2, width), "y0": edge(v(2), -v(4) / 2, height), "x1": edge(v(1), v(3) / 2, width), "y1": edge(v(2), v(4) / 2, height),
    })
    return out.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def read_yolo(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """SRC7 over files: ``stem`` is the image's name."""
    lines = spark.read.text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "value")
    return yolo_boxes(lines, F.lit(width), F.lit(height)).drop("value")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``origin, name, width, height, n_channels, data`` of decodable images (bytes by row, blue first)."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return rows.select(F.col("image.origin").alias("origin"), F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("name"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def pixel_block(data: bytes, width: int, height: int, channels: int, x: int, y: int, size: int) -> np.ndarray:
    """A square of pixels, red first, zero where it leaves the image."""
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels >= 3:
        image = image[:, :, [2, 1, 0]]
    part = image[y : y + size, x : x + size]
    out = np.zeros((size, size, part.shape[2]), np.uint8)
    out[: part.shape[0], : part.shape[1]] = part
    return out


#: A byte's pixel value in [-1, 1].
_SCALED = ((np.arange(256) / 255.0 - 0.5) / 0.5).astype(np.float32)
#: Pixel values that are cut at once, about; a row of one image's tiles at least.
TILE_VALUES = 2_000_000


def pixel_tiles(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """PIX1: ``origin, tile_idx, x, y, pixels``: covering tiles, zero-padded, scaled to [-1, 1], flattened by row and pixel. An image is cut where it lies; images of one size are cut together, some at a time."""

    def cut(images: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tile row, tile column and pixels of all tiles of images of one size, image by image for each part of the rows of tiles."""
        n, height, width, channels = images.shape
        down, across = -(-height // stride), -(-width // stride)
        padded = np.zeros((n, (down - 1) * stride + tile, (across - 1) * stride + tile, channels), np.uint8)
        rows, columns = (min(a, b) for a, b in zip(images.shape[1:3], padded.shape[1:3]))
        padded[:, :rows, :columns] = images[:, :rows, :columns]
        windows = np.lib.stride_tricks.sliding_window_view(padded, (tile, tile), (1, 2))[:, ::stride, ::stride].transpose(0, 1, 2, 4, 5, 3)
        step = max(1, TILE_VALUES // max(1, n * across * tile * tile * channels))
        for at in range(0, down, step):
            part = windows[:, at : at + step]
            y, x = np.divmod(np.arange(part.shape[1] * across), across)
            yield np.tile(y + at, n), np.tile(x, n), _SCALED[part].reshape(n * len(y), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, kind = np.unique(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("height", "width", "n_channels")]), axis=0, return_inverse=True)
            for i, size in enumerate(sizes):
                height, width, channels = (int(v) for v in size)
                if height <= 0 or width <= 0:
                    continue
                same = np.flatnonzero(kind.ravel() == i)
                down, across = -(-height // stride), -(-width // stride)
                step = max(1, TILE_VALUES // max(1, down * across * tile * tile * channels))
                for at in range(0, len(same), step):
                    rows = same[at : at + step]
                    data = [batch.column("data")[int(r)].as_buffer() for r in rows]
                    pixels = np.stack([np.frombuffer(d, np.uint8).reshape(height, width, channels) for d in data])
                    for y, x, values in cut(pixels[:, :, :, [2, 1, 0]] if channels >= 3 else pixels):
                        offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
                        whole = [pa.array(np.asarray(v, np.int32)) for v in (y * across + x, x * stride, y * stride)]
                        origin = batch.column("origin").take(pa.array(np.repeat(rows, len(values) // len(rows))))
                        yield pa.record_batch([origin, *whole, pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], ["origin", "tile_idx", "x", "y", "pixels"])

    return images.select("origin", "width", "height", "n_channels", "data").mapInArrow(run, "origin string, tile_idx int, x int, y int, pixels array<float>")


def aligned_patches(before: DataFrame, after: DataFrame, labels: DataFrame, patch: int, stride: int) -> DataFrame:
    """PIX2: ``name, x, y, a, b, changed``: the same windows of three images of one name; ``changed`` has 1 where the label is above 127."""
    cols = ("width", "height", "n_channels", "data")
    side = lambda d, p: d.select("name", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    joined = side(before, "a").join(side(after, "b"), "name").join(side(labels, "l"), "name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                cut = lambda p, x, y: pixel_block(getattr(r, f"{p}_data"), getattr(r, f"{p}_width"), getattr(r, f"{p}_height"), getattr(r, f"{p}_n_channels"), x, y, patch)  # noqa: B023, E731
                rows = [
                    (r.name, x, y, cut("a", x, y).ravel().astype(np.int16), cut("b", x, y).ravel().astype(np.int16), (cut("l", x, y)[:, :, 0] > 127).astype(np.int16).ravel())
                    for y in range(0, r.a_height - patch + 1, stride)
                    for x in range(0, r.a_width - patch + 1, stride)
                ]
                if rows:
                    yield pd.DataFrame(rows, columns=["name", "x", "y", "a", "b", "changed"])

    return joined.mapInPandas(run, "name string, x int, y int, a array<smallint>, b array<smallint>, changed array<smallint>")


def embed(rows: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], np.ndarray]], inputs: Sequence[str], batch: int = 64, column: str = "embedding", keep: Sequence[str] | None = None) -> DataFrame:
    """EXT1: adds ``column`` by a user's model: ``make_model()`` is called once in each task and gives a function from a batch of ``inputs`` to one vector for each row. NaN in a result fails. With ``keep`` only these columns come back beside it."""
    kept = list(rows.columns if keep is None else keep)
    schema = StructType([*[rows.schema[c] for c in kept], StructField(column, ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in batches:
            given, out = frame[list(inputs)], []
            for i in range(0, len(frame), batch):
                made = np.asarray(model(given.iloc[i : i + batch]), np.float32)
                if np.isnan(made).any():
                    raise ValueError("the model gave NaN")
                out.extend(made)
            yield frame[kept].assign(**{column: out})

    return rows.mapInPandas(run, schema)


def index_rows(images: DataFrame, tile: int, stride: int, make_model: Callable, batch: int = 64) -> DataFrame:
    """RET6: ``origin, tile_idx, x, y, embedding``: tiles through a model, ready for the vector store."""
    return embed(pixel_tiles(images, tile, stride), make_model, ["pixels"], batch, keep=["origin", "tile_idx", "x", "y"])
