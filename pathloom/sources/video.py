"""Recordings and masks as tables: scans of image folders, TIFF stacks, frame files and pixel tables.

A file's bytes are read by Spark's own binary source, so any file system that Spark knows serves; a task decodes a few files at
a time. Frames are rows (video_id, frame_id, height, width, dtype, data); data holds the samples row by row, channels last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.names import IMAGE_EXTENSIONS, base_name, frame_number, is_image
from pathloom.schemas import FRAMES
from pathloom.shared import streamed
from pathloom.sources.hdf5 import read_hdf5
from pathloom.sources.images import decode
from pathloom.sources.nd2 import read_nd2

_NAMES = ["video_id", "frame_id", "height", "width", "dtype", "data"]
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
#: Files of one Arrow batch.
FILES_PER_BATCH = 16


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], _NAMES)


def _row(video: str, frame: int, image: np.ndarray) -> tuple:
    return video, frame, image.shape[0], image.shape[1], f"{image.dtype.name}x{image.shape[2]}" if image.ndim == 3 else image.dtype.name, image.tobytes()


def image_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, ignore_case: bool = True) -> DataFrame:
    """(path, name, frame_id, content) of a folder's images; names without a digit have a null frame_id."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content").withColumn("name", base_name(F.col("path")))
    return files.where(is_image(F.col("name"), extensions, ignore_case)).select("path", "name", frame_number(F.col("name")).cast("int").alias("frame_id"), "content")


def folder_frames(spark: SparkSession, folder: str, video_id: str = "video", policy: str = "last") -> DataFrame:
    """The frames of an image folder; of files with one frame number the last (or first) by name counts.

    The choice is made on names; contents are read for the chosen files only.
    """
    files = image_files(spark, folder)
    pick = F.max if policy == "last" else F.min
    chosen = files.where("frame_id is not null").groupBy("frame_id").agg(pick("name").alias("name"))
    own = files.join(chosen, ["frame_id", "name"], "left_semi").select("frame_id", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FILES_PER_BATCH):
                part = b.slice(at, FILES_PER_BATCH).to_pylist()
                yield _batch([_row(video_id, r["frame_id"], decode(r["content"])[0]) for r in part])

    return own.mapInArrow(run, FRAMES)


def stack_frames(spark: SparkSession, path: str, video_id: str = "video") -> DataFrame:
    """The pages of a TIFF stack; a page's index is its frame number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for k, page in enumerate(decode(content.as_py())):
                    yield _batch([_row(video_id, k, page)])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, FRAMES)


def hdf5_frames(spark: SparkSession, path: str, key: str | None = None, video_id: str = "video", start: int = 0, end: int | None = None) -> DataFrame:
    """Frames start..end - 1 of an HDF5 dataset (its first one without a key); see ``sources.hdf5``."""
    return read_hdf5(spark, path, key, video_id, start, end)


def nd2_frames(spark: SparkSession, path: str, video_id: str = "video", start: int = 0, end: int | None = None) -> DataFrame:
    """Frames start..end - 1 of an ND2 recording, the first channel and plane; see ``sources.nd2``."""
    return read_nd2(spark, path, video_id, start, end)


def read_video(spark: SparkSession, path: str, video_id: str = "video") -> DataFrame:
    """Frames of whatever ``path`` names, told from its extension; a path without a known one is an image folder."""
    end = path.rstrip("/").rpartition(".")[2].lower()
    if end in ("tif", "tiff"):
        return stack_frames(spark, path, video_id)
    if end in ("h5", "hdf5"):
        return hdf5_frames(spark, path, video_id=video_id)
    if end == "nd2":
        return nd2_frames(spark, path, video_id)
    if end == "parquet":
        return spark.read.schema(FRAMES).parquet(path)
    return folder_frames(spark, path, video_id)


def frame_at(frames: DataFrame, frame_id: int) -> DataFrame:
    """Point look-up; the filter reaches the Parquet scan."""
    return frames.where(F.col("frame_id") == frame_id)


def pixels_of(frames: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(frame_id, x, y, v) of gray frames, (frame_id, x, y, r, g, b) of colour frames where asked by ``colour_pixels_of``; a
    half-open box (ymin, ymax, xmin, xmax) is cut out before rows are made."""
    return _explode(frames, box, ["v"])


def colour_pixels_of(frames: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    return _explode(frames, box, ["r", "g", "b"])


def _explode(frames: DataFrame, box, channels: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                image = as_array(r)
                image = image[:, :, None] if image.ndim == 2 else image
                y0, y1, x0, x1 = box or (0, image.shape[0], 0, image.shape[1])
                part = image[max(0, y0) : y1, max(0, x0) : x1]
                part = part if part.shape[2] >= len(channels) else np.repeat(part[:, :, :1], len(channels), 2)
                h, w = part.shape[:2]
                ys, xs = np.mgrid[max(0, y0) : max(0, y0) + h, max(0, x0) : max(0, x0) + w]
                columns = [np.full(h * w, r["frame_id"], np.int64), xs.ravel().astype(np.int64), ys.ravel().astype(np.int64)] + [part[:, :, k].ravel().astype(np.int64) for k in range(len(channels))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["frame_id", "x", "y", *channels])

    return frames.select("frame_id", "height", "width", "dtype", "data").mapInArrow(run, "frame_id long, x long, y long, " + ", ".join(f"{c} long" for c in channels))


def as_array(row: dict) -> np.ndarray:
    """The array of a frame's row."""
    kind, _, samples = row["dtype"].partition("x")
    shape = (row["height"], row["width"], int(samples)) if samples else (row["height"], row["width"])
    return np.frombuffer(row["data"], kind).reshape(shape)


def packed(pixels: DataFrame, width: int, height: int, video_id: str = "video") -> DataFrame:
    """Frames of 8-bit gray pixel rows ``(frame_id, x, y, v)``; missing pixels are 0, of equal places the last counts. A task holds one frame."""
    inside = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
    own = pixels.where(inside).select(F.col("frame_id").cast("int").alias("frame_id"), (F.col("y").cast("long") * width + F.col("x")).alias("place"), F.col("v").cast("short").alias("v"))
    dealt = own.repartition("frame_id").sortWithinPartitions("frame_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, rows in streamed(batches, 1):
            image = np.zeros(height * width, np.uint8)
            for b in rows:
                image[b.column(1).to_numpy()] = b.column(2).to_numpy()
            yield _batch([_row(video_id, first.column(0)[0].as_py(), image.reshape(height, width))])

    return dealt.mapInArrow(run, FRAMES)
