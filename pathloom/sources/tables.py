"""CSV and Parquet tables of the pipeline, read and written with fixed schemas; exports and the tables behind figures."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.pixels import in_bounds
from pathloom.operators.sequences import ordered
from pathloom.schemas import POI, SKELETON, TRAJECTORY, require_columns
from pathloom.sources.images import write_png
from pathloom.sources.video import as_array


def read_csv(spark: SparkSession, path: str, schema: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file, or a folder of files with one header, by its column names: those of ``schema`` first, with their types, then the
    others as text. ValueError where one is missing that isn't ``optional`` (such a one is null); rows without a value in any of
    them, or with one that isn't of its type, are left out."""
    raw = spark.read.csv(path, header=True)
    fields = [f.split() for f in schema.split(", ")]
    needed = [n for n, _ in fields if n not in optional]
    own = [F.col(f"`{n}`").try_cast(t).alias(n) if n in raw.columns else F.lit(None).cast(t).alias(n) for n, t in fields]
    more = [F.col(f"`{c}`") for c in raw.columns if c not in {n for n, _ in fields}]
    return require_columns(require_columns(raw, needed).select(*own, *more), needed)


def read_skeleton(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SKELETON, ("node_spacing",))


def skeleton_arrays(skeleton: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """One row a frame with its points in node order."""
    own = skeleton.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("node_id", F.col("x_pixel").alias("x"), F.col("y_pixel").alias("y")))).alias("p"))
    return own.select(*keys, F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


def stored_skeleton(skeleton: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """The columns as they are stored: coordinates clipped to the frame and rounded to 4 decimals, spacing to 6."""
    clip = lambda c, n: F.col(c) if n is None else F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(n - 1)))
    return skeleton.select("frame_id", "node_id", F.round(clip("x_pixel", width), 4).alias("x_pixel"), F.round(clip("y_pixel", height), 4).alias("y_pixel"), F.round("node_spacing", 6).alias("node_spacing"))


def write_skeleton(skeleton: DataFrame, path: str, width: int | None = None, height: int | None = None) -> None:
    """CSV sorted by frame and node; never into the path that is read."""
    stored_skeleton(skeleton, width, height).orderBy("frame_id", "node_id").write.csv(path, header=True)


def read_trajectories(spark: SparkSession, paths: list[str], track: str | None = None) -> DataFrame:
    """Several files as one table, each by its own header, with Trajectory_ID (the column ``track``, or 0 where none is named) and
    source_file, the row's file name; a path listed twice is read once."""
    out = None
    for path in dict.fromkeys(paths):
        own = read_csv(spark, path, TRAJECTORY if track is None else f"{TRAJECTORY}, {track} int")
        own = own.withColumn("Trajectory_ID", F.lit(0) if track is None else F.col(track)).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def write_trajectory(trajectory: DataFrame, path: str) -> None:
    names = [f.split()[0] for f in TRAJECTORY.split(", ")]
    trajectory.select(*names).orderBy("Frame").write.csv(path, header=True)


def preview(df: DataFrame, n: int = 5) -> dict:
    """Row count, columns and the first rows."""
    return {"rows": df.count(), "columns": df.columns, "head": df.limit(n).collect()}


def write_poi(poi: DataFrame, path: str) -> None:
    """Points of interest with their fixed columns first, nulls where a column lacks."""
    fixed = [f.split() for f in POI.split(", ")]
    columns = [F.col(n).cast(t).alias(n) if n in poi.columns else F.lit(None).cast(t).alias(n) for n, t in fixed]
    more = [c for c in poi.columns if c not in {n for n, _ in fixed}]
    poi.select(*columns, *more).write.csv(path, header=True)


def write_video(frames: DataFrame, path: str) -> None:
    """Parquet by recording, frames in order, so that a frame's look-up reads few row groups."""
    dealt = frames.repartitionByRange("video_id", "frame_id").sortWithinPartitions("video_id", "frame_id")
    dealt.write.option("compression", "zstd").partitionBy("video_id").parquet(path)


def overlay_segments(skeleton: DataFrame, width: int, height: int, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Segments between neighbouring nodes whose truncated ends are both in the frame."""
    w = ordered(keys)
    cut = lambda c: F.col(c).cast("int")
    s = skeleton.select(*keys, "node_id", cut("x_pixel").alias("x"), cut("y_pixel").alias("y"))
    s = s.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 is not null")
    return s.where(in_bounds(F.col("x"), F.col("y"), width, height) & in_bounds(F.col("x2"), F.col("y2"), width, height))


def encoded_masks(masks: DataFrame, colour: tuple[int, int, int]) -> DataFrame:
    """(layer_id, frame_id, name, content): each mask as a PNG of the layer's colour (red, green, blue) on black."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                fg = as_array(r | {"dtype": "uint8"}) > 0
                out.append((r["layer_id"], r["frame_id"], f"{r['frame_id']}.png", write_png(fg[:, :, None] * np.array(colour, np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.binary()))], ["layer_id", "frame_id", "name", "content"])

    return masks.select("layer_id", "frame_id", "height", "width", "data").mapInArrow(run, "layer_id string, frame_id int, name string, content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Writes (name, content) as single files. ``folder`` must be mounted on all machines; a rerun of a task overwrites its own files."""

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{r['name']}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, os.path.join(folder, r["name"]))

    files.select("name", "content").foreachPartition(run)


# --- the tables behind figures ---


def time_series(units: DataFrame, key: str = "track") -> DataFrame:
    """Time against both coordinates, in order."""
    return units.select(key, "time_s", "longitudinal_um", "transverse_um").orderBy(key, "time_s")


def spatial(units: DataFrame, ends: DataFrame, key: str = "track") -> DataFrame:
    """Each position with a mark at its trajectory's first and last frame."""
    mark: Column = F.when(F.col("Frame") == F.col("first_frame"), "first").when(F.col("Frame") == F.col("last_frame"), "last")
    return units.join(ends.select(key, "first_frame", "last_frame"), key).select(key, "Frame", "longitudinal_um", "transverse_um", mark.alias("mark"))
