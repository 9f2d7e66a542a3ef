"""Mask files as rows: frame numbers, look-ups, pairings of folders, and the ranges that layers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions.names import frame_number
from pathloom.operators.ranking import global_index


def with_frames(files: DataFrame) -> DataFrame:
    """Adds frame_id, the first digit run of ``name``; names without one drop out."""
    return files.withColumn("frame_id", frame_number(F.col("name"))).where("frame_id is not null")


def one_per_frame(files: DataFrame, policy: str = "first", keys: tuple[str, ...] = ()) -> DataFrame:
    """One file for each frame number: the first or the last by name."""
    pick = F.min if policy == "first" else F.max
    return with_frames(files).groupBy(*keys, "frame_id").agg(pick("name").alias("name"))


def lookup(files: DataFrame, wanted: DataFrame, policy: str = "first") -> DataFrame:
    """``wanted(frame_id)`` with the file of each, null where there is none."""
    return wanted.join(one_per_frame(files, policy), "frame_id", "left")


def lookup_either(output: DataFrame, given: DataFrame, wanted: DataFrame) -> DataFrame:
    """The file in the output folder, else that in the input folder."""
    out, inp = one_per_frame(output).withColumnRenamed("name", "_out"), one_per_frame(given).withColumnRenamed("name", "_in")
    return wanted.join(out, "frame_id", "left").join(inp, "frame_id", "left").select(*wanted.columns, F.coalesce("_out", "_in").alias("name"), F.col("_out").isNotNull().alias("from_output"))


def pair_by_position(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """The i-th name of one folder with the i-th of the other, as far as the shorter goes: (position, upper, lower, frame_id of upper)."""
    a = global_index(upper.select(F.col("name").alias("upper")), "upper", name="position")
    b = global_index(lower.select(F.col("name").alias("lower")), "lower", name="position")
    return a.join(b, "position").select("position", "upper", "lower", frame_number(F.col("upper")).alias("frame_id"))


def pair_by_frame(upper: DataFrame, lower: DataFrame, policy: str = "last") -> DataFrame:
    """Files of one frame number: (frame_id, upper, lower)."""
    a, b = one_per_frame(upper, policy).withColumnRenamed("name", "upper"), one_per_frame(lower, policy).withColumnRenamed("name", "lower")
    return a.join(b, "frame_id").select("frame_id", "upper", "lower")


def missing_files(given: DataFrame, output: DataFrame) -> DataFrame:
    """Input files that the output folder lacks, by name."""
    return given.join(output.select("name"), "name", "left_anti")


def common_frames(frames: DataFrame, layer: str = "layer") -> DataFrame:
    """Frames that every layer has. ``frames(layer, frame_id)`` may repeat."""
    pairs = frames.select(layer, "frame_id").distinct()
    n = pairs.select(layer).distinct().agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_c")).join(F.broadcast(n), F.col("_c") == F.col("_n")).select("frame_id")


def timeline_range(frames: DataFrame, layer: str = "layer") -> DataFrame:
    """First and last common frame; null, null without any."""
    return common_frames(frames, layer).agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))


def valid_frames(df: DataFrame, total: int, frame: str = "frame_id") -> DataFrame:
    return df.where(F.col(frame).isNotNull() & (F.col(frame) < total))


def frame_range(df: DataFrame, start: int, end: int | None = None, frame: str = "frame_id") -> DataFrame:
    """Frames of the half-open range, its start at least 0; ValueError where it is empty. The filter reaches the scan."""
    start = max(0, start)
    if end is not None and end <= start:
        raise ValueError(f"empty frame range {start}..{end}")
    df = df.where(F.col(frame) >= start)
    return df if end is None else df.where(F.col(frame) < end)


def two_dimensional(df: DataFrame, axes: tuple[str, ...] = ("channel", "z")) -> DataFrame:
    """The plane at index 0 of each further axis that the table has."""
    for a in axes:
        if a in df.columns:
            df = df.where(F.col(a) == 0).drop(a)
    return df


def blank_frames(files: DataFrame, start: int, end: int) -> DataFrame:
    """Names of the frames start..end (both included) that the folder lacks: (frame_id, name)."""
    every = files.sparkSession.range(start, end + 1).select(F.col("id").alias("frame_id"), F.concat(F.col("id").cast("string"), F.lit(".png")).alias("name"))
    return every.join(files.select("name"), "name", "left_anti").select("frame_id", "name")


# --- plans over frames ---


def fixed_batches(frames: DataFrame, size: int = 5, frame: str = "frame_id", keys: tuple[str, ...] = ("layer_id",)) -> DataFrame:
    """Adds batch_id: runs of ``size`` consecutive rows in frame order within the keys, and the anchor, the last frame of the batch before."""
    w = Window.partitionBy(*keys).orderBy(frame)
    df = df_ = frames.withColumn("batch_id", F.floor((F.row_number().over(w) - 1) / size))
    last = df_.groupBy(*keys, "batch_id").agg(F.max(frame).alias("_last"))
    before = last.select(*keys, (F.col("batch_id") + 1).alias("batch_id"), F.col("_last").alias("anchor"))
    return df.join(before, [*keys, "batch_id"], "left")


def random_batches(frames: list[int], seed: int, most: int = 5) -> list[list[int]]:
    """Consecutive runs of 1..most frames, their lengths drawn with the seed; the plan of one run, so a list of the driver."""
    import random

    rng, out, at = random.Random(seed), [], 0
    while at < len(frames):
        n = rng.randint(1, most)
        out.append(frames[at : at + n])
        at += n
    return out


def previous_frame(frames: DataFrame, anchor: Column | None = None, frame: str = "frame_id", keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Adds previous: the frame before in its batch, else the anchor."""
    before = F.lag(frame).over(Window.partitionBy(*keys).orderBy(frame))
    return frames.withColumn("previous", before if anchor is None else F.coalesce(before, anchor))


def work_plan(batches: DataFrame, layers: DataFrame) -> DataFrame:
    """A row for each layer and batch frame; every layer works on every frame, so the product is the result."""
    return batches.crossJoin(layers)
