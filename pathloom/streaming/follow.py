"""Recordings as they arrive: lines followed frame by frame, running contrast bounds, and windows over positions.

The state of a layer is its last line and gray frame, so it stays small however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathloom.operators.propagation import Follower

OUT = "video_id string, layer_id string, frame_id int, status string, xs array<double>, ys array<double>"
STATE = "frame_id int, height int, width int, gray binary, xs array<double>, ys array<double>, bx array<double>, by array<double>"


def follow(frames: DataFrame, points: int = 60, reach: int = 12, mode: str = "upper_left") -> DataFrame:
    """A stream ``frames(video_id, layer_id, frame_id, height, width, data, xs, ys)`` -> the layer's line at each frame.

    The first frame with points (xs, ys) starts a layer. Within a micro-batch a layer's frames are taken in order; a frame at or
    before the last one that was worked off is late and gets status 'late'. Each later frame is a batch of its own: the line is
    tracked forth and back, blended, smoothed and refined as in the batch operator.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = Follower(mode, points, reach)
        last = -1
        if state.exists:
            last, h, w, gray, xs, ys, bx, by = state.get
            f.anchor = np.frombuffer(gray, np.uint8).reshape(h, w).astype(float)
            f.points, f.before = np.stack([xs, ys], 1), np.stack([bx, by], 1)
        rows = []
        for pdf in parts:
            rows += pdf.to_dict("records")
        out = []
        for r in sorted(rows, key=lambda r: r["frame_id"]):
            gray = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]).astype(float)
            if f.anchor is None:
                if r["xs"] is None or not len(r["xs"]):
                    continue
                line, status = f.start(gray, np.stack([r["xs"], r["ys"]], 1).astype(float)), "seed"
            elif r["frame_id"] <= last:
                line, status = f.points, "late"
            else:
                line, status = f.batch([gray])[0], "ok"
            last = max(last, r["frame_id"])
            out.append((*key, r["frame_id"], status, line[:, 0].tolist(), line[:, 1].tolist()))
        if f.anchor is not None:
            h, w = f.anchor.shape
            state.update((int(last), h, w, f.anchor.astype(np.uint8).tobytes(), *[a.tolist() for a in (f.points[:, 0], f.points[:, 1], f.before[:, 0], f.before[:, 1])]))
        yield pd.DataFrame(out, columns=["video_id", "layer_id", "frame_id", "status", "xs", "ys"])

    return frames.groupBy("video_id", "layer_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, guidelines: str, checkpoint: str, on_batch_done: Callable[[int, DataFrame], None] | None = None, stop: Callable[[], bool] | None = None) -> str:
    """Works off what a stream of ``follow`` holds now, adding its lines to the table ``guidelines``; returns how it ended.

    After each micro-batch ``on_batch_done(batch_id, lines)`` is called, and where ``stop()`` then holds, the query ends: 'stopped'. A
    later run with the same checkpoint goes on from there. Else it ends with 'complete', or 'n errors' of failed lines. A batch that is
    repeated after a failure replaces its own rows.
    """
    seen = {"errors": 0, "stopped": False}

    def done(lines: DataFrame, batch_id: int) -> None:
        if seen["stopped"]:
            raise RuntimeError("stopped")
        own = f"{guidelines}/batch={batch_id}"
        lines.write.mode("overwrite").parquet(own)
        kept = lines.sparkSession.read.schema(lines.schema).parquet(own)
        seen["errors"] += kept.where(F.col("status").startswith("failed")).count()
        if on_batch_done:
            on_batch_done(batch_id, kept)
        seen["stopped"] = bool(stop and stop())

    query = stream.writeStream.foreachBatch(done).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not seen["stopped"]:
            raise
    return "stopped" if seen["stopped"] else f"{seen['errors']} errors" if seen["errors"] else "complete"


def running_bounds(pixels: DataFrame, key: str = "video_id") -> DataFrame:
    """Least and greatest value of each recording so far (update or complete mode)."""
    return pixels.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def windowed_positions(positions: DataFrame, time: Column, length: str = "10 minutes", late: str = "10 minutes", key: str = "track") -> DataFrame:
    """Mean and extent of each trajectory's positions in tumbling windows of event time; an extra beyond the batch operators."""
    timed = positions.withColumn("at", time.cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(key, F.window("at", length)).agg(F.count(F.lit(1)).alias("n"), F.avg("Longitudinal").alias("mean"), F.min("Longitudinal").alias("lo"), F.max("Longitudinal").alias("hi")).select(key, F.col("window.start").alias("start"), "n", "mean", "lo", "hi")
