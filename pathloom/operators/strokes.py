"""Strokes of guide lines, versions of masks, and points of interest, as tables of events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.schemas import MODES
from pathloom.shared import gathered, streamed

#: The colours (red, green, blue) of new layers, in turn.
PALETTE = ((0, 200, 80), (30, 120, 255), (255, 180, 0), (220, 60, 220), (0, 210, 230), (255, 90, 40))


def layer_mode(strokes: DataFrame, default: str = "object", key: str = "layer_id") -> DataFrame:
    """The mode of each layer's latest stroke that has one, else the default."""
    own = F.when(F.length("edge_mode") > 0, F.col("edge_mode"))
    return strokes.groupBy(key).agg(F.coalesce(F.max_by(own, F.when(own.isNotNull(), F.col("seq"))), F.lit(default)).alias("mode"))


def flat_points(strokes: DataFrame, keys: tuple[str, ...] = ("layer_id",), by_mode: bool = False) -> DataFrame:
    """All points of the strokes in order, as rows (keys, seq, place, x, y)."""
    more = ["edge_mode"] if by_mode else []
    return strokes.select(*keys, *more, "seq", F.posexplode("pts").alias("place", "p")).select(*keys, *more, "seq", "place", "p.x", "p.y")


def enough_points(n: Column, mode: Column) -> Column:
    """Whether a shape of this mode has the least number of points that it needs."""
    need = F.create_map(*[F.lit(v) for pair in MODES.items() for v in pair])
    return n >= F.coalesce(F.try_element_at(need, mode), F.lit(max(MODES.values())))


def erase(strokes: DataFrame, x: float, y: float, radius: float = 5.0) -> DataFrame:
    """Strokes without the points within ``radius`` of a place; strokes that are left empty go."""
    kept = F.filter("pts", lambda p: (p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y) > radius * radius)
    return strokes.withColumn("pts", kept).where(F.size("pts") > 0)


def hit(strokes: DataFrame, x: float, y: float, radius: float = 5.0, keys: tuple[str, ...] = ("layer_id",)) -> DataFrame:
    """The first (seq, place) within d^2 <= 2 radius^2 of a place; layers without one drop out."""
    d2 = lambda p: (p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)
    place = F.array_position(F.transform("pts", lambda p: d2(p) <= 2 * radius * radius), True) - 1
    found = strokes.withColumn("place", place).where("place >= 0")
    return found.groupBy(*keys).agg(F.min(F.struct("seq", "place")).alias("h")).select(*keys, "h.seq", "h.place")


def colour_of(index: Column) -> Column:
    """The palette's colour of the n-th layer."""
    colours = F.array(*[F.array(*[F.lit(v) for v in c]) for c in PALETTE])
    return F.get(colours, (index % len(PALETTE)).cast("int"))


# --- versions ---


def versions(events: DataFrame, keys: tuple[str, ...] = ("layer_id",), seq: str = "seq") -> DataFrame:
    """Undo and redo: ``events(keys, seq, op, version)`` with op edit, undo or redo -> (keys, current, undo_depth, redo_depth).

    An edit pushes the current version on the undo stack and clears the redo stack; undo and redo move it between the stacks,
    and do nothing on an empty one. Before the first edit the current version is null. Sorted events are streamed; a task holds
    one layer's two stacks.
    """
    own = events.select(*keys, seq, "op", F.col("version").cast("long").alias("version"))
    dealt = own.repartition(*keys).sortWithinPartitions(*keys, seq, "op", "version")
    n = len(keys)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple]]:
        for name, rows in streamed(batches, n):
            now, undo, redo = None, [], []
            for b in rows:
                for op, version in zip(b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist()):
                    if op == "edit":
                        undo.append(now)
                        now, redo = version, []
                    elif op == "undo" and undo:
                        redo.append(now)
                        now = undo.pop()
                    elif op == "redo" and redo:
                        undo.append(now)
                        now = redo.pop()
            yield name, (now, len(undo), len(redo))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(folded(batches), n, {"current": pa.int64(), "undo_depth": pa.int32(), "redo_depth": pa.int32()})

    kinds = dict(events.dtypes)
    return dealt.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", current long, undo_depth int, redo_depth int")


def snapshot(versions_: DataFrame, frames: DataFrame, keys: tuple[str, ...] = ("layer_id",), frame: str = "frame_id") -> DataFrame:
    """Stacks of mask versions before a run overwrites them: ``versions_(keys, frame, version, undo, redo)``, version null where a
    frame has no readable mask. In ``frames(keys, frame)`` that have one, it goes on the undo stack and the redo stack is cleared."""
    on = versions_.join(frames.select(*keys, frame).distinct().withColumn("_own", F.lit(True)), [*keys, frame], "left")
    hit = F.col("_own").isNotNull() & F.col("version").isNotNull()
    undo = F.coalesce("undo", F.array().cast("array<bigint>"))
    none = F.array().cast("array<bigint>")
    return on.withColumns({"undo": F.when(hit, F.array_append(undo, F.col("version").cast("long"))).otherwise(undo), "redo": F.when(hit, none).otherwise(F.coalesce("redo", none))}).select(*versions_.columns)


def last_guideline(timeline: DataFrame, key: str = "layer_id", frame: str = "frame_id", value: str = "strokes") -> DataFrame:
    """Adds pasted: the latest non-null value at or before each frame of the layer."""
    w = Window.partitionBy(key).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    return timeline.withColumn("pasted", F.last(value, ignorenulls=True).over(w))


# --- points of interest ---


def summary(df: DataFrame, frame: str = "Frame", track: str = "track") -> DataFrame:
    return df.agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(track)).alias("n_tracks"))


def in_range(df: DataFrame, track, first: int, last: int, key: str = "track", frame: str = "Frame") -> DataFrame:
    return df.where((F.col(key) == track) & F.col(frame).between(first, last))


def axis_ranges(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Extents of both axes, at least 1e-9."""
    return df.groupBy(*keys).agg(F.greatest(F.max(x) - F.min(x), F.lit(1e-9)).alias("range_x"), F.greatest(F.max(y) - F.min(y), F.lit(1e-9)).alias("range_y"))


def nearest_points(df: DataFrame, clicks: DataFrame, x: str = "Frame", y: str = "Longitudinal", key: str = "track") -> DataFrame:
    """For each click (key, click, cx, cy) the row of least distance after scaling by the axes' extents; the first by x of equals."""
    on = df.join(axis_ranges(df, x, y, [key]), key).join(clicks, key)
    dx, dy = (F.col(x) - F.col("cx")) / F.col("range_x"), (F.col(y) - F.col("cy")) / F.col("range_y")
    best = F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col(x).alias("_x"), F.struct(*df.columns).alias("_row"))).alias("b")
    return on.groupBy(key, "click").agg(best).select(key, "click", "b.d2", *[F.col(f"b._row.{c}").alias(c) for c in df.columns if c != key])


def session(events: DataFrame, keys: tuple[str, ...] = ("session",), seq: str = "seq") -> DataFrame:
    """Folds add, undo and clear: the adds that stand at the end, with all their columns.

    An add stands when no clear follows it and no later undo takes it back: an undo takes the latest add that still stands.
    Counted backwards from the end, undos so far exceed or meet the adds that they take.
    """
    back = Window.partitionBy(*keys).orderBy(F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_back = Window.partitionBy(*keys).orderBy(F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = events.withColumn("_cleared", F.coalesce(F.max((F.col("op") == "clear").cast("int")).over(back), F.lit(0)))
    df = df.where("_cleared = 0 and op <> 'clear'")
    # level before an event counted backwards: undos minus adds; an add is taken when an undo is open
    move = F.when(F.col("op") == "undo", 1).otherwise(-1)
    df = df.withColumn("_run", F.sum(move).over(all_back)).withColumn("_prev", F.coalesce(F.sum(move).over(back), F.lit(0)))
    df = df.withColumn("_low", F.least(F.lit(0), F.coalesce(F.min("_run").over(back), F.lit(0))))
    return df.where((F.col("op") == "add") & (F.col("_prev") - F.col("_low") <= 0)).drop("_cleared", "_run", "_prev", "_low")


def collected(*parts: tuple[DataFrame, str]) -> DataFrame:
    """All rows of several exports, each with its source_file."""
    out = None
    for df, name in parts:
        own = df.withColumn("source_file", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def inversion(paths: DataFrame, chosen: DataFrame) -> DataFrame:
    """``paths(path)`` with invert: as chosen(path, invert), else true."""
    return paths.join(chosen.select("path", F.col("invert").alias("_i")), "path", "left").select("path", F.coalesce("_i", F.lit(True)).alias("invert"))
