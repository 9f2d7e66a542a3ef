"""The canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # type: ignore[return-value]


POINTS = "array<struct<x:double,y:double>>"
FRAMES = "video_id string, frame_id int, height int, width int, dtype string, data binary"
MASKS = "video_id string, layer_id string, frame_id int, height int, width int, data binary"
PIXELS = "frame_id int, x int, y int, v int"
STROKES = f"layer_id string, frame_id int, seq int, type string, edge_mode string, pts {POINTS}"
TIMELINE = f"layer_id string, frame_id int, strokes array<struct<type:string,edge_mode:string,pts:{POINTS}>>"
SKELETON = "frame_id int, node_id int, x_pixel double, y_pixel double, node_spacing double"
TRAJECTORY = "Frame int, Longitudinal_From_Special double, Transverse_Dist double, Special_Node_X double, Special_Node_Y double"
POI = "source_csv string, row_index int, Trajectory_ID int, Frame int, Longitudinal_From_Special double, Transverse_Dist double, Special_Node_X double, Special_Node_Y double, label string"

#: Edge modes of a layer, and the least number of points that each needs.
MODES = {"upper_left": 2, "lower_right": 2, "hole_fill": 3, "hole_crop": 3, "object": 3}


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Raises ValueError naming the missing and the available columns; drops rows that are null in any needed one."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df.dropna(subset=needed)
