"""Scalar functions of file names and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of image files, whatever their case.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")


def frame_number(name: Column) -> Column:
    """The first run of digits as a number; null without one, or where it exceeds a long."""
    return F.nullif(F.regexp_extract(name, "([0-9]+)", 1), F.lit("")).try_cast("long")


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_image(name: Column, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, ignore_case: bool = True) -> Column:
    return name.rlike(f"{'(?i)' if ignore_case else ''}\\.({'|'.join(extensions)})$")


def seconds(frame: Column, fps: float) -> Column:
    return frame / F.lit(float(fps))
