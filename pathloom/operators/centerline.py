"""Centrelines between two walls: mean of both boundaries, a straight fit with harmonics of its residual, and ends extended.

The fit's bases depend on the place along the line only, so each frame needs one row of sums; the small normal equations are
solved once, on the driver, as constants.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.operators.sequences import interpolate_index, mean_spacing, resample_open

KEYS = ("frame_id",)
LEAST = 15


def _bases(n: int, harmonics: int) -> tuple[np.ndarray, np.ndarray]:
    """t, and the columns 1, sin, cos, ... at each of n places."""
    t = np.linspace(0, 1, n)
    return t, np.stack([np.ones(n)] + [f(2 * math.pi * h * t) for h in range(1, harmonics + 1) for f in (np.sin, np.cos)])


def _solution(n: int, harmonics: int) -> np.ndarray:
    """The constant matrix from the sums of c, c * t, c * sin, c * cos, ... to intercept, slope and the harmonics' coefficients.

    The straight line is fitted first and the bases (with their constant) to what it leaves.
    """
    t, b = _bases(n, harmonics)
    line = np.stack([np.ones(n), t])
    k = len(b) + 1
    straight = np.zeros((2, k))
    straight[:, :2] = np.linalg.inv(line @ line.T)
    own = np.zeros((len(b), k))
    own[0, 0] = 1
    own[1:, 2:] = np.eye(len(b) - 1)
    return np.concatenate([straight, np.linalg.inv(b @ b.T) @ (own - (b @ line.T) @ straight)])


def _columns(n: int, harmonics: int) -> list[Column]:
    t = F.col("i") / float(n - 1)
    return [F.lit(1.0), t] + [f(2 * math.pi * h * t) for h in range(1, harmonics + 1) for f in (F.sin, F.cos)]


def fit_coefficients(points: DataFrame, n: int, harmonics: int = 3, keys=KEYS) -> DataFrame:
    """``points(keys, i, x, y)`` of n places -> for x and y: intercept, slope and the harmonics' coefficients, as arrays cx and cy."""
    m = _solution(n, harmonics)
    sums = points.groupBy(*keys).agg(*[F.sum(F.col(c) * w).alias(f"_{c}{k}") for c in "xy" for k, w in enumerate(_columns(n, harmonics))])
    dot = lambda c, row: reduce(add, (F.col(f"_{c}{k}") * float(v) for k, v in enumerate(row)))
    return sums.select(*keys, *[F.array(*[dot(c, row) for row in m]).alias(f"c{c}") for c in "xy"])


def fitted(points: DataFrame, n: int, harmonics: int = 3, keys=KEYS) -> DataFrame:
    """The fitted curve at each of the n places."""
    line, t, *waves = _columns(n, harmonics)
    terms = [line, t, line, *waves]
    at = lambda c: reduce(add, (F.get(c, F.lit(k)) * w for k, w in enumerate(terms)))
    return points.select(*keys, "i").join(fit_coefficients(points, n, harmonics, keys), list(keys)).select(*keys, "i", at("cx").alias("x"), at("cy").alias("y"))


def extended(curve: DataFrame, ends: DataFrame, n: int, more: int = 10, slope: int = 20, keys=KEYS) -> DataFrame:
    """The curve with ``more`` points before its first and after its last node where it doesn't reach ends(keys, x_first, x_last).

    They lie on the slope of nodes 0 and ``slope`` (of the last and the ``slope``-th from the end); without a difference in x nothing is added.
    """
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    marks = {"a": 0, "b": min(slope, n - 1), "c": n - 1, "d": max(n - slope, 0)}
    m = curve.groupBy(*keys).agg(*[pick(i, c).alias(f"{k}{c}") for k, i in marks.items() for c in "xy"]).join(ends, list(keys))
    k = F.explode(F.sequence(F.lit(0), F.lit(more - 1)))
    head = m.where("ax > x_first and bx <> ax").select("*", k.alias("k"))
    hx = F.col("x_first") + (F.col("ax") - F.col("x_first")) * (F.col("k") / float(more))
    head = head.select(*keys, (F.col("k") - more).cast("long").alias("i"), hx.alias("x"), (F.col("ay") + (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")) * (hx - F.col("ax"))).alias("y"))
    tail = m.where("cx < x_last and cx <> dx").select("*", k.alias("k"))
    tx = F.col("cx") + (F.col("x_last") - F.col("cx")) * ((F.col("k") + 1) / float(more))
    tail = tail.select(*keys, (F.col("k") + n).cast("long").alias("i"), tx.alias("x"), (F.col("cy") + (F.col("cy") - F.col("dy")) / (F.col("cx") - F.col("dx")) * (tx - F.col("cx"))).alias("y"))
    return curve.select(*keys, F.col("i").cast("long").alias("i"), "x", "y").unionByName(head).unionByName(tail)


def mean_curve(upper: DataFrame, lower: DataFrame, n: int, keys=KEYS, order: str = "x") -> DataFrame:
    """Both boundaries at n evenly spaced indexes, averaged; frames where either has fewer than LEAST points drop out."""
    parts = []
    for df in (upper, lower):
        w = Window.partitionBy(*keys)
        own = df.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= LEAST)
        own = own.select(*keys, F.col(order).alias("node_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        parts.append(interpolate_index(own, n, keys, "node_id"))
    u, lo = parts
    return u.join(lo.select(*keys, "i", F.col("x").alias("_x"), F.col("y").alias("_y")), [*keys, "i"]).select(*keys, "i", ((F.col("x") + F.col("_x")) / 2.0).alias("x"), ((F.col("y") + F.col("_y")) / 2.0).alias("y"))


def centerline(upper: DataFrame, lower: DataFrame, n: int = 2000, harmonics: int = 3, width: int | None = None, height: int | None = None, keys=KEYS) -> DataFrame:
    """Boundaries (keys, x, y) -> skeleton (keys, node_id, x_pixel, y_pixel, node_spacing): n nodes evenly along the fitted, extended curve.

    Coordinates are clipped to the frame (where its size is given) and rounded to 4 decimals; the spacing is that before clipping, with 6.
    """
    mean = mean_curve(upper, lower, n, keys)
    both = upper.select(*keys, "x").union(lower.select(*keys, "x")).groupBy(*keys).agg(F.min("x").cast("double").alias("x_first"), F.max("x").cast("double").alias("x_last"))
    whole = extended(fitted(mean, n, harmonics, keys), both, n, keys=keys).withColumnRenamed("i", "node_id")
    line = resample_open(whole, n, keys).withColumnRenamed("i", "node_id")
    spacing = mean_spacing(line, keys)
    clip = lambda c, size: F.col(c) if size is None else F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(size - 1)))
    return line.join(spacing, list(keys)).select(*keys, F.col("node_id").cast("long").alias("node_id"), F.round(clip("x", width), 4).alias("x_pixel"), F.round(clip("y", height), 4).alias("y_pixel"), F.round("spacing", 6).alias("node_spacing"))
