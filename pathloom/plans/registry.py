"""Named queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.plans import q_conformal, q_files, q_motion, q_pixels, q_sequences, q_shapes, q_trajectory

_ALL = {**q_sequences.QUERIES, **q_pixels.QUERIES, **q_trajectory.QUERIES, **q_conformal.QUERIES, **q_files.QUERIES, **q_shapes.QUERIES, **q_motion.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ALL["traj_full"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for name, q in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for name, q in _ALL.items() if q[1]}
