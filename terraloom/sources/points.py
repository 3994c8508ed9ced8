"""Points as x,y,z text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(nan|inf|infinity)\s*$"


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) from lines of three numbers; empty lines and lines of fewer fields are skipped, a field that is no number fails the read."""
    parts = spark.read.text(path).filter("trim(value) <> ''").select(F.split("value", ",").alias("p")).filter(F.size("p") >= 3)
    cast = lambda k: F.when(F.lower(F.col("p")[k]).rlike(NUMBER), F.trim(F.col("p")[k]).cast("double")).otherwise(F.raise_error(F.concat(F.lit("no number: "), F.col("p")[k])))
    return parts.select(*(cast(k).alias(n) for k, n in enumerate("xyz")))


def within(points: DataFrame, bounds: dict[str, tuple[float, float]] | None) -> DataFrame:
    """Points strictly inside the bounds of each axis; bounds of no width on every axis let all through."""
    if not bounds or all(lo == hi for lo, hi in bounds.values()):
        return points
    for axis, (lo, hi) in bounds.items():
        points = points.filter((F.col(axis) > lo) & (F.col(axis) < hi))
    return points


def write_xyz(points: DataFrame, path: str, bounds: dict[str, tuple[float, float]] | None = None) -> None:
    within(points, bounds).select("x", "y", "z").write.mode("overwrite").option("header", False).csv(path)
