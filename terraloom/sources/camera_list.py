"""The camera list as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
_CAMERA = "struct<make: string, model: string, lens_model: string, sensor_width_px: int, sensor_height_px: int, radial_distortion: array<double>, tangential_distortion: array<double>, principal_point_offset: array<double>, focal_length_pixels: double, notes: string>"


def read_camera_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows of camera_db from ``{version, cameras}``; a file of another version or shape gives none, missing fields get their defaults."""
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", f"version int, cameras array<{_CAMERA}>").alias("d")).filter(F.col("d.version") == VERSION)
    c = doc.select(F.posexplode("d.cameras").alias("at", "c"))
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    return c.select(
        (F.col("at") + 1).alias("ord"), F.coalesce("c.make", F.lit("")).alias("make"), F.coalesce("c.model", F.lit("")).alias("model"), F.coalesce("c.lens_model", F.lit("")).alias("lens_model"),
        F.coalesce("c.sensor_width_px", F.lit(0)).alias("sensor_width_px"), F.coalesce("c.sensor_height_px", F.lit(0)).alias("sensor_height_px"),
        F.coalesce("c.radial_distortion", zeros(3)).alias("radial"), F.coalesce("c.tangential_distortion", zeros(2)).alias("tangential"), F.coalesce("c.principal_point_offset", zeros(2)).alias("pp_offset"),
        F.col("c.focal_length_pixels").alias("focal"), F.col("c.notes").alias("notes"),
    )


def camera_list_text(db: DataFrame) -> DataFrame:
    """(value): the list as one JSON text, in the order of ``ord``. The list is a small reference table."""
    names = {"radial": "radial_distortion", "tangential": "tangential_distortion", "pp_offset": "principal_point_offset", "focal": "focal_length_pixels"}
    fields = ["make", "model", "lens_model", "sensor_width_px", "sensor_height_px", "radial", "tangential", "pp_offset", "focal", "notes"]
    row = F.struct("ord", F.struct(*(F.col(c).alias(names.get(c, c)) for c in fields)).alias("c"))
    cameras = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["c"])
    return db.agg(F.to_json(F.struct(F.lit(VERSION).alias("version"), cameras.alias("cameras"))).alias("value"))
