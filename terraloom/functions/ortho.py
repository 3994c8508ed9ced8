"""Ground resolution and raster sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_GSD = 1e-3


def pixel_arc(focal: Column, scale: Column | None = None) -> Column:
    """Angle a pixel covers at the middle of a camera without distortion; ``scale``: thumbnail rows by image rows."""
    arc = 1 / focal
    return arc if scale is None else arc / scale


def ground_resolution(cameras: DataFrame, surface_z: Column | float, scale: Column | None = None) -> DataFrame:
    """(gsd, mean_z): mean pixel arc times the cameras' mean height above the surface, not below LEAST_GSD; from (z, focal)."""
    z = surface_z if isinstance(surface_z, Column) else F.lit(float(surface_z))
    g = cameras.filter("z is not null and not isnan(z) and focal > 0").agg(F.avg(pixel_arc(F.col("focal"), scale)).alias("arc"), F.avg("z").alias("mean_z"))
    return g.select(F.greatest(F.col("arc") * F.abs(F.col("mean_z") - z), F.lit(LEAST_GSD)).alias("gsd"), "mean_z")


def clamped_resolution(gsd: float, width_m: float, height_m: float, input_pixels: float, megapixels: float = 0.0) -> float:
    """A cell size that makes no more cells than the input has pixels, nor more than ``megapixels`` million (0: no such bound)."""
    cells = width_m * height_m / gsd**2
    for most in (input_pixels, megapixels * 1e6):
        if most > 0 and cells > most:
            gsd *= (cells / most) ** 0.5
            cells = most
    return gsd


def plausible_height(z: Column) -> Column:
    """Heights above ground that a flight can have."""
    return (z > -500) & (z < 5000)


def least_triangle(fraction: float, size: Column, gsd: Column) -> Column:
    """Edge below which a triangle isn't refined."""
    return F.sqrt(F.lit(20 / 8)) * fraction * size * gsd
