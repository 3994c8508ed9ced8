"""Colour columns: Lab conversion and the radiometric model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ under D65, and the reference white.
_XYZ = [[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]
_RGB = [[3.240479, -1.537150, -0.498535], [-0.969256, 1.875991, 0.041556], [0.055648, -0.204043, 1.057311]]
_WHITE = [0.950456, 1.0, 1.088754]


def bgr_to_lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Lab (L 0..100) of 8-bit sRGB."""

    def linear(c: Column) -> Column:
        v = c / 255.0
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    rgb = [linear(r), linear(g), linear(b)]
    xyz = [sum((m * c for m, c in zip(row[1:], rgb[1:])), row[0] * rgb[0]) / w for row, w in zip(_XYZ, _WHITE)]
    fx, fy, fz = (F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116) for t in xyz)
    light = F.when(xyz[1] > 0.008856, 116 * F.pow(xyz[1], F.lit(1 / 3)) - 16).otherwise(903.3 * xyz[1])
    return light, 500 * (fx - fy), 200 * (fy - fz)


def lab_to_bgr(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit sRGB of Lab, clamped."""
    fy = (light + 16) / 116
    back = lambda t: F.when(t > 0.206893, t * t * t).otherwise((t - 16 / 116) / 7.787)
    xyz = [back(f) * w for f, w in zip((fy + a / 500, fy, fy - b / 200), _WHITE)]
    rgb = [sum((m * c for m, c in zip(row[1:], xyz[1:])), row[0] * xyz[0]) for row in _RGB]
    gamma = lambda v: F.when(v > 0.0031308, 1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v)
    r, g, b8 = (F.greatest(F.least(F.round(gamma(F.greatest(v, F.lit(0.0))) * 255), F.lit(255.0)), F.lit(0.0)).cast("int") for v in rgb)
    return b8, g, r


def correct(lab: tuple, offset: tuple, vignette: tuple, brdf: Column, slope: tuple, radius: Column, angle: Column, nx: Column, ny: Column) -> tuple:
    """Lab without the image's offset, its model's vignetting, reflectance and slope; L kept in 0..100, a and b in -127..127."""
    r2 = radius * radius
    gain = offset[0] + vignette[0] * r2 + vignette[1] * r2 * r2 + vignette[2] * r2 * r2 * r2 + brdf * angle * angle + slope[0] * nx + slope[1] * ny
    clamp = lambda c, lo, hi: F.greatest(F.least(c, F.lit(hi)), F.lit(lo))
    return clamp(lab[0] - gain, 0.0, 100.0), clamp(lab[1] - offset[1], -127.0, 127.0), clamp(lab[2] - offset[2], -127.0, 127.0)
