"""Cells, space-filling order, image places and blend weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]


def cell(x: Column, y: Column, r: float) -> tuple[Column, Column]:
    return F.floor(x / r).cast("bigint"), F.floor(y / r).cast("bigint")


def cell_key(x: Column, y: Column, r: float) -> Column:
    """One 64-bit key of a grid cell: the column in the upper half, the row's lower 32 bits below."""
    cx, cy = cell(x, y, r)
    return F.shiftleft(cx, 32).bitwiseOR(cy.bitwiseAND(F.lit(0xFFFFFFFF)))


def hilbert(x: Column, y: Column, order: int) -> Column:
    """Place of a cell on the Hilbert curve over 2^order by 2^order cells."""
    side = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(acc: Column, k: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("bigint"), (acc["y"].bitwiseAND(s) > 0).cast("bigint")
        d = acc["d"] + s * s * ((3 * rx).bitwiseXOR(ry))
        flip = (ry == 0) & (rx == 1)
        top = F.lit(2**order - 1).cast("bigint")
        fx, fy = F.when(flip, top - acc["x"]).otherwise(acc["x"]), F.when(flip, top - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0)), side, step, lambda acc: acc["d"])


def image_place(px: Vec, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """(radius in 0..1, nx and ny in -1..1) of a pixel; 0 for an image without size."""
    ok = (width > 0) & (height > 0)
    dx, dy = (px[0] - width / 2) / (width / 2), (px[1] - height / 2) / (height / 2)
    clamp = lambda c, lo: F.greatest(F.least(c, F.lit(1.0)), F.lit(lo))
    radius = clamp(F.sqrt(dx * dx + dy * dy) / F.sqrt(F.lit(2.0)), 0.0)
    return tuple(F.when(ok, c).otherwise(F.lit(0.0)) for c in (radius, clamp(dx, -1.0), clamp(dy, -1.0)))


def blend_weight(px: Vec, width: Column, height: Column, distance: Column) -> Column:
    """Less at the image's edge, away from its middle and from its camera."""
    edge = F.least(px[0], px[1], width - px[0], height - px[1]) / (width / 2)
    radius = image_place(px, width, height)[0]
    return F.greatest(F.least(edge, F.lit(1.0)), F.lit(1e-3)) * (1 - 0.5 * F.least(radius, F.lit(1.0))) / (1 + distance * distance)


def boundary_falloff(distance: Column, reach: float = 64.0) -> Column:
    """Weight of the lower layers at a distance from a seam."""
    return 2 / (1 + F.exp(F.log(F.lit(99.0)) / reach * distance))


def view_angle(down: Vec, to_point: Vec) -> Column:
    from terraloom.functions.camera import unit
    from terraloom.functions.geom import dot

    return F.acos(F.greatest(F.least(dot(down, unit(to_point)), F.lit(1.0)), F.lit(-1.0)))
