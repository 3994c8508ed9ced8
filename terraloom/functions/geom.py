"""Rays, planes and triangles as column expressions; vectors are tuples of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]
PARALLEL = 1e-9


def dot(a: Vec, b: Vec) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def ray_midpoint(d1: Vec, o1: Vec, d2: Vec, o2: Vec) -> tuple[Vec, Column]:
    """Middle of the closest points of two rays, and their squared gap: negative if either lies behind, null for parallel rays."""
    w = sub(o1, o2)
    a, b, c, d, e = dot(d1, d1), dot(d1, d2), dot(d2, d2), dot(d1, w), dot(d2, w)
    den = a * c - b * b
    ok = F.abs(den) > PARALLEL
    s, t = (b * e - c * d) / den, (a * e - b * d) / den
    p1, p2 = tuple(o + s * x for o, x in zip(o1, d1)), tuple(o + t * x for o, x in zip(o2, d2))
    gap = sub(p1, p2)
    sign = F.when((s < 0) | (t < 0), F.lit(-1.0)).otherwise(F.lit(1.0))
    return tuple(F.when(ok, (x + y) / 2) for x, y in zip(p1, p2)), F.when(ok, sign * dot(gap, gap))


def plane(a: Vec, b: Vec, c: Vec) -> Vec:
    """Normal of the plane through three corners."""
    return cross(sub(b, a), sub(c, a))


def ray_plane(d: Vec, o: Vec, normal: Vec, on: Vec) -> Vec:
    """Where a ray meets a plane; null if it runs along it."""
    n = dot(normal, d)
    t = dot(normal, sub(on, o)) / n
    return tuple(F.when(F.abs(n) >= PARALLEL, x + t * y) for x, y in zip(o, d))


def turn(a: Vec, b: Vec, c: Vec) -> Column:
    """Cross product in the plane of ab and ac: negative where a, b, c run clockwise."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def clockwise(a: Vec, b: Vec, c: Vec) -> Column:
    return turn(a, b, c) < 0


def in_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Point in a triangle of the plane, boundary included."""
    s = [turn(a, b, p), turn(b, c, p), turn(c, a, p)]
    return ~(((s[0] < 0) | (s[1] < 0) | (s[2] < 0)) & ((s[0] > 0) | (s[1] > 0) | (s[2] > 0)))


def same_side(p: Vec, q: Vec, a: Vec, b: Vec) -> Column:
    """Two points of space on the same side of the edge ab, seen in the triangle's plane."""
    e = sub(b, a)
    return dot(cross(e, sub(p, a)), cross(e, sub(q, a))) >= 0


def in_triangle_3d(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    return same_side(p, a, b, c) & same_side(p, b, c, a) & same_side(p, c, a, b)


def ray_triangle(d: Vec, o: Vec, a: Vec, b: Vec, c: Vec) -> Vec:
    """Where a ray meets a triangle; null if it doesn't."""
    at = ray_plane(d, o, plane(a, b, c), a)
    inside = in_triangle_3d(at, a, b, c)
    return tuple(F.when(inside, x) for x in at)


def angle(a: Vec, b: Vec) -> Column:
    """Angle of unit vectors; the dot product is kept off plus and minus one."""
    edge = 1 - 1e-12
    return F.acos(F.greatest(F.least(dot(a, b), F.lit(edge)), F.lit(-edge)))
