"""Brown-Conrady camera columns. Vectors are tuples of columns; a model is a mapping of columns focal, ppx, ppy, k1, k2, k3, t1, t2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]
LEAST_DEPTH = 1e-3


def model_columns(prefix: str = "") -> dict[str, Column]:
    """The model of a camera_models row; a missing coefficient is 0."""
    at = lambda c, k: F.coalesce(F.get(F.col(prefix + c), F.lit(k)), F.lit(0.0))
    radial = {f"k{k + 1}": at("radial", k) for k in range(3)}
    return {"focal": F.col(prefix + "focal"), "ppx": at("pp", 0), "ppy": at("pp", 1), **radial, "t1": at("tangential", 0), "t2": at("tangential", 1)}


def rotate(q: Vec, v: Vec) -> Vec:
    """Rotate ``v`` by the quaternion (x, y, z, w), which is normalised first."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    x, y, z, w = (c / n for c in q)
    a, b, c = v
    tx, ty, tz = 2 * (y * c - z * b), 2 * (z * a - x * c), 2 * (x * b - y * a)
    return a + w * tx + (y * tz - z * ty), b + w * ty + (z * tx - x * tz), c + w * tz + (x * ty - y * tx)


def inverse(q: Vec) -> Vec:
    return -q[0], -q[1], -q[2], q[3]


def distort(p: Vec, m: dict[str, Column]) -> Vec:
    """Distorted place of a projected ray."""
    x, y = p
    r2 = x * x + y * y
    s = 1 + m["k1"] * r2 + m["k2"] * r2 * r2 + m["k3"] * r2 * r2 * r2
    xy = 2 * x * y
    return s * x + xy * m["t1"] + m["t2"] * (r2 + 2 * x * x), s * y + xy * m["t2"] + m["t1"] * (r2 + 2 * y * y)


def project(v: Vec, m: dict[str, Column], planar: Column | None = None) -> Vec:
    """Pixel of a vector in camera coordinates; null for a projection that isn't planar."""
    z = F.greatest(v[2], F.lit(LEAST_DEPTH))
    dx, dy = distort((v[0] / z, v[1] / z), m)
    px, py = dx * m["focal"] + m["ppx"], dy * m["focal"] + m["ppy"]
    return (px, py) if planar is None else (F.when(planar, px), F.when(planar, py))


def to_camera(point: Vec, position: Vec, q: Vec) -> Vec:
    """World point to camera coordinates."""
    return rotate(inverse(q), tuple(a - b for a, b in zip(point, position)))


def unit(v: Vec) -> Vec:
    n = F.sqrt(sum((c * c for c in v[1:]), v[0] * v[0]))
    return tuple(c / n for c in v)


def unproject_inverse(px: Vec, m: dict[str, Column]) -> Vec:
    """Unit ray of a pixel, for a model whose distortion is applied from pixel to ray."""
    d = distort(((px[0] - m["ppx"]) / m["focal"], (px[1] - m["ppy"]) / m["focal"]), m)
    return unit((*d, F.lit(1.0)))


def _undistort(tx: Column, ty: Column, m: dict[str, Column], rounds: int) -> Column:
    """Array (x, y) whose distorted place is (tx, ty): ``rounds`` Newton steps, kept as one array expression."""

    def step(p: Column, _: Column) -> Column:
        x, y = p[0], p[1]
        r2 = x * x + y * y
        s = 1 + m["k1"] * r2 + m["k2"] * r2 * r2 + m["k3"] * r2 * r2 * r2
        grow = m["k1"] + 2 * m["k2"] * r2 + 3 * m["k3"] * r2 * r2
        dx, dy = distort((x, y), m)
        a, d = s + 2 * x * x * grow + 2 * y * m["t1"] + 6 * x * m["t2"], s + 2 * y * y * grow + 2 * x * m["t2"] + 6 * y * m["t1"]
        b = 2 * x * y * grow + 2 * x * m["t1"] + 2 * y * m["t2"]
        det = a * d - b * b
        ex, ey = dx - tx, dy - ty
        return F.when(F.abs(det) > 1e-9, F.array(x - (d * ex - b * ey) / det, y - (a * ey - b * ex) / det)).otherwise(p)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(tx, ty), step)


def forward_ray(px: Vec, m: dict[str, Column], rounds: int = 10) -> Column:
    """Unit ray of a pixel for a forward model, as an array. The Newton steps are bound once; as columns each mention would take them again."""
    p = _undistort((px[0] - m["ppx"]) / m["focal"], (px[1] - m["ppy"]) / m["focal"], m, rounds)
    return F.transform(F.array(p), lambda v: F.array(*unit((v[0], v[1], F.lit(1.0)))))[0]


def unproject_forward(px: Vec, m: dict[str, Column], rounds: int = 10) -> Vec:
    """Unit ray of a pixel for a forward model."""
    p = _undistort((px[0] - m["ppx"]) / m["focal"], (px[1] - m["ppy"]) / m["focal"], m, rounds)
    return unit((p[0], p[1], F.lit(1.0)))


def project_inverse(v: Vec, m: dict[str, Column], rounds: int = 10) -> Vec:
    """Pixel of a vector in camera coordinates for a model whose distortion is applied from pixel to ray."""
    z = F.greatest(v[2], F.lit(LEAST_DEPTH))
    p = _undistort(v[0] / z, v[1] / z, m, rounds)
    return p[0] * m["focal"] + m["ppx"], p[1] * m["focal"] + m["ppy"]


def seen(point: Vec, position: Vec, q: Vec, m: dict[str, Column]) -> Column:
    """Struct (px, py, depth) of a world point in a camera. The camera coordinates are bound once, so that the expression stays small."""
    fields = {n: c.alias(n) for n, c in m.items()}
    start = F.struct(*(c.alias(n) for n, c in zip("abcdefg", (*(x - y for x, y in zip(point, position)), *q))), *fields.values())

    def turned(s: Column) -> Column:
        v = rotate(inverse(tuple(s[n] for n in "defg")), tuple(s[n] for n in "abc"))
        return F.struct(*(c.alias(n) for n, c in zip("abc", v)), *(s[n].alias(n) for n in fields))

    def placed(s: Column) -> Column:
        px, py = project(tuple(s[n] for n in "abc"), {n: s[n] for n in fields})
        return F.struct(px.alias("px"), py.alias("py"), s["c"].alias("depth"))

    return F.transform(F.transform(F.array(start), turned), placed)[0]
