"""Raster blending and ground rasters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import camera
from terraloom.operators.neighbours import knn_join

LEVELS = 4


def distance_transform(inside: np.ndarray) -> np.ndarray:
    """Distance of each cell to the nearest cell outside, by the two-pass 3 x 3 chamfer; infinite where there is none."""
    near, across = 0.955, 1.3693  # fixed values of the 3 x 3 chamfer
    d = np.pad(np.where(inside, np.inf, 0.0), 1, constant_values=np.inf)
    h, w = d.shape
    for rows, cols, s in ((range(1, h - 1), range(1, w - 1), -1), (range(h - 2, 0, -1), range(w - 2, 0, -1), 1)):
        for r in rows:
            for c in cols:
                d[r, c] = min(d[r, c], d[r + s, c] + near, d[r, c + s] + near, d[r + s, c - 1] + across, d[r + s, c + 1] + across)
    return d[1:-1, 1:-1]


def _down(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, [(0, a.shape[0] % 2), (0, a.shape[1] % 2)] + [(0, 0)] * (a.ndim - 2), mode="edge")
    return (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) / 4


def _up(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.repeat(np.repeat(a, 2, 0), 2, 1)[: shape[0], : shape[1]]


def fill(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Pull-push: holes get the mean of what lies around them at the finest scale that has any."""
    if valid.all() or not valid.any():
        return np.where(valid[..., None], values, 0.0)
    w = valid.astype(float)
    pyramid = [(values * w[..., None], w)]
    while min(pyramid[-1][1].shape) > 1 and (pyramid[-1][1] == 0).any():
        v, x = pyramid[-1]
        pyramid.append((_down(v), _down(x)))
    full = pyramid[-1][0] / np.maximum(pyramid[-1][1], 1e-12)[..., None]
    for v, x in reversed(pyramid[:-1]):
        full = np.where((x > 0)[..., None], v / np.maximum(x, 1e-12)[..., None], _up(full, x.shape))
    return full


def laplacian_blend(layers: np.ndarray, weights: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Blend layers (k, rows, cols, channels) by weights (k, rows, cols; 0 = no value), detail by detail: at each level of the pyramids the
    weights are made to sum to one. Cells without any weight give NaN."""
    any_weight = weights.sum(0) > 0
    total = np.maximum(weights.sum(0), 1e-12)
    levels = max(1, min(levels, int(np.log2(max(2, min(layers.shape[1:3]))))))
    out: list[np.ndarray] = []
    for k in range(len(layers)):
        g, w = fill(np.nan_to_num(layers[k]), weights[k] > 0), weights[k] / total
        for level in range(levels):
            last = level == levels - 1
            small = _down(g) if not last else None
            detail = g if last else g - _up(small, g.shape[:2])
            if len(out) <= level:
                out.append([np.zeros_like(detail), np.zeros(w.shape)])
            out[level][0] += detail * w[..., None]
            out[level][1] += w
            if not last:
                g, w = small, _down(w)
    blended = None
    for detail, w in reversed(out):
        d = detail / np.maximum(w, 1e-12)[..., None]
        blended = d if blended is None else d + _up(blended, d.shape[:2])
    return np.where(any_weight[..., None], blended, np.nan)


def blend_tiles(pixels: DataFrame, tile: list[str], channels: list[str], size: int) -> DataFrame:
    """(tile, row, col, channels) from layer pixels (tile, layer, row, col, channels, weight); one task holds a tile, whose size is fixed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["layer"].max()) + 1
        values, weights = np.zeros((n, size, size, len(channels))), np.zeros((n, size, size))
        at = pdf["layer"].to_numpy(int), pdf["row"].to_numpy(int), pdf["col"].to_numpy(int)
        values[at], weights[at] = pdf[channels].to_numpy(float), np.nan_to_num(pdf["weight"].to_numpy(float))
        out = laplacian_blend(values, weights)
        r, c = np.nonzero(np.isfinite(out[..., 0]))
        result = pd.DataFrame({"row": r, "col": c, **{ch: out[r, c, k] for k, ch in enumerate(channels)}})
        for t in reversed(tile):
            result.insert(0, t, pdf[t].iloc[0])
        return result

    kinds = dict(pixels.dtypes)
    ddl = ", ".join([*(f"`{t}` {kinds[t]}" for t in tile), "row int, col int", *(f"`{c}` double" for c in channels)])
    return pixels.groupBy(*tile).applyInPandas(run, ddl)


def surface_heights(pixels: DataFrame, nodes: DataFrame, origin: tuple[float, float], step: float, columns: int) -> DataFrame:
    """``pixels`` (px, py, …) with z on a regular triangle mesh whose vertices node_id = column + row * columns have heights z; cells are cut
    along the diagonal from their low corner. A pixel outside gets null."""
    i, j = F.floor((F.col("px") - origin[0]) / step), F.floor((F.col("py") - origin[1]) / step)
    p = pixels.withColumns({"_i": i, "_j": j, "_u": (F.col("px") - origin[0]) / step - i, "_v": (F.col("py") - origin[1]) / step - j})
    z = nodes.select("node_id", "z")
    for name, at in (("00", (0, 0)), ("10", (1, 0)), ("01", (0, 1)), ("11", (1, 1))):
        inside = (F.col("_i") + at[0] >= 0) & (F.col("_i") + at[0] < columns) & (F.col("_j") + at[1] >= 0)
        p = p.withColumn("_n", F.when(inside, F.col("_i") + at[0] + (F.col("_j") + at[1]) * columns))
        p = p.join(z.select(F.col("node_id").alias("_n"), F.col("z").alias(f"_z{name}")), "_n", "left").drop("_n")
    u, v = F.col("_u"), F.col("_v")
    lower = F.col("_z00") + u * (F.col("_z10") - F.col("_z00")) + v * (F.col("_z11") - F.col("_z10"))
    upper = F.col("_z00") + v * (F.col("_z01") - F.col("_z00")) + u * (F.col("_z11") - F.col("_z01"))
    return p.withColumn("z", F.when(u >= v, lower).otherwise(upper)).drop("_i", "_j", "_u", "_v", "_z00", "_z10", "_z01", "_z11")


def layers(pixels: DataFrame, cameras: DataFrame, count: int, nearest: int = 5) -> DataFrame:
    """(p, layer, cam_id, px, py, d2) from ground pixels (p, px, py, z): of the nearest cameras the first ``count`` whose frames show the pixel.

    ``cameras`` has node_id, x, y, z, qx, qy, qz, qw, w_px, h_px and the model's columns."""
    near = knn_join(pixels.select("p", "px", "py"), cameras.select(F.col("node_id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy")), nearest)
    ground = pixels.select("p", F.col("px").alias("gx"), F.col("py").alias("gy"), F.col("z").alias("gz"))
    c = near.join(ground, "p").join(cameras.withColumnRenamed("node_id", "q"), "q")
    cols = lambda *n: tuple(map(F.col, n))
    model = {n: F.col(n) for n in ("focal", "ppx", "ppy", "k1", "k2", "k3", "t1", "t2")}
    c = c.withColumn("seen", camera.seen(cols("gx", "gy", "gz"), cols("x", "y", "z"), cols("qx", "qy", "qz", "qw"), model))
    c = c.filter("seen.depth > 0.001 and seen.px >= 0 and seen.px < w_px and seen.py >= 0 and seen.py < h_px")
    from pyspark.sql import Window

    layer = F.row_number().over(Window.partitionBy("p").orderBy("rank")) - 1
    return c.withColumn("layer", layer).filter(F.col("layer") < count).select("p", "layer", F.col("q").alias("cam_id"), F.col("seen.px").alias("px"), F.col("seen.py").alias("py"), "d2")


GREY = 64, 128  # of the chequered ground that no camera shows


def preview(pixels: DataFrame, cameras: DataFrame, scale: float, nearest: int = 5) -> DataFrame:
    """(p, row, col, cam_id, tx, ty, grey) from ground pixels (p, row, col, px, py, z): the first of the nearest cameras whose thumbnail, of
    ``scale`` of its size, shows the pixel inside its first row and column, and where; a grey of the chequered ground where none does."""
    near = knn_join(pixels.select("p", "px", "py"), cameras.select(F.col("node_id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy")), nearest)
    ground = pixels.select("p", F.col("px").alias("gx"), F.col("py").alias("gy"), F.col("z").alias("gz"))
    c = near.join(ground, "p").join(cameras.withColumnRenamed("node_id", "q"), "q")
    cols = lambda *n: tuple(map(F.col, n))
    model = {n: F.col(n) for n in ("focal", "ppx", "ppy", "k1", "k2", "k3", "t1", "t2")}
    c = c.withColumn("seen", camera.seen(cols("gx", "gy", "gz"), cols("x", "y", "z"), cols("qx", "qy", "qz", "qw"), model)).filter("seen.depth > 0")
    at = lambda v: F.col(f"seen.{v}") * scale
    c = c.withColumns({"tx": at("px").cast("int"), "ty": at("py").cast("int")})
    c = c.filter((F.col("tx") > 0) & (F.col("tx") < F.floor(F.col("w_px") * scale)) & (F.col("ty") > 0) & (F.col("ty") < F.floor(F.col("h_px") * scale)))
    first = c.groupBy("p").agg(F.min(F.struct("rank", "q", "tx", "ty")).alias("f")).select("p", F.col("f.q").alias("cam_id"), "f.tx", "f.ty")
    grey = F.when(F.col("cam_id").isNull(), F.when((F.col("row") + F.col("col")) % 2 == 0, GREY[0]).otherwise(GREY[1]))
    return pixels.select("p", "row", "col").join(first, "p", "left").withColumn("grey", grey)


def footprint_mean(image: np.ndarray, px: np.ndarray, jacobian: np.ndarray, gsd: float, most: int = 16) -> np.ndarray:
    """Colours (n, channels) of ground cells of size ``gsd`` at pixels ``px`` (n, 2): the nearest pixel where the cell's ellipse in the image
    (``jacobian``, n x 2 x 2, pixels for each metre) is smaller than one, else the mean over the ellipse, whose radius is cut at ``most``."""
    h, w = image.shape[:2]
    out = np.full((len(px), image.shape[2]), np.nan)
    shape = gsd * gsd * np.einsum("nij,nkj->nik", jacobian, jacobian) / 4
    for k, (p, m) in enumerate(zip(px, shape)):
        x, y = np.floor(p).astype(int)
        if not (0 <= x < w and 0 <= y < h):
            continue
        axes = np.sqrt(np.maximum(np.linalg.eigvalsh(m), 0))
        if axes.max() < 1:
            out[k] = image[y, x]
            continue
        reach = int(min(most, np.ceil(axes.max())))
        ys, xs = np.mgrid[max(0, y - reach) : min(h, y + reach + 1), max(0, x - reach) : min(w, x + reach + 1)]
        d = np.stack([xs + 0.5 - p[0], ys + 0.5 - p[1]], -1)
        inside = np.einsum("abi,ij,abj->ab", d, np.linalg.inv(m + 1e-9 * np.eye(2)), d) <= 1
        out[k] = image[ys[inside], xs[inside]].mean(0) if inside.any() else image[y, x]
    return out


def cast_raster(bands: np.ndarray, kind: str) -> np.ndarray:
    """Bands in another pixel type; numbers beyond its range are cut to it, NaN becomes 0 in whole types."""
    t = np.dtype(kind)
    if t.kind == "f":
        return bands.astype(t)
    return np.clip(np.rint(np.nan_to_num(bands)), np.iinfo(t).min, np.iinfo(t).max).astype(t)


def equal_rasters(a: np.ndarray, b: np.ndarray) -> bool:
    """Same size, same type and same values, NaN equal to NaN."""
    return a.shape == b.shape and a.dtype == b.dtype and bool(np.array_equal(a, b, equal_nan=a.dtype.kind == "f"))


def reorder_bands(bands: np.ndarray, labels: list[str], wanted: list[str]) -> np.ndarray:
    """Bands in the order of ``wanted`` labels."""
    return bands[[labels.index(x) for x in wanted]]
