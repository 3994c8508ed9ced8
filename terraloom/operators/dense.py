"""Densify: points of the ground from features that several solved images see, guided by a mesh.

A dense feature's ray meets the mesh; the place is looked for in the nearest cameras, each of which gives at most one feature near the
predicted pixel. Connected matches are tracks, triangulated from their first two rays, gated by reprojection, and triangulated again where
the gate dropped rays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions import bits, camera, geom
from terraloom.operators.graph import components
from terraloom.operators.matching import BITS
from terraloom.operators.mesh import HIT, Walker
from terraloom.operators.neighbours import knn_join
from terraloom.operators.tracks import REPROJECTION_PX, guided_matches
from terraloom.runtime import materialise

CANDIDATES = 10
SEARCH_PX, RATIO, ALONE = 150.0, 0.85, 0.35
#: Vertices of a mesh that is sent to every task; larger surfaces are densified in parts.
MOST_VERTICES = 1_000_000
_MODEL = ["focal", "ppx", "ppy", "k1", "k2", "k3", "t1", "t2"]
_POSE = ["x", "y", "z", "qx", "qy", "qz", "qw"]


def _cols(*names: str) -> tuple[Column, ...]:
    return tuple(map(F.col, names))


def mesh_hits(rays: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rays`` (ox, oy, oz, dx, dy, dz, …) with code, hx, hy, hz: where each meets the mesh (nodes, edges as of a surface)."""
    if nodes.count() > MOST_VERTICES:
        raise ValueError(f"a mesh of more than {MOST_VERTICES} vertices is cut into parts first")
    shared = rays.sparkSession.sparkContext.broadcast((nodes.toPandas(), edges.toPandas()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = Walker(*shared.value)
        for b in batches:
            code, _, where, _ = walker.walk(b[["dx", "dy", "dz"]].to_numpy(float), b[["ox", "oy", "oz"]].to_numpy(float))
            yield b.assign(code=code, hx=where[:, 0], hy=where[:, 1], hz=where[:, 2])

    return rays.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rays.dtypes) + ", code string, hx double, hy double, hz double")


def densify(cameras: DataFrame, features: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(track, x, y, z, views) of the points found.

    ``cameras``: node_id, x … qw, w_px, h_px and the model's columns, solved. ``features``: node_id, idx, fx, fy, descriptor, those that
    aren't sparse. Images without such features are no candidates, as in the original."""
    f = features.filter("descriptor is not null and not isnan(fx) and not isnan(fy)").withColumn("id", F.concat_ws(":", "node_id", "idx"))
    c = cameras.select("node_id", *_POSE, "w_px", "h_px", *_MODEL)
    c = c.join(f.select("node_id").distinct(), "node_id", "left_semi")
    model = {n: F.col(n) for n in _MODEL}
    ray = camera.unproject_forward(_cols("fx", "fy"), model)
    rays = f.join(c, "node_id").withColumns(dict(zip(("ux", "uy", "uz"), ray)))
    turned = camera.rotate(_cols("qx", "qy", "qz", "qw"), _cols("ux", "uy", "uz"))
    rays = materialise(rays.select("id", "node_id", "fx", "fy", "descriptor", *(F.col(a).alias(f"o{a}") for a in "xyz"), *(t.alias(f"d{a}") for t, a in zip(turned, "xyz"))))
    hits = materialise(mesh_hits(rays.select("id", "node_id", "ox", "oy", "oz", "dx", "dy", "dz"), nodes, edges).filter(F.col("code") == HIT).select("id", "node_id", "hx", "hy", "hz"))
    near = knn_join(hits.select(F.col("id").alias("p"), F.col("hx").alias("px"), F.col("hy").alias("py"), F.col("hz").alias("pz")), c.select(F.col("node_id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz")), CANDIDATES + 1, axes="xyz")
    pairs = near.select(F.col("p").alias("id"), F.col("q").alias("image")).join(hits.withColumnRenamed("node_id", "own"), "id").filter("image <> own")
    at = pairs.join(c.withColumnRenamed("node_id", "image"), "image").withColumn("seen", camera.seen(_cols("hx", "hy", "hz"), _cols("x", "y", "z"), _cols("qx", "qy", "qz", "qw"), model))
    shown = at.filter("seen.px >= 0 and seen.px < w_px and seen.py >= 0 and seen.py < h_px").select("image", F.col("id").alias("p"), F.col("seen.px").alias("px"), F.col("seen.py").alias("py"))
    shown = shown.join(rays.select(F.col("id").alias("p"), F.col("descriptor").alias("dp")), "p")
    there = f.select(F.col("node_id").alias("image"), F.col("id").alias("q"), F.col("fx").alias("qx"), F.col("fy").alias("qy"), F.col("descriptor").alias("dq"))
    m = guided_matches(shown, there, bits.hamming(F.col("dp"), F.col("dq")) / F.lit(float(BITS)), SEARCH_PX, RATIO, ALONE)
    tracks = components(materialise(m.select("p", "q")), "p", "q").select(F.col("node").alias("id"), F.col("component").alias("track"))
    seen = tracks.join(rays.drop("descriptor"), "id").join(c.drop("x", "y", "z"), "node_id")
    return _points(materialise(seen), model)


def _points(seen: DataFrame, model: dict[str, Column]) -> DataFrame:
    """Points of tracks from their members (track, id, ray, pixel, pose and model)."""

    def located(rows: DataFrame) -> DataFrame:
        """``rows`` with the place their track's first two rays give and how many rays the track has; without one, none."""
        by = Window.partitionBy("track").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        names = ["ox", "oy", "oz", "dx", "dy", "dz"]
        rows = rows.withColumns({f"{n}{k}": F.nth_value(n, k).over(by) for n in names for k in (1, 2)}).withColumn("_n", F.count("*").over(by)).filter("_n >= 2")
        mid, gap = geom.ray_midpoint(_cols("dx1", "dy1", "dz1"), _cols("ox1", "oy1", "oz1"), _cols("dx2", "dy2", "dz2"), _cols("ox2", "oy2", "oz2"))
        rows = rows.withColumns({**dict(zip(("mx", "my", "mz"), mid)), "gap": gap}).filter("gap >= 0 and not isnan(gap) and not isnan(mx) and not isnan(my) and not isnan(mz)")
        return rows.drop(*(f"{n}{k}" for n in names for k in (1, 2)), "gap")

    first = located(seen)
    first = first.withColumn("seen", camera.seen(_cols("mx", "my", "mz"), _cols("ox", "oy", "oz"), _cols("qx", "qy", "qz", "qw"), model))
    far = F.hypot(F.col("seen.px") - F.col("fx"), F.col("seen.py") - F.col("fy"))
    kept = first.withColumn("all", F.col("_n")).filter(far <= REPROJECTION_PX).drop("seen", "_n")
    kept = materialise(kept.withColumn("left", F.count("*").over(Window.partitionBy("track"))).filter("left >= 2"))
    point = lambda df: df.groupBy("track").agg(*(F.first(f"m{a}").alias(a) for a in "xyz"), F.count("*").alias("views"))
    return point(kept.filter(F.col("left") == F.col("all"))).unionByName(point(located(kept.filter(F.col("left") < F.col("all")).drop("mx", "my", "mz"))))
