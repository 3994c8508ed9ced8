"""Queries of the iterative operators over the test tables. Their results have no SQL; tests hold them against known scenes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import camera
from terraloom.operators import clusters, colour, matching, mesh, ordering, raster, robust, solve
from terraloom.plans.reference import features, images, links, positions, solved
from terraloom.runtime import materialise, spread

_MODEL = ["focal", "ppx", "ppy", "k1", "k2", "k3", "t1", "t2"]


def _bearings(spark: SparkSession, d: str) -> DataFrame:
    """Matches of links as pairs of unit rays with their descriptor distance."""
    m = materialise(matching.ratio_match(links(spark, d), features(spark, d, "descriptor"), 1.0).join(links(spark, d), "edge_id"))
    model = images(spark, d, "model_id").join(_models(spark, d), "model_id")
    f = matching.matched(features(spark, d, "x", "y"), m).join(model, "node_id")
    f = f.select("node_id", "idx", camera.forward_ray((F.col("x"), F.col("y")), {n: F.col(n) for n in _MODEL}).alias("ray"))
    one = f.select(F.col("node_id").alias("src"), F.col("idx").alias("idx1"), F.col("ray").alias("a"))
    two = f.select(F.col("node_id").alias("dst"), F.col("idx").alias("idx2"), F.col("ray").alias("b"))
    return m.join(one, ["src", "idx1"]).join(two, ["dst", "idx2"]).select("edge_id", "a", "b", F.col("distance").alias("quality"))


def _models(spark: SparkSession, d: str) -> DataFrame:
    from terraloom.runtime import read

    return read(spark, d, "camera_models").select("model_id", *(c.alias(n) for n, c in camera.model_columns().items()))


def ransac_links(spark: SparkSession, d: str) -> DataFrame:
    """Homography of each link with matched features."""
    return robust.ransac(_bearings(spark, d), "edge_id", robust.Homography())


def ransac_fundamental(spark: SparkSession, d: str) -> DataFrame:
    return robust.ransac(_bearings(spark, d), "edge_id", robust.Fundamental())


def ransac_essential(spark: SparkSession, d: str) -> DataFrame:
    return robust.ransac(_bearings(spark, d), "edge_id", robust.Essential())


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.kmeans(positions(spark, d), "node_id", ["x", "y"], 6, balanced=True)


def spectral_groups(spark: SparkSession, d: str) -> DataFrame:
    """Images of each batch cut into groups along its links."""

    def run(pdf: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        edges = _edges(pdf["node_id"], e)
        k = clusters.group_count(len(pdf) * 2, False)
        g = clusters.spectral_groups(len(pdf), edges, np.ones(len(edges)), k, pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"node_id": pdf["node_id"], "batch": pdf["batch"], "cluster": g})

    return spread(positions(spark, d), "batch").groupBy("batch").cogroup(spread(_batch_links(spark, d), "batch").groupBy("batch")).applyInPandas(run, "node_id bigint, batch int, cluster int")


def refine_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Mesh over each batch's images, refined until it is crowded nowhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, x1, y0, y1 = pdf["x"].min() - 20, pdf["x"].max() + 20, pdf["y"].min() - 20, pdf["y"].max() + 20
        z = pdf["z"].mean()
        m = mesh.PointMesh(np.array([[x0, y0, z], [x1, y0, z], [x0, y1, z], [x1, y1, z]]), np.array([[0, 1, 3], [0, 3, 2]]), pdf[["x", "y", "z"]].to_numpy(float))
        m.refine_crowded()
        n, e = m.tables()
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "vertices": [len(n)], "edges": [len(e)], "triangles": [len(m.triangles)], "conforming": [m.conforming()]})

    return spread(positions(spark, d), "batch").groupBy("batch").applyInPandas(run, "batch int, vertices int, edges int, triangles int, conforming boolean")


def _batch_links(spark: SparkSession, d: str) -> DataFrame:
    """(batch, src, dst) of links, by the batch of their first image."""
    ends = images(spark, d, "batch").select(F.col("node_id").alias("src"), "batch")
    return links(spark, d).join(ends, "src").select("batch", "src", "dst").distinct()


def _edges(ids, e: pd.DataFrame) -> np.ndarray:
    """Links between ``ids`` as pairs of their places."""
    at = {n: k for k, n in enumerate(ids)}
    return np.array(sorted({(at[a], at[b]) for a, b in zip(e["src"], e["dst"]) if a in at and b in at and a != b}), int).reshape(-1, 2)


GROUP, LEAST_GROUP = 12, 3  # images that are solved at once
LEAST_SEEN = 2  # ground points that fix an image's three angles


def turned_and_solved(g: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
    """(node_id, batch, error_before, error_after) of one batch's images. An image sees the ground below the images of its group and below
    those it is linked with, in whichever group; without enough of it in front of the lens the errors are null."""
    pos, rot = g[["x", "y", "z"]].to_numpy(float), solve.matrix(g[["qx", "qy", "qz", "qw"]].to_numpy(float))
    pts = np.column_stack([pos[:, :2], np.zeros(len(g))])
    linked: dict[int, set[int]] = {}
    for i, j in edges:
        linked.setdefault(int(i), set()).add(int(j))
        linked.setdefault(int(j), set()).add(int(i))
    before, after = np.full(len(g), np.nan), np.full(len(g), np.nan)
    planar = (g["projection"] == "PLANAR").to_numpy() & np.isfinite(pos).all(1) & np.isfinite(rot).all((1, 2))
    angle = lambda a, b: np.arccos(np.clip((np.trace(np.transpose(a, (0, 2, 1)) @ b, axis1=1, axis2=2) - 1) / 2, -1, 1))
    for group in clusters.link_groups(len(g), edges, GROUP, LEAST_GROUP):
        by_model: dict[int, list[int]] = {}
        for i in group[planar[group]]:
            by_model.setdefault(int(g["model_id"].iloc[i]), []).append(int(i))
        for members in by_model.values():
            m = g.iloc[members[0]]
            c = solve.Camera(float(m["focal"]), m[["ppx", "ppy"]].to_numpy(float), m[["k1", "k2", "k3"]].to_numpy(float), m[["t1", "t2"]].to_numpy(float))
            reach = solve.monotone_radius(c.radial)
            use, obs = [], []
            for i in members:
                to = np.array(sorted({*map(int, group), *linked.get(i, ())}))
                v = (pts[to] - pos[i]) @ rot[i]
                to = to[(v[:, 2] > 1) & (np.hypot(v[:, 0], v[:, 1]) < reach * v[:, 2])]
                if len(np.unique(pts[to], axis=0)) >= LEAST_SEEN:
                    obs += [(len(use), j) for j in to]
                    use.append(i)
            if not use:
                continue
            o = np.array(obs)
            pixels = c.project(np.einsum("nji,nj->ni", rot[use][o[:, 0]], pts[o[:, 1]] - pos[use][o[:, 0]]))
            start = solve.rotation(np.random.default_rng(0).normal(0, 0.01, (len(use), 3))) @ rot[use]
            _, _, found, _ = solve.bundle(c, pos[use], start, pts, o, pixels, solve.Options.ORIENTATION, iterations=8)
            before[use], after[use] = angle(start, rot[use]), angle(found, rot[use])
    return pd.DataFrame({"node_id": g["node_id"], "batch": g["batch"], "error_before": before, "error_after": after})


def bundle_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Orientation of each batch's solved images against the ground below them, as its links see it: turned off and solved back."""

    def run(pdf: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path").reset_index(drop=True)
        return turned_and_solved(pdf, _edges(pdf["node_id"], e))

    found = spread(solved(spark, d), "batch").groupBy("batch").cogroup(spread(_batch_links(spark, d), "batch").groupBy("batch")).applyInPandas(run, "node_id bigint, batch int, error_before double, error_after double")
    return found.select("node_id", "batch", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("error_before", "error_after")))


def color_balance(spark: SparkSession, d: str) -> DataFrame:
    """Radiometric parameters of images linked with each other, a batch being a block that shares no image with others. The tables hold no
    colours: lightness is what the images' ids, places in the frame and view angles make of it."""
    i = images(spark, d, "model_id", "batch")
    tone = lambda c: F.pmod(F.xxhash64(c), F.lit(40)).cast("double")
    share = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1000)) / 1000.0
    ends = {s: i.select(F.col("node_id").alias(f"cam_{s}"), F.col("model_id").alias(f"model_{s}"), "batch") for s in "ab"}
    e = links(spark, d).withColumnsRenamed({"src": "cam_a", "dst": "cam_b"}).join(ends["a"], "cam_a").join(ends["b"], ["cam_b", "batch"])
    e = e.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(9))))
    for s in "ab":
        place = share(f"cam_{s}", "edge_id", "sample")
        e = e.withColumns({f"r_{s}": place, f"theta_{s}": place * 0.5, f"nx_{s}": place * 0.7, f"ny_{s}": place * -0.7})
    z = F.lit(0.0)
    base = F.pmod(F.xxhash64("edge_id", "sample"), F.lit(50)).cast("double")
    for s in "ab":
        e = e.withColumn(f"lab_{s}", F.array(base + tone(f"cam_{s}") - 4.0 * F.col(f"r_{s}") ** 2, z, z))
    found, _ = colour.balance_groups(e, "batch")
    return found.withColumnRenamed("cam_id", "node_id")


def laplacian_blend(spark: SparkSession, d: str) -> DataFrame:
    """Feature strengths of each image as layers by sparsity, blended in tiles of 64 cells of 128 px."""
    f = features(spark, d, "x", "y", "strength", "is_sparse").filter("strength is not null and not isnan(x) and not isnan(y)")
    cx, cy = F.floor(F.col("x") / 128), F.floor(F.col("y") / 128)
    cell = f.select("node_id", F.floor(cx / 64).alias("tx"), F.floor(cy / 64).alias("ty"), F.col("is_sparse").cast("int").alias("layer"), F.pmod(cy, F.lit(64)).cast("int").alias("row"), F.pmod(cx, F.lit(64)).cast("int").alias("col"), F.col("strength").cast("double").alias("v"))
    cell = cell.filter("layer is not null").groupBy("node_id", "tx", "ty", "layer", "row", "col").agg(F.avg("v").alias("v"), F.count("*").cast("double").alias("weight"))
    return raster.blend_tiles(cell, ["node_id", "tx", "ty"], ["v"], 64)


def tile_order(spark: SparkSession, d: str) -> DataFrame:
    """Order of the tiles over all images for a cache of 40 images, from the cameras each tile needs. The order is one greedy pass over the
    tiles of a raster: their camera lists, a few for each tile, are what the driver holds."""
    from terraloom.plans.reference import tile_cameras

    rows = tile_cameras(spark, d).groupBy("tx", "ty").agg(F.collect_set("cam_id").alias("cams")).collect()
    if not rows:
        return spark.createDataFrame([], "place int, tx bigint, ty bigint, cameras int")
    x0, y0 = min(r.tx for r in rows), min(r.ty for r in rows)
    nx, ny = max(r.tx for r in rows) - x0 + 1, max(r.ty for r in rows) - y0 + 1
    need = {int(r.tx - x0 + nx * (r.ty - y0)): set(r.cams) for r in rows}
    order = ordering.cache_order(nx, ny, need, 40)
    return spark.createDataFrame([(k, t % nx + x0, t // nx + y0, len(need.get(t, ()))) for k, t in enumerate(order)], "place int, tx bigint, ty bigint, cameras int")


def queries() -> dict:
    names = (ransac_links, ransac_fundamental, ransac_essential, kmeans_clusters, spectral_groups, refine_mesh, bundle_adjust, color_balance, laplacian_blend, tile_order)
    return {f.__name__: f for f in names}
