"""The steps of a run over the tables: from images and features to links, orientations, surface, points, layers, colours and the mosaic.

The run's state is its tables. ``images``: one solved image a row with pose and model; ``features``; then, as stages go by, ``links`` (with
matches where they hold), ``nodes`` and ``edges`` of the surface, ``preview``, ``points``, ``layers``, ``colours`` and ``mosaic``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import camera, radiometry, spatial
from terraloom.operators import clusters, colour, dense, matching, mesh, raster, robust, solve, tables, tracks
from terraloom.operators.neighbours import knn_join
from terraloom.plans import reference
from terraloom.plans.pipeline import NEXT, REPEAT, Pipeline, Step
from terraloom.runtime import materialise, release, spread

_MODEL = ["focal", "ppx", "ppy", "k1", "k2", "k3", "t1", "t2"]
_TURN = ["qx", "qy", "qz", "qw"]


@dataclass(frozen=True)
class Settings:
    """Of a run. ``sample`` gives layer pixels (cam_id, px, py, …) their colours l, a, b; without it the run ends with uncoloured layers."""

    neighbours: int = 10
    ratio: float = 0.8
    cell: float = 25.0  # metres of the surface's cells
    pixel: float = 5.0  # metres of the mosaic's pixels
    margin: float = 25.0
    layers: int = 2
    tile: int = 64
    group: int = 50  # images that are solved at once
    settled: float = 1e-4  # radians below which orientations rest
    sample: Callable[[DataFrame], DataFrame] | None = None


def start(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables a run begins with, of the Parquet tables in ``folder``."""
    images = reference.solved(spark, folder).filter("projection = 'PLANAR'")
    return {"images": images, "features": reference.features(spark, folder, "x", "y", "strength", "descriptor", "is_sparse")}


def _rays(t: dict[str, DataFrame]) -> DataFrame:
    f = t["features"].join(t["images"].select("node_id", *_MODEL), "node_id")
    ray = camera.unproject_forward((F.col("x"), F.col("y")), {n: F.col(n) for n in _MODEL})
    return f.select("node_id", "idx", F.array(*ray).alias("ray"))


def _correspondences(t: dict[str, DataFrame], ends: DataFrame, matches: DataFrame) -> DataFrame:
    r = materialise(_rays(t))
    end = lambda k, n, c: r.select(F.col("node_id").alias(n), F.col("idx").alias(f"idx{k}"), F.col("ray").alias(c))
    return matches.join(ends, "edge_id").join(end(1, "src", "a"), ["src", "idx1"]).join(end(2, "dst", "b"), ["dst", "idx2"])


def link(s: Settings) -> Step:
    def step(p: Pipeline, run: int) -> str:
        t = p.state.tables
        i = t["images"]
        near = knn_join(i.select(F.col("node_id").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), "batch"), i.select(F.col("node_id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), "batch"), s.neighbours, ("batch", "batch"))
        ends = tables.numbered(near.filter("p <> q").select(F.col("p").alias("src"), F.col("q").alias("dst")), ["src", "dst"]).withColumnRenamed("_number", "edge_id")
        ends = materialise(ends.select("edge_id", "src", "dst"))
        with_features = t["features"].select("node_id").distinct()
        seen = ends.join(with_features.withColumnRenamed("node_id", "src"), "src", "left_semi").join(with_features.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        found = matching.ratio_match(seen, t["features"], s.ratio)
        c = _correspondences(t, ends, found).select("edge_id", "idx1", "idx2", "a", "b", F.col("distance").alias("quality"))
        held = robust.accept_links(c, "edge_id").select("edge_id", "relation", "inliers", "accepted", "matches")
        t["links"] = materialise(ends.join(held, "edge_id", "left"))
        return NEXT

    return step


def _pixels(t: dict[str, DataFrame]) -> DataFrame:
    """(batch, src, dst, x1, y1, x2, y2) of the matches that hold."""
    m = t["links"].filter("accepted").select("src", "dst", F.explode("matches").alias("m")).select("src", "dst", "m.idx1", "m.idx2")
    end = lambda k, n: t["features"].select(F.col("node_id").alias(n), F.col("idx").alias(f"idx{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    m = m.join(end(1, "src"), ["src", "idx1"]).join(end(2, "dst"), ["dst", "idx2"])
    return m.join(t["images"].select(F.col("node_id").alias("src"), "batch"), "src").select("batch", "src", "dst", "x1", "y1", "x2", "y2")


def turned(g: pd.DataFrame, m: pd.DataFrame, group: int) -> pd.DataFrame:
    """(node_id, qx … qw, moved) of a batch's images, turned so that the rays of their matches meet on a plane, in groups along the links."""
    g = g.sort_values("path").reset_index(drop=True)
    at = {n: k for k, n in enumerate(g["node_id"])}
    m = m[m["src"].isin(at) & m["dst"].isin(at)]
    pairs = np.column_stack([m["src"].map(at), m["dst"].map(at)]).astype(int).reshape(-1, 2)
    quat, moved = g[_TURN].to_numpy(float), np.zeros(len(g))
    pos, rot = g[["x", "y", "z"]].to_numpy(float), solve.matrix(quat)
    edges = np.unique(np.sort(pairs, 1), axis=0)
    for members in clusters.link_groups(len(g), edges, group, 2) if len(edges) else []:
        for _, same in g.iloc[members].groupby("model_id"):
            use = same.index.to_numpy()
            place = {int(i): k for k, i in enumerate(use)}
            inside = np.array([a in place and b in place for a, b in pairs], bool)
            if inside.sum() < 3:
                continue
            c = same.iloc[0]
            lens = solve.Camera(float(c["focal"]), c[["ppx", "ppy"]].to_numpy(float), c[["k1", "k2", "k3"]].to_numpy(float), c[["t1", "t2"]].to_numpy(float))
            own = np.array([[place[int(a)], place[int(b)]] for a, b in pairs[inside]])
            new, _ = solve.ground_plane(lens, pos[use], rot[use], own, m[["x1", "y1"]].to_numpy(float)[inside], m[["x2", "y2"]].to_numpy(float)[inside], 0.0)
            if np.isfinite(new).all():
                moved[use] = np.arccos(np.clip((np.einsum("nij,nij->n", new, rot[use]) - 1) / 2, -1, 1))
                quat[use] = solve.quaternion(new)
    return pd.DataFrame({"node_id": g["node_id"], **{n: quat[:, k] for k, n in enumerate(_TURN)}, "moved": moved})


def relax(s: Settings) -> Step:
    def step(p: Pipeline, run: int) -> str:
        t = p.state.tables
        i = t["images"]
        used = ["node_id", "batch", "path", "model_id", "x", "y", "z", *_TURN, *_MODEL]
        new = spread(i.select(*used), "batch").groupBy("batch").cogroup(spread(materialise(_pixels(t)), "batch").groupBy("batch"))
        new = materialise(new.applyInPandas(lambda g, m: turned(g, m, s.group) if len(g) else pd.DataFrame({c: [] for c in ["node_id", *_TURN, "moved"]}), "node_id bigint, qx double, qy double, qz double, qw double, moved double"))
        t["images"] = materialise(i.drop(*_TURN).join(new.drop("moved"), "node_id").select(*i.columns))
        return REPEAT if (new.agg(F.max("moved")).first()[0] or 0.0) > s.settled else NEXT

    return step


def refresh(s: Settings) -> Step:
    """Take the inliers of all links again with the cameras as they are now."""

    def step(p: Pipeline, run: int) -> str:
        t = p.state.tables
        was = t["links"].filter("accepted").select("edge_id", F.explode("matches").alias("m")).select("edge_id", "m.idx1", "m.idx2", F.lit(True).alias("inlier"), F.lit(0.0).alias("quality"))
        ends = t["links"].select("edge_id", "src", "dst")
        held = robust.refresh_links(_correspondences(t, ends, was).select("edge_id", "idx1", "idx2", "a", "b", "quality", "inlier"), "edge_id")
        t["links"] = materialise(ends.join(held.select("edge_id", "relation", "inliers", "accepted", "matches"), "edge_id", "left"))
        return NEXT

    return step


def surface(s: Settings) -> Step:
    """A mesh over all images; its heights start at the ground below the images, where nothing else is known at 0."""

    def step(p: Pipeline, run: int) -> str:
        t = p.state.tables
        nodes, edges = mesh.grid_mesh(t["images"], s.cell, s.margin)
        t["nodes"], t["edges"] = materialise(nodes.withColumn("z", F.lit(0.0))), materialise(edges)
        return NEXT

    return step


def raise_surface(s: Settings) -> Step:
    """Vertices take the mean height of the points within a cell of them, and keep theirs where there are none."""

    def step(p: Pipeline, run: int) -> str:
        t = p.state.tables
        near = knn_join(t["points"].select(F.col("track").alias("p"), F.col("x").alias("px"), F.col("y").alias("py")), t["nodes"].select(F.col("node_id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy")), 1)
        z = near.filter(F.col("d2") <= s.cell**2).join(t["points"].select(F.col("track").alias("p"), "z"), "p").groupBy(F.col("q").alias("node_id")).agg(F.avg("z").alias("new_z"))
        t["nodes"] = materialise(t["nodes"].join(z, "node_id", "left").select("node_id", "x", "y", F.coalesce("new_z", "z").alias("z")))
        return NEXT

    return step


def _ground(p: Pipeline, s: Settings) -> DataFrame:
    """(p, row, col, px, py, z) of the mosaic's pixels over all images."""
    t = p.state.tables
    g = reference._grid(p.spark, t["images"], s.pixel, 0.0)
    low = t["nodes"].agg(F.min("x"), F.min("y"), F.countDistinct("x"), F.countDistinct("y"), F.max("x"), F.max("y")).first()
    if low[0] is None:
        return g.withColumn("z", F.lit(0.0))
    step_x, step_y = (low[4] - low[0]) / max(low[2] - 1, 1), (low[5] - low[1]) / max(low[3] - 1, 1)
    scaled = g.withColumns({"px": (F.col("px") - low[0]) / step_x, "py": (F.col("py") - low[1]) / step_y})
    z = raster.surface_heights(scaled, t["nodes"], (0.0, 0.0), 1.0, low[2]).select("p", "z")
    return g.join(z, "p").filter("z is not null")


def thumbnail(s: Settings) -> Step:
    def step(p: Pipeline, run: int) -> str:
        p.state.tables["preview"] = materialise(raster.preview(materialise(_ground(p, s)), p.state.tables["images"], 0.1))
        return NEXT

    return step


def densify(s: Settings) -> Step:
    def step(p: Pipeline, run: int) -> str:
        t = p.state.tables
        f = t["features"].filter("not is_sparse").withColumnsRenamed({"x": "fx", "y": "fy"})
        t["points"] = materialise(dense.densify(t["images"], f, t["nodes"], t["edges"]))
        return NEXT

    return step


def layers(s: Settings) -> Step:
    """The layers of every pixel with place in the frame, distance, view angle and weight, and with colours where they can be sampled."""

    def step(p: Pipeline, run: int) -> str:
        t = p.state.tables
        g = materialise(_ground(p, s))
        found = raster.layers(g, t["images"], s.layers).join(g.select("p", "row", "col", F.col("px").alias("gx"), F.col("py").alias("gy"), F.col("z").alias("gz")), "p")
        i = t["images"].withColumnRenamed("node_id", "cam_id").select("cam_id", "model_id", "x", "y", "z", *_TURN, "w_px", "h_px")
        found = found.join(i, "cam_id")
        radius, nx, ny = spatial.image_place((F.col("px"), F.col("py")), F.col("w_px"), F.col("h_px"))
        down = camera.rotate(tuple(map(F.col, _TURN)), (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
        angle = spatial.view_angle(down, (F.col("gx") - F.col("x"), F.col("gy") - F.col("y"), F.col("gz") - F.col("z")))
        weight = spatial.blend_weight((F.col("px"), F.col("py")), F.col("w_px"), F.col("h_px"), F.sqrt("d2"))
        out = found.select("p", "row", "col", "layer", "cam_id", "model_id", "px", "py", radius.alias("r"), nx.alias("nx"), ny.alias("ny"), angle.alias("theta"), weight.alias("weight"))
        t["layers"] = materialise(s.sample(out) if s.sample else out)
        return NEXT

    return step


def balance(s: Settings) -> Step:
    def step(p: Pipeline, run: int) -> str:
        t = p.state.tables
        if "l" not in t["layers"].columns:
            return NEXT
        lab = t["layers"].select("p", "layer", "cam_id", "model_id", F.array("l", "a", "b").alias("lab"), "r", "theta", "nx", "ny")
        pairs = materialise(tracks.colour_pairs(lab).withColumnsRenamed({f"{a}_id_{b}": f"{a}_{b}" for a in ("cam", "model") for b in "ab"}))
        groups = colour.components(pairs, "cam_a", "cam_b").select(F.col("node").alias("cam_a"), F.col("component").alias("block"))
        found, lens = colour.balance_groups(pairs.join(groups, "cam_a"), "block")
        t["colours"] = materialise(found)
        p.state.extra["vignetting"] = {str(m): v.tolist() for m, v in lens.items()}
        return NEXT

    return step


def blend(s: Settings) -> Step:
    """Corrected colours of the layers, blended in tiles."""

    def step(p: Pipeline, run: int) -> str:
        t = p.state.tables
        if "colours" not in t:
            return NEXT
        lens = p.state.extra.get("vignetting", {})
        v = p.spark.createDataFrame([(int(m), *map(float, x)) for m, x in lens.items()], "model_id bigint, v2 double, v4 double, v6 double")
        c = t["layers"].join(t["colours"].drop("block"), "cam_id", "left").join(F.broadcast(v), "model_id", "left").fillna(0.0, [*colour.PARAMETERS, "v2", "v4", "v6"])  # one row a model
        col = F.col
        lab = radiometry.correct((col("l"), col("a"), col("b")), (col("offset_l"), col("offset_a"), col("offset_b")), (col("v2"), col("v4"), col("v6")), col("reflectance"), (col("slope_x"), col("slope_y")), col("r"), col("theta"), col("nx"), col("ny"))
        n = s.tile
        px = c.select(F.floor(col("row") / n).alias("ty"), F.floor(col("col") / n).alias("tx"), "layer", F.pmod("row", F.lit(n)).cast("int").alias("row"), F.pmod("col", F.lit(n)).cast("int").alias("col"), *(x.alias(k) for x, k in zip(lab, "lab")), "weight")
        t["mosaic"] = materialise(raster.blend_tiles(px, ["ty", "tx"], ["l", "a", "b"], n))
        return NEXT

    return step


def default_steps(s: Settings | None = None) -> dict[str, Step]:
    """A step for every stage."""
    s = s or Settings()
    return {
        "initial_processing": link(s), "mesh_refinement": surface(s), "initial_global_relax": relax(s), "camera_parameter_relax": refresh(s), "final_global_relax": relax(s),
        "generate_thumbnail": thumbnail(s), "densify_mesh": densify(s), "dense_mesh_relax": raise_surface(s), "generate_layers": layers(s), "color_balance": balance(s), "blend_layers": blend(s),
    }


def main(arguments: list[str] | None = None) -> None:
    """Run all stages over the tables of a folder: ``python -m terraloom.plans.stages TABLES STATE [--resume PATH] [--stage NAME] [--skip NAME …]``."""
    import argparse

    a = argparse.ArgumentParser(description=main.__doc__)
    a.add_argument("tables"), a.add_argument("state"), a.add_argument("--resume"), a.add_argument("--stage"), a.add_argument("--skip", nargs="*", default=[])
    o = a.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    p = Pipeline(spark, default_steps(), skip=set(o.skip), folder=o.state, listener=lambda e: print(f"{e.stage} {e.run}: {e.outcome}, {e.seconds:.1f} s", flush=True))
    if o.resume:
        p.resume(o.resume, o.stage)
    else:
        p.state.tables.update(start(spark, o.tables))
    p.run_all()
    release(spark)
    if p.failure:
        raise p.failure


if __name__ == "__main__":
    main()
