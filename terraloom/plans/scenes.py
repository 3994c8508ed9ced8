"""Queries of matching, tracks, surfaces and mosaics over the test tables, with the SQL that checks them where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import camera
from terraloom.operators import dense, graph, matching, mesh, raster, robust, tracks
from terraloom.plans import reference as ref
from terraloom.plans.reference import FT, IM, LK, POS, features, images, links, positions, r, read, solved
from terraloom.runtime import materialise

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_MODEL = ["focal", "ppx", "ppy", "k1", "k2", "k3", "t1", "t2"]

# --- tracks -----------------------------------------------------------------------------------------------------------------------


@query(f"SELECT batch AS track, min(abs(z) % 12) AS error, count(DISTINCT node_id) AS images FROM {POS} GROUP BY batch HAVING min(abs(z) % 12) <= CASE WHEN count(DISTINCT node_id) >= 3 THEN 10 ELSE 1 END")
def track_gates(spark: SparkSession, d: str) -> DataFrame:
    """Batches as tracks of their images, gated by the least of an error made of the height."""
    t = positions(spark, d).select(F.col("batch").alias("track"), F.col("node_id").alias("image"), (F.abs("z") % 12).alias("error"))
    return tracks.gate_tracks(t)


@query(
    f"""WITH e AS (SELECT batch AS track, node_id AS ray, abs(z - 100) AS error FROM {POS}), k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY error, ray) AS k, count(*) OVER (PARTITION BY track) AS n FROM e),
  m AS (SELECT *, max(CASE WHEN k = n // 2 + 1 THEN error END) OVER (PARTITION BY track) AS mid FROM k), g AS (SELECT *, count(*) OVER (PARTITION BY track) AS left_ FROM m WHERE error <= greatest(3 * mid, 1e-6) AND k <= 5)
  SELECT track, ray, round(error, 6) AS error FROM g WHERE left_ >= 3"""
)
def ray_gates(spark: SparkSession, d: str) -> DataFrame:
    """Images as rays of their batch, the best five within three times the median of an error made of the height."""
    e = positions(spark, d).select(F.col("batch").alias("track"), F.col("node_id").alias("ray"), F.abs(F.col("z") - 100).alias("error"))
    return tracks.gate_rays(e).select("track", "ray", r("error", 6).alias("error"))


_CELL = "CAST(floor(x / 10) AS BIGINT) || ':' || CAST(floor(y / 10) AS BIGINT)"


@query(
    f"""WITH p AS (SELECT node_id, batch, {_CELL} AS cell FROM {POS}), i AS (SELECT l.edge_id, a.node_id AS f1, a.cell AS c1, b.node_id AS f2, b.cell AS c2 FROM {LK} l JOIN p a ON a.node_id = src JOIN p b ON b.node_id = dst),
  m AS (SELECT node_id FROM p WHERE batch % 3 = 0), c AS (SELECT DISTINCT cell FROM p WHERE batch % 4 = 1)
  SELECT edge_id FROM i WHERE f1 NOT IN (SELECT node_id FROM m) AND f2 NOT IN (SELECT node_id FROM m) AND NOT (c1 IN (SELECT cell FROM c) AND c2 IN (SELECT cell FROM c))"""
)
def uncovered_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that add coverage: no end in every third batch, and not both ends over cells that every fourth batch covers."""
    cell = F.concat_ws(":", F.floor(F.col("x") / 10), F.floor(F.col("y") / 10))
    p = materialise(positions(spark, d).select("node_id", "batch", cell.alias("cell")))
    end = lambda k: p.select(F.col("node_id").alias(f"f{k}"), F.col("cell").alias(f"c{k}"))
    i = links(spark, d).withColumnsRenamed({"src": "f1", "dst": "f2"}).join(end(1), "f1").join(end(2), "f2")
    return tracks.uncovered(i, p.filter("batch % 3 = 0").select(F.col("node_id").alias("node")), p.filter("batch % 4 = 1").select("cell")).select("edge_id")


@query(
    f"""WITH o AS (SELECT batch AS track, node_id, abs(x) % 16 AS residual_px FROM {POS}), k AS (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM o WHERE residual_px <= 8)
  SELECT track, node_id, round(residual_px, 6) AS residual_px FROM k WHERE n >= 2"""
)
def reprojection_gate(spark: SparkSession, d: str) -> DataFrame:
    """Images as observations of their batch, those within eight pixels of an error made of the place."""
    o = positions(spark, d).select(F.col("batch").alias("track"), "node_id", (F.abs("x") % 16).alias("residual_px"))
    return tracks.reproject_gate(o).select("track", "node_id", r("residual_px", 6).alias("residual_px"))


@query(
    f"""WITH l AS (SELECT batch AS p, node_id AS cam_id, CAST(row_number() OVER (PARTITION BY batch ORDER BY path, node_id) - 1 AS INT) AS layer FROM {POS}), t AS (SELECT * FROM l WHERE layer < 4)
  SELECT a.p, a.layer AS layer_a, b.layer AS layer_b, a.cam_id AS cam_id_a, b.cam_id AS cam_id_b FROM t a JOIN t b ON a.p = b.p AND a.layer < b.layer AND a.cam_id <> b.cam_id"""
)
def colour_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the first four layers of each place, here of a batch's first images."""
    from pyspark.sql import Window

    layer = F.row_number().over(Window.partitionBy("batch").orderBy("path", "node_id")) - 1
    l4 = positions(spark, d).select(F.col("batch").alias("p"), layer.alias("layer"), F.col("node_id").alias("cam_id")).filter("layer < 4")
    return tracks.colour_pairs(l4)


_TRACKS = f"""{ref._MATCH_SQL}, m AS (SELECT src || ':' || idx1 AS a, dst || ':' || idx2 AS b FROM ranked WHERE k = 1 AND (second IS NULL OR n < second)), e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
  c AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.node), k AS (SELECT node, min(c) AS track FROM c GROUP BY node)""".replace("WITH d AS", "WITH RECURSIVE d AS", 1)


@query(_TRACKS + " SELECT track, count(*) AS features, count(DISTINCT split_part(node, ':', 1)) AS images FROM k GROUP BY track")
def track_rays(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of matched features: connected features of at least two images, with how many each has."""
    c = _connected(spark, d).withColumn("image", F.split("node", ":")[0])
    return c.groupBy(F.col("component").alias("track")).agg(F.count("*").alias("features"), F.countDistinct("image").alias("images"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    m = matching.ratio_match(links(spark, d), features(spark, d, "descriptor"), 1.0).join(links(spark, d), "edge_id")
    return m.select(F.concat_ws(":", "src", "idx1").alias("a"), F.concat_ws(":", "dst", "idx2").alias("b"))


def _connected(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_matched(spark, d), "a", "b")


@query(_TRACKS + ", i AS (SELECT track, split_part(node, ':', 1) AS image, min(node) AS node FROM k GROUP BY ALL) SELECT track, image, node FROM i WHERE track IN (SELECT track FROM i GROUP BY track HAVING count(*) > 1)")
def tracks_one_per_image(spark: SparkSession, d: str) -> DataFrame:
    """Tracks with one feature for each image."""
    return tracks.build_tracks(_matched(spark, d), "a", "b", F.split("node", ":")[0])


# --- links ------------------------------------------------------------------------------------------------------------------------


def _correspondences(spark: SparkSession, d: str) -> DataFrame:
    """Matches of links as pairs of unit rays with their descriptor distance."""
    m = materialise(matching.ratio_match(links(spark, d), features(spark, d, "descriptor"), 1.0).join(links(spark, d), "edge_id"))
    models = read(spark, d, "camera_models").select("model_id", *(c.alias(n) for n, c in camera.model_columns().items()))
    f = matching.matched(features(spark, d, "x", "y"), m).join(images(spark, d, "model_id").join(models, "model_id"), "node_id")
    f = f.select("node_id", "idx", camera.forward_ray((F.col("x"), F.col("y")), {n: F.col(n) for n in _MODEL}).alias("ray"))
    end = lambda k, n, c: f.select(F.col("node_id").alias(n), F.col("idx").alias(f"idx{k}"), F.col("ray").alias(c))
    m = m.join(end(1, "src", "a"), ["src", "idx1"]).join(end(2, "dst", "b"), ["dst", "idx2"])
    return m.select("edge_id", "idx1", "idx2", "a", "b", F.col("distance").alias("quality"))


@query()
def accepted_links(spark: SparkSession, d: str) -> DataFrame:
    """Every link with matched features, with its inlier matches where its homography holds."""
    return robust.accept_links(_correspondences(spark, d), "edge_id")


@query()
def refreshed_links(spark: SparkSession, d: str) -> DataFrame:
    """The same links after a change of cameras, from their inliers as they were."""
    c = materialise(_correspondences(spark, d))
    was = robust.accept_links(c, "edge_id").select("edge_id", F.explode("matches").alias("m")).select("edge_id", "m.*", F.lit(True).alias("inlier"))
    return robust.refresh_links(c.join(was, ["edge_id", "idx1", "idx2"], "left").fillna({"inlier": False}), "edge_id")


@query(f"SELECT edge_id, src, dst FROM {LK} WHERE src NOT IN (SELECT node_id FROM {IM} WHERE batch % 5 = 0) AND dst NOT IN (SELECT node_id FROM {IM} WHERE batch % 5 = 0)")
def graph_without_batches(spark: SparkSession, d: str) -> DataFrame:
    """Links left when every fifth batch is taken out of the graph."""
    i = images(spark, d, "batch").withColumnRenamed("node_id", "node")
    return graph.remove_nodes(i.select("node"), links(spark, d), i.filter("batch % 5 = 0"), "src", "dst")[1].select("edge_id", "src", "dst")


@query(
    f"""WITH i AS (SELECT DISTINCT node_id FROM images), k AS (SELECT edge_id, src, dst FROM {LK} WHERE edge_id % 2 = 0), n AS (SELECT edge_id, dst AS src, src AS dst FROM {LK})
  SELECT * FROM k UNION ALL SELECT * FROM n WHERE edge_id NOT IN (SELECT edge_id FROM k) AND src IN (SELECT node_id FROM i) AND dst IN (SELECT node_id FROM i)"""
)
def graph_with_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of even number with those of the others turned round added."""
    e = links(spark, d).select("edge_id", "src", "dst")
    new = e.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.add_edges(e.filter("edge_id % 2 = 0"), new, images(spark, d).withColumnRenamed("node_id", "node"), "edge_id", "src", "dst")


# --- projection -------------------------------------------------------------------------------------------------------------------


@query(f"SELECT s.node_id, t.idx, true AS back FROM {ref._Q} s JOIN {FT} t USING (node_id) WHERE s.projection = 'PLANAR'")
def project_inverse(spark: SparkSession, d: str) -> DataFrame:
    """Whether the rays of features, by an inverse model, come back to within a hundredth of a pixel."""
    m = {n: F.col(n) for n in _MODEL}
    f = features(spark, d, "x", "y").withColumnsRenamed({"x": "fx", "y": "fy"}).join(solved(spark, d).filter("projection = 'PLANAR'"), "node_id")
    f = f.withColumns(dict(zip(("ux", "uy", "uz"), camera.unproject_inverse((F.col("fx"), F.col("fy")), m))))
    px, py = camera.project_inverse((F.col("ux"), F.col("uy"), F.col("uz")), m)
    return f.select("node_id", "idx", (F.hypot(px - F.col("fx"), py - F.col("fy")) < 0.01).alias("back"))


# --- surfaces ---------------------------------------------------------------------------------------------------------------------

_TILT = 0.1, 0.05


def _ground(spark: SparkSession, d: str, height) -> tuple[DataFrame, DataFrame]:
    """A regular mesh of 50 m over all images with heights ``height(x, y)``."""
    n, e = mesh.grid_mesh(positions(spark, d), 50.0, 200.0)
    return n.withColumn("z", height(F.col("x"), F.col("y"))), e


@query(
    f"""WITH i AS (SELECT * FROM {POS}), b AS (SELECT min(x) - 200 AS x0, max(x) + 200 AS x1, min(y) - 200 AS y0, max(y) + 200 AS y1 FROM i),
  t AS (SELECT node_id, x, y, z, dx, dy, dz, (100 + {_TILT[0]} * x + {_TILT[1]} * y - z) / (dz - {_TILT[0]} * dx - {_TILT[1]} * dy) AS t FROM {ref._AX} WHERE abs(dz - {_TILT[0]} * dx - {_TILT[1]} * dy) > 0.1)
  SELECT node_id, round(x + t * dx, 3) + 0.0 AS hx, round(y + t * dy, 3) + 0.0 AS hy, round(z + t * dz, 3) + 0.0 AS hz FROM t, b WHERE x + t * dx BETWEEN x0 AND x1 AND y + t * dy BETWEEN y0 AND y1"""
)
def mesh_hits(spark: SparkSession, d: str) -> DataFrame:
    """Where the images' axes meet a tilted mesh over all images, found by walking from triangle to triangle."""
    nodes, edges = _ground(spark, d, lambda x, y: 100.0 + _TILT[0] * x + _TILT[1] * y)
    a = ref._axes(spark, d).filter(F.abs(F.col("dz") - _TILT[0] * F.col("dx") - _TILT[1] * F.col("dy")) > 0.1)
    rays = a.select("node_id", *(F.col(c).alias(f"o{c}") for c in "xyz"), "dx", "dy", "dz")
    hits = dense.mesh_hits(rays, nodes, edges).filter(F.col("code") == mesh.HIT)
    return hits.select("node_id", *((r(c) + 0.0).alias(c) for c in ("hx", "hy", "hz")))


@query()
def densify(spark: SparkSession, d: str) -> DataFrame:
    """Points of the ground from the features that aren't sparse, over a mesh at height 0."""
    nodes, edges = _ground(spark, d, lambda x, y: F.lit(0.0))
    f = features(spark, d, "x", "y", "descriptor", "is_sparse").filter("not is_sparse").withColumnsRenamed({"x": "fx", "y": "fy"})
    return dense.densify(solved(spark, d).filter("projection = 'PLANAR'"), f, nodes, edges)


_VERTEX = f"""WITH i AS (SELECT * FROM {POS}), b AS (SELECT min(x) - 25 AS x0, max(x) + 25 AS x1, min(y) - 25 AS y0, max(y) + 25 AS y1 FROM i),
  s AS (SELECT *, least(1000, greatest(1, CAST(ceil((x1 - x0) / 25.0) AS BIGINT))) AS w, least(1000, greatest(1, CAST(ceil((y1 - y0) / 25.0) AS BIGINT))) AS h FROM b),
  v AS (SELECT *, i + j * (w + 1) AS p, x0 + greatest((x1 - x0) / w, 1e-9) * i AS x, y0 + greatest((y1 - y0) / h, 1e-9) * j AS y FROM (SELECT *, unnest(range(0, w + 1)) AS i FROM (SELECT *, unnest(range(0, h + 1)) AS j FROM s))),
  z AS (SELECT p.p, any_value(p.i) AS i, any_value(p.j) AS j, any_value(p.w) AS w, any_value(p.h) AS h, arg_min(q.z, ({ref._D2}, q.node_id)) AS z FROM v p, i q GROUP BY p.p)"""


@query(
    _VERTEX
    + """, e AS (SELECT p AS src, p + 1 AS dst, j = 0 OR j = h AS border, CASE WHEN j < h THEN p + w + 2 END AS opp0, CASE WHEN j > 0 THEN p - w - 1 END AS opp1 FROM z WHERE i < w
  UNION ALL SELECT p, p + w + 1, i = 0 OR i = w, CASE WHEN i < w THEN p + w + 2 END, CASE WHEN i > 0 THEN p - 1 END FROM z WHERE j < h UNION ALL SELECT p, p + w + 2, false, p + 1, p + w + 1 FROM z WHERE i < w AND j < h)
  SELECT e.*, a.z AS z_src, b.z AS z_dst FROM e JOIN z a ON a.p = e.src JOIN z b ON b.p = e.dst"""
)
def terrain_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Regular mesh over all images with the heights at both ends of each edge."""
    nodes, edges = mesh.grid_mesh(positions(spark, d), 25.0, 25.0)
    nodes = materialise(nodes)
    out = edges.join(nodes.select(F.col("node_id").alias("src"), F.col("z").alias("z_src")), "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("z").alias("z_dst")), "dst")
    return out.select("src", "dst", "border", "opp0", "opp1", "z_src", "z_dst")


@query(
    f"""WITH i AS (SELECT * FROM {POS}), v AS (SELECT p."row" AS r, p.col AS c, arg_min(q.z, ({ref._D2}, q.node_id)) AS z FROM {ref._grid_sql(25.0, 25.0)} p, i q GROUP BY ALL),
  f AS (SELECT r, c, 5 * r + a AS "row", 5 * c + b AS col, b / 5.0 AS u, a / 5.0 AS t FROM v, (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b))
  SELECT f."row", f.col, round(CASE WHEN u >= t THEN v00.z + u * (v10.z - v00.z) + t * (v11.z - v10.z) ELSE v00.z + t * (v01.z - v00.z) + u * (v11.z - v01.z) END, 4) + 0.0 AS z
  FROM f JOIN v v00 ON v00.r = f.r AND v00.c = f.c JOIN v v10 ON v10.r = f.r AND v10.c = f.c + 1 JOIN v v01 ON v01.r = f.r + 1 AND v01.c = f.c JOIN v v11 ON v11.r = f.r + 1 AND v11.c = f.c + 1"""
)
def dsm_tile(spark: SparkSession, d: str) -> DataFrame:
    """Surface heights over all images and a margin on a raster of 5 m over a mesh of 25 m; rows and columns count from the origin."""
    p = positions(spark, d)
    g = materialise(ref._grid(spark, p, 25.0, 25.0))
    from terraloom.operators.neighbours import knn_join

    near = knn_join(g.select("p", "px", "py"), ref._points(p), 1)
    nodes = materialise(near.join(p.select(F.col("node_id").alias("q"), "z"), "q").select(F.col("p").alias("node_id"), "z"))
    e = g.agg(F.min("col"), F.max("col"), F.min("row"), F.max("row")).first()
    if e[0] is None:
        return spark.createDataFrame([], "row bigint, col bigint, z double")
    c0, c1, r0, r1 = e
    fine = F.explode(F.sequence(F.lit(0), F.lit(4)))
    px = g.filter((F.col("col") < c1) & (F.col("row") < r1)).select("row", "col", fine.alias("a")).select("row", "col", "a", fine.alias("b"))
    px = px.select((5 * F.col("row") + F.col("a")).alias("row"), (5 * F.col("col") + F.col("b")).alias("col"))
    px = px.select("row", "col", (5.0 * F.col("col")).alias("px"), (5.0 * F.col("row")).alias("py"))
    z = raster.surface_heights(px, nodes, (25.0 * c0, 25.0 * r0), 25.0, c1 - c0 + 1)
    return z.select("row", "col", (r("z", 4) + 0.0).alias("z"))


# --- mosaics ----------------------------------------------------------------------------------------------------------------------


_V = ref._qrot_sql("s", ("(s.gx - s.x)", "(s.gy - s.y)", "(0 - s.z)"), -1)


def _shown_sql(step: float, margin: float) -> str:
    """``shown``: ground pixels of a raster over all images with the nearest five planar cameras, where each lies in the camera's frame."""
    return f"""WITH i AS (SELECT * FROM {POS}), s0 AS (SELECT * FROM {ref._Q} WHERE projection = 'PLANAR'), g0 AS {ref._grid_sql(step, margin)},
  n AS (SELECT p.p, q.node_id, row_number() OVER (PARTITION BY p.p ORDER BY {ref._D2}, q.node_id) AS rank FROM g0 p, s0 q QUALIFY rank <= 5),
  j AS (SELECT n.p, n.rank, g0."row", g0.col, g0.x AS gx, g0.y AS gy, s0.* FROM n JOIN g0 ON g0.p = n.p JOIN s0 ON s0.node_id = n.node_id),
  cam AS (SELECT *, {_V[0]} AS cx, {_V[1]} AS cy, {_V[2]} AS cz FROM j s), u AS (SELECT *, cx / greatest(cz, 1e-3) AS ux, cy / greatest(cz, 1e-3) AS uy FROM cam),
  shown AS (SELECT *, {ref._DX} * f + ppx AS px, {ref._DY} * f + ppy AS py FROM (SELECT *, ux * ux + uy * uy AS r2 FROM u))"""




@query(_shown_sql(5.0, 25.0) + """ SELECT gx, gy, CAST(layer AS INT) AS layer, cam_id, round(px, 2) + 0.0 AS px, round(py, 2) + 0.0 AS py FROM (SELECT gx, gy, node_id AS cam_id, px, py, row_number() OVER (PARTITION BY p ORDER BY rank) - 1 AS layer
  FROM shown WHERE cz > 0.001 AND px >= 0 AND px < w_px AND py >= 0 AND py < h_px) WHERE layer < 2""")  # fmt: skip
def ortho_layers(spark: SparkSession, d: str) -> DataFrame:
    """First two cameras that show each ground pixel of 5 m over all images and a margin."""
    p = materialise(ref._grid(spark, positions(spark, d), 5.0, 25.0).withColumn("z", F.lit(0.0)))
    found = raster.layers(p, solved(spark, d).filter("projection = 'PLANAR'"), 2).join(p.select("p", F.col("px").alias("gx"), F.col("py").alias("gy")), "p")
    return found.select("gx", "gy", "layer", "cam_id", (r("px", 2) + 0.0).alias("px"), (r("py", 2) + 0.0).alias("py"))


@query(_shown_sql(10.0, 25.0) + """, k AS (SELECT p, node_id AS cam_id, rank, CAST(trunc(px * 0.1) AS INT) AS tx, CAST(trunc(py * 0.1) AS INT) AS ty, w_px, h_px FROM shown WHERE cz > 0 AND abs(px) < 1e8 AND abs(py) < 1e8),
  f AS (SELECT p, arg_min(cam_id, rank) AS cam_id FROM k WHERE tx > 0 AND tx < floor(w_px * 0.1) AND ty > 0 AND ty < floor(h_px * 0.1) GROUP BY p)
  SELECT g0."row", g0.col, f.cam_id, CASE WHEN f.cam_id IS NULL THEN CASE WHEN (g0."row" + g0.col) % 2 = 0 THEN 64 ELSE 128 END END AS grey FROM g0 LEFT JOIN f USING (p)""")  # fmt: skip
def preview_mosaic(spark: SparkSession, d: str) -> DataFrame:
    """Which camera's thumbnail, a tenth of its size, shows each ground pixel of 10 m; chequered ground elsewhere."""
    p = ref._grid(spark, positions(spark, d), 10.0, 25.0).withColumn("z", F.lit(0.0))
    return raster.preview(p, solved(spark, d).filter("projection = 'PLANAR'"), 0.1).select("row", "col", "cam_id", "grey")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
