"""Queries of the survey-imagery operators over the test tables, each with the SQL that checks it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.functions import bits, camera, geo, geom, ortho, radiometry, spatial
from terraloom.operators import graph, lookup, matching, mesh, neighbours, tables, tracks
from terraloom.runtime import materialise, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Tables without their repeated rows. Rows of a key have the same content, so a distinct over the used columns is enough.
IM = "(SELECT DISTINCT node_id, batch, path, model_id, position, orientation, camera_info, capture_info FROM images)"
POS = f"(SELECT node_id, batch, path, position[1] AS x, position[2] AS y, position[3] AS z FROM {IM} WHERE position IS NOT NULL)"
FT = "(SELECT DISTINCT node_id, idx, x, y, strength, descriptor FROM features)"
LK = "(SELECT DISTINCT edge_id, src, dst, relation, relation_type, poses FROM links)"


def images(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """Images without repeated rows. Members of structs are given as columns, so that the scan and the shuffle hold nothing else."""
    return read(spark, d, "images").select("node_id", *columns).dropDuplicates(["node_id"])


def positions(spark: SparkSession, d: str) -> DataFrame:
    p = images(spark, d, "batch", "path", "position").filter("position is not null")
    return p.select("node_id", "batch", "path", *(F.col("position")[k].alias(n) for k, n in enumerate("xyz")))


def features(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read(spark, d, "features").select("node_id", "idx", *columns).dropDuplicates(["node_id", "idx"])


def links(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read(spark, d, "links").select("edge_id", "src", "dst", *columns).dropDuplicates(["edge_id"])


def r(c: Column | str, places: int = 3) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def _probes(p: DataFrame) -> DataFrame:
    return p.select(F.col("node_id").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("batch").alias("p_batch"))


def _points(p: DataFrame) -> DataFrame:
    return p.select(F.col("node_id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("batch").alias("q_batch"))


# --- similarity and cells ---------------------------------------------------------------------------------------------------------

_BITS_SQL = "list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(a.descriptor[i], b.descriptor[i]))))"
_MATCH_SQL = f"""
  WITH d AS (SELECT l.edge_id, a.idx AS idx1, b.idx AS idx2, CAST({_BITS_SQL} AS BIGINT) AS n, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, l.src, l.dst
    FROM {LK} l JOIN {FT} a ON a.node_id = l.src JOIN {FT} b ON b.node_id = l.dst WHERE a.descriptor IS NOT NULL AND b.descriptor IS NOT NULL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY edge_id, idx1 ORDER BY n, idx2) AS k, lead(n) OVER (PARTITION BY edge_id, idx1 ORDER BY n, idx2) AS second FROM d)"""


@query(f"SELECT * FROM (SELECT node_id, idx, CAST(floor(x / 200) AS BIGINT) AS cx, CAST(floor(y / 200) AS BIGINT) AS cy, strength, row_number() OVER (PARTITION BY node_id, floor(x / 200), floor(y / 200) ORDER BY strength DESC NULLS LAST, idx) AS k FROM {FT}) WHERE k = 1")
def grid_filter_best(spark: SparkSession, d: str) -> DataFrame:
    """Strongest feature of each cell of 200 px."""
    best = matching.best_per_cell(features(spark, d, "x", "y", "strength"), ["node_id"], "x", "y", 200.0, "strength", ["idx"])
    cx, cy = spatial.cell(F.col("x"), F.col("y"), 200.0)
    return best.select("node_id", "idx", cx.alias("cx"), cy.alias("cy"), "strength", F.lit(1).cast("bigint").alias("k"))


@query(_MATCH_SQL + " SELECT edge_id, idx1, idx2, round(n / 486.0, 6) AS distance FROM ranked WHERE k = 1 AND (second IS NULL OR n < 0.8 * second)")
def hamming_ratio_match(spark: SparkSession, d: str) -> DataFrame:
    """Similarity join of linked images with the ratio test."""
    m = matching.ratio_match(links(spark, d), features(spark, d, "descriptor"), 0.8)
    return m.select("edge_id", "idx1", "idx2", r("distance", 6).alias("distance"))


def _located(spark: SparkSession, d: str, ratio: float) -> DataFrame:
    m = matching.ratio_match(links(spark, d), features(spark, d, "descriptor"), ratio).join(links(spark, d), "edge_id")
    f = features(spark, d, "x", "y")
    one = f.select(F.col("node_id").alias("src"), F.col("idx").alias("idx1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    two = f.select(F.col("node_id").alias("dst"), F.col("idx").alias("idx2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return m.join(one, ["src", "idx1"]).join(two, ["dst", "idx2"])


@query(
    _MATCH_SQL
    + """, m AS (SELECT * FROM ranked WHERE k = 1 AND (second IS NULL OR n < second))
  SELECT DISTINCT edge_id, idx1, idx2 FROM (
    SELECT *, row_number() OVER (PARTITION BY edge_id, src, floor(x1 / 400), floor(y1 / 400) ORDER BY n, idx1, idx2) AS r1,
      row_number() OVER (PARTITION BY edge_id, dst, floor(x2 / 400), floor(y2 / 400) ORDER BY n, idx1, idx2) AS r2 FROM m) WHERE r1 = 1 OR r2 = 1"""
)
def grid_filter_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches that are the best of a cell in either of their images."""
    m = _located(spark, d, 1.0).withColumn("near", -F.round(F.col("distance") * matching.BITS))
    ends = [(["edge_id", "src"], "x1", "y1"), (["edge_id", "dst"], "x2", "y2")]
    return matching.best_of_either(m, ends, 400.0, "near", ["idx1", "idx2"]).select("edge_id", "idx1", "idx2")


@query()
def suppressed_features(spark: SparkSession, d: str) -> DataFrame:
    """Non-maximum suppression within 300 px."""
    f = features(spark, d, "x", "y", "strength")
    return matching.suppress(f, "node_id", "idx", "x", "y", "strength", 300.0).filter("kept").select("node_id", "idx")


# --- spatial joins ----------------------------------------------------------------------------------------------------------------

_D2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)"


@query(
    f"WITH i AS (SELECT * FROM {POS}) SELECT src, dst, k, round(d2, 5) + 0.0 AS d2 FROM (SELECT p.node_id AS src, q.node_id AS dst, {_D2} AS d2, row_number() OVER (PARTITION BY p.node_id ORDER BY {_D2}, q.node_id) AS k "
    "FROM i p JOIN i q ON q.batch <= p.batch) WHERE k <= 10 AND src <> dst"
)
def knn_links(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest images, itself included, among those of batches already there."""
    p = positions(spark, d)
    near = neighbours.knn_join(_probes(p), _points(p), 10, ("p_batch", "q_batch")).filter("p <> q")
    return near.select(F.col("p").alias("src"), F.col("q").alias("dst"), F.col("rank").cast("bigint").alias("k"), r("d2", 5).alias("d2"))


@query(f"WITH i AS (SELECT * FROM {POS}) SELECT p.node_id AS a, q.node_id AS b, round({_D2}, 5) + 0.0 AS d2 FROM i p JOIN i q ON p.batch = q.batch AND p.node_id < q.node_id AND {_D2} <= 400")
def radius_join(spark: SparkSession, d: str) -> DataFrame:
    """Images of one batch at most 20 m apart."""
    p = positions(spark, d)
    a, b = p.select("batch", F.col("node_id").alias("a"), F.col("x").alias("px"), F.col("y").alias("py")), p.select("batch", F.col("node_id").alias("b"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return neighbours.radius_join(a, b, 20.0, on=("batch",)).filter("a < b").select("a", "b", r("d2", 5).alias("d2"))


@query(
    f"WITH i AS (SELECT * FROM {POS}), n AS (SELECT p.node_id, {_D2} AS d2, row_number() OVER (PARTITION BY p.node_id ORDER BY {_D2}, q.node_id) AS k FROM i p, i q), "
    "s AS (SELECT d2, row_number() OVER (ORDER BY d2) - 1 AS pos, count(*) OVER () AS n FROM n WHERE k = 2) SELECT round(sqrt(d2), 6) AS spacing FROM s WHERE pos = n // 2"
)
def median_spacing(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.median_spacing(_points(positions(spark, d))).select(r("spacing", 6).alias("spacing"))


def window(places: DataFrame, step: float, margin: float) -> tuple[int, int, int, int] | None:
    """First and last column and row of a raster of ``step`` metres that holds all places and a margin; null where there are none."""
    e = places.filter("not isnan(x) and not isnan(y)").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if e[0] is None:
        return None
    low = [int(np.floor((v - margin) / step)) for v in (e[0], e[2])]
    high = [int(np.ceil((v + margin) / step)) for v in (e[1], e[3])]
    return low[0], high[0], low[1], high[1]


def _grid(spark: SparkSession, places: DataFrame, step: float, margin: float) -> DataFrame:
    """(p, row, col, px, py) of the raster over all places and a margin. Columns and rows count from the origin, so some are negative."""
    c0, c1, r0, r1 = window(places, step, margin) or (0, -1, 0, -1)
    n = c1 - c0 + 1
    g = spark.range(n * (r1 - r0 + 1)).select("id", (F.floor(F.col("id") / max(n, 1)) + r0).alias("row"), (F.col("id") % max(n, 1) + c0).alias("col"))
    return g.select(F.col("id").alias("p"), "row", "col", (step * F.col("col")).alias("px"), (step * F.col("row")).alias("py"))


def _grid_sql(step: float, margin: float) -> str:
    """The same over the places ``i``, with x and y."""
    return f"""(SELECT (r - r0) * (c1 - c0 + 1) + (c - c0) AS p, r AS "row", c AS col, {step} * c AS x, {step} * r AS y FROM
    (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM (SELECT CAST(floor((min(x) - {margin}) / {step}) AS BIGINT) AS c0, CAST(ceil((max(x) + {margin}) / {step}) AS BIGINT) AS c1,
      CAST(floor((min(y) - {margin}) / {step}) AS BIGINT) AS r0, CAST(ceil((max(y) + {margin}) / {step}) AS BIGINT) AS r1 FROM i WHERE NOT isnan(x) AND NOT isnan(y)))))"""


@query(f"WITH i AS (SELECT * FROM {POS}) SELECT p, round(z, 3) + 0.0 AS z FROM (SELECT p.p, q.z, row_number() OVER (PARTITION BY p.p ORDER BY {_D2}, q.node_id) AS k FROM {_grid_sql(20.0, 20.0)} p, i q) WHERE k = 1")
def nearest_height(spark: SparkSession, d: str) -> DataFrame:
    """Height of the vertices of a grid over all images from the nearest image."""
    p = positions(spark, d)
    near = neighbours.knn_join(_grid(spark, p, 20.0, 20.0).select("p", "px", "py"), _points(p), 1)
    return near.join(p, near["q"] == p["node_id"]).select("p", r("z").alias("z"))


_NEAREST_SQL = f"SELECT p.p, p.\"row\", p.col, arg_min(q.node_id, ({_D2}, q.node_id)) AS label FROM {_grid_sql(8.0, 16.0)} p, i q GROUP BY ALL"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d)
    g = _grid(spark, p, 8.0, 16.0)
    return neighbours.knn_join(g.select("p", "px", "py"), _points(p), 1).join(g, "p").select("row", "col", F.col("q").alias("label"))


@query(
    f"WITH i AS (SELECT * FROM {POS}), g AS ({_NEAREST_SQL}) SELECT \"row\", col, label FROM (SELECT *, lag(label) OVER h AS a, lead(label) OVER h AS b, lag(label) OVER v AS c, lead(label) OVER v AS e FROM g "
    'WINDOW h AS (PARTITION BY "row" ORDER BY col), v AS (PARTITION BY col ORDER BY "row")) WHERE (a <> label OR b <> label OR c <> label OR e <> label) AND ("row" + col) % 3 = 0'
)
def voronoi_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Cells at a seam between nearest cameras, over all images, thinned by a modulo."""
    return tables.boundary(_labels(spark, d), "row", "col", "label").filter("(row + col) % 3 = 0").select("row", "col", "label")


@query(
    f"WITH i AS (SELECT * FROM {POS}), g AS ({_NEAREST_SQL}) SELECT a.\"row\", a.col, count(*) AS n, round(avg(b.\"row\" + b.col), 6) + 0.0 AS mean FROM g a JOIN g b ON b.\"row\" BETWEEN a.\"row\" - 2 AND a.\"row\" + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 AND a.label = b.label GROUP BY ALL"
)
def kernel_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean over 5 x 5 cells of the same camera."""
    g = materialise(_labels(spark, d))
    near = g.select(F.explode(F.sequence(F.col("row") - 2, F.col("row") + 2)).alias("r2"), "col", F.col("row").alias("r0"), "label")
    near = near.select("r2", F.explode(F.sequence(F.col("col") - 2, F.col("col") + 2)).alias("c2"), "r0", F.col("col").alias("c0"), "label")
    b = g.select(F.col("row").alias("r2"), F.col("col").alias("c2"), "label")
    return near.join(b, ["r2", "c2", "label"]).groupBy(F.col("r0").alias("row"), F.col("c0").alias("col")).agg(F.count("*").alias("n"), (r(F.avg(F.col("r2") + F.col("c2")), 6) + 0.0).alias("mean"))


@query(
    f"WITH i AS (SELECT * FROM {POS}), s AS (SELECT p.p, floor(p.\"row\" / 10.0) AS ty, floor(p.col / 10.0) AS tx, q.node_id, row_number() OVER (PARTITION BY p.p ORDER BY {_D2}, q.node_id) AS k FROM {_grid_sql(10.0, 10.0)} p, i q) SELECT DISTINCT CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, node_id AS cam_id FROM s WHERE k <= 5"
)
def tile_cameras(spark: SparkSession, d: str) -> DataFrame:
    """Cameras each tile over all images needs: five nearest of 10 x 10 samples."""
    p = positions(spark, d)
    g = _grid(spark, p, 10.0, 10.0)
    near = neighbours.knn_join(g.select("p", "px", "py"), _points(p), 5).join(g, "p")
    return near.select(F.floor(F.col("col") / 10).alias("tx"), F.floor(F.col("row") / 10).alias("ty"), F.col("q").alias("cam_id")).distinct()


# --- cameras ----------------------------------------------------------------------------------------------------------------------

_TIER = "CASE WHEN lower(c.make) = lower(e.make) AND lower(c.model) = lower(e.model) AND lower(c.lens_model) = lower(e.lens_model) AND c.w = e.sensor_width_px AND c.h = e.sensor_height_px THEN 1 WHEN c.w = e.sensor_width_px AND c.h = e.sensor_height_px THEN 2 ELSE 3 END"
_LOOKUP_SQL = f"""
  WITH c AS (SELECT node_id, camera_info.make AS make, camera_info.model AS model, camera_info.lens_model AS lens_model, camera_info.width_px AS w, camera_info.height_px AS h, camera_info.focal_px AS f FROM {IM}),
  hit AS (SELECT c.*, e.ord, e.sensor_width_px AS ew, e.sensor_height_px AS eh, e.pp_offset, e.radial, e.tangential, e.focal, CASE WHEN e.ord IS NULL THEN NULL ELSE {_TIER} END AS tier
    FROM c LEFT JOIN camera_db e ON lower(c.make) = lower(e.make) AND lower(c.model) = lower(e.model)),
  best AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY tier NULLS LAST, ord) AS k FROM hit)"""


def _looked_up(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("camera_info")
    info = images(spark, d, c["make"].alias("make"), c["model"].alias("model"), c["lens_model"].alias("lens_model"), c["width_px"].alias("sensor_width_px"), c["height_px"].alias("sensor_height_px"), c["focal_px"].alias("f"))
    tiers = [["make", "model", "lens_model", "sensor_width_px", "sensor_height_px"], ["make", "model", "sensor_width_px", "sensor_height_px"], ["make", "model"]]
    db = read(spark, d, "camera_db").select("*", F.col("sensor_width_px").alias("ew"), F.col("sensor_height_px").alias("eh"), F.col("ord").alias("entry"))
    return lookup.tiered_lookup(info, "node_id", db, "ord", tiers, ["entry", "ew", "eh", "pp_offset", "radial", "tangential", "focal"])


@query(_LOOKUP_SQL + " SELECT node_id, tier, ord FROM best WHERE k = 1")
def tiered_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _looked_up(spark, d).select("node_id", "tier", F.col("entry").alias("ord"))


@query(
    _LOOKUP_SQL
    + """, s AS (SELECT *, CASE WHEN w = ew AND h = eh THEN 1.0 ELSE CAST(w AS DOUBLE) / ew END AS scale FROM best WHERE k = 1 AND ord IS NOT NULL)
  SELECT node_id, round(w / 2.0 + pp_offset[1] * scale, 4) AS ppx, round(h / 2.0 + pp_offset[2] * scale, 4) AS ppy, round(CASE WHEN f IS NOT NULL AND NOT isnan(f) AND f > 0 THEN f ELSE coalesce(focal, f) END, 4) AS focal,
    coalesce(radial[1], 0) AS k1, coalesce(radial[2], 0) AS k2, coalesce(radial[3], 0) AS k3, coalesce(tangential[1], 0) AS t1, coalesce(tangential[2], 0) AS t2 FROM s"""
)
def apply_db_entry(spark: SparkSession, d: str) -> DataFrame:
    """Calibration of the entry found, with its distortion."""
    e = _looked_up(spark, d).filter("entry is not null")
    ppx, ppy, f = lookup.calibrated(F.col("sensor_width_px"), F.col("sensor_height_px"), F.col("ew"), F.col("eh"), F.col("pp_offset")[0], F.col("pp_offset")[1], F.col("f"), F.col("focal"))
    at = lambda c, k: F.coalesce(F.get(F.col(c), F.lit(k)), F.lit(0.0))
    lens = [at("radial", k).alias(f"k{k + 1}") for k in range(3)] + [at("tangential", k).alias(f"t{k + 1}") for k in range(2)]
    return e.select("node_id", r(ppx, 4).alias("ppx"), r(ppy, 4).alias("ppy"), r(f, 4).alias("focal"), *lens)


_INFO = ["width_px", "height_px", "focal_px", "make", "model", "serial_no", "lens_make", "lens_model"]


@query(f"SELECT node_id, min(node_id) OVER (PARTITION BY {', '.join(f'camera_info.{c}' for c in _INFO)}) AS shared_model FROM {IM}")
def model_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Images with equal camera data share a model."""
    i = images(spark, d, *(F.col("camera_info")[c].alias(c) for c in _INFO))
    return lookup.shared_models(i, _INFO, "node_id").select("node_id", "shared_model")


@query(
    f"""WITH i AS (SELECT DISTINCT node_id, model_id, camera_info.make AS make, camera_info.model AS model, camera_info.lens_model AS lens_model FROM images),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY node_id) AS k FROM i) WHERE k = 1),
  e AS (SELECT f.make, f.model, f.lens_model, m.pixels_cols AS w, m.pixels_rows AS h, m.radial, m.tangential, m.pp, m.focal, model_id FROM f JOIN camera_models m USING (model_id)),
  n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY make, model, lens_model, w, h ORDER BY model_id DESC) AS k FROM e) WHERE k = 1)
  SELECT CASE WHEN n.k IS NULL THEN o.make ELSE n.make END AS make, CASE WHEN n.k IS NULL THEN o.model ELSE n.model END AS model, CASE WHEN n.k IS NULL THEN o.lens_model ELSE n.lens_model END AS lens_model,
    coalesce(o.sensor_width_px, n.w) AS sensor_width_px, coalesce(o.sensor_height_px, n.h) AS sensor_height_px,
    {", ".join(f"round(CASE WHEN n.k IS NULL THEN o.radial[{k}] ELSE n.radial[{k}] END, 9) AS k{k}" for k in (1, 2, 3))}, {", ".join(f"round(CASE WHEN n.k IS NULL THEN o.tangential[{k}] ELSE n.tangential[{k}] END, 9) AS t{k}" for k in (1, 2))},
    round(CASE WHEN n.k IS NULL THEN o.pp_offset[1] ELSE n.pp[1] - n.w / 2.0 END, 6) AS offset_x, round(CASE WHEN n.k IS NULL THEN o.pp_offset[2] ELSE n.pp[2] - n.h / 2.0 END, 6) AS offset_y,
    round(CASE WHEN n.k IS NULL THEN o.focal WHEN n.focal > 0 AND NOT isnan(n.focal) THEN n.focal END, 6) AS focal
  FROM camera_db o FULL JOIN n ON o.make IS NOT DISTINCT FROM n.make AND o.model IS NOT DISTINCT FROM n.model AND o.lens_model IS NOT DISTINCT FROM n.lens_model AND o.sensor_width_px IS NOT DISTINCT FROM n.w AND o.sensor_height_px IS NOT DISTINCT FROM n.h"""
)
def camera_db_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The camera list, overwritten with the calibration of each model in use as its first image names it; of models under one name the last by id holds."""
    keys = ["make", "model", "lens_model", "sensor_width_px", "sensor_height_px"]
    values = ["k1", "k2", "k3", "t1", "t2", "offset_x", "offset_y", "focal"]
    c = F.col("camera_info")
    used = read(spark, d, "images").groupBy("model_id").agg(F.min_by(F.struct(c["make"].alias("make"), c["model"].alias("model"), c["lens_model"].alias("lens_model")), "node_id").alias("i"))
    m = read(spark, d, "camera_models").withColumnsRenamed({"pixels_cols": "sensor_width_px", "pixels_rows": "sensor_height_px"})
    at = lambda name, k: F.get(F.col(name), F.lit(k))
    lens = [at("radial", k).alias(f"k{k + 1}") for k in range(3)] + [at("tangential", k).alias(f"t{k + 1}") for k in range(2)]
    known = F.when(~F.isnan("focal") & (F.col("focal") > 0), F.col("focal")).alias("focal")
    e = used.join(m, "model_id").select("model_id", "i.*", *keys[3:], *lens, (at("pp", 0) - F.col(keys[3]) / 2).alias("offset_x"), (at("pp", 1) - F.col(keys[4]) / 2).alias("offset_y"), known)
    new = e.groupBy(*keys).agg(F.max_by(F.struct(*values), "model_id").alias("v")).select(*keys, "v.*")
    old = read(spark, d, "camera_db").select(*keys, *lens, at("pp_offset", 0).alias("offset_x"), at("pp_offset", 1).alias("offset_y"), "focal")
    done = lookup.upsert(old, new, keys, values)
    return done.select(*keys, *(F.round(v, 9 if v[0] in "kt" else 6).alias(v) for v in values))


_NUM = "CASE WHEN NOT isnan({0}) THEN {0} END"


@query(
    f"""WITH v AS (SELECT node_id, i.focal_px AS f, {_NUM.format('c.relative_altitude')} AS rel, {_NUM.format('c.altitude')} AS alt, {_NUM.format('c.accuracy_xy')} AS axy, {_NUM.format('c.accuracy_z')} AS az,
    c.latitude IS NOT NULL AND c.longitude IS NOT NULL AS placed, c.datestamp AS d, c."timestamp" AS t FROM (SELECT node_id, camera_info AS i, capture_info AS c FROM {IM}))
  SELECT node_id, CASE WHEN f > 1 AND NOT isnan(f) THEN f END AS focal, coalesce(rel, alt) AS altitude, CASE WHEN placed AND axy > 0 THEN axy END AS accuracy_xy,
    CASE WHEN rel IS NOT NULL THEN az WHEN alt IS NOT NULL AND az > 0 THEN az END AS accuracy_z, CASE WHEN placed AND nullif(d, '') IS NOT NULL THEN concat(d, ' ', t) ELSE t END AS stamp FROM v"""
)
def metadata_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which of an image's readings hold. NaN is no reading; an accuracy needs what it is the accuracy of, and holds above zero only (beside a relative altitude as it is)."""
    i, c = F.col("camera_info"), F.col("capture_info")
    number = lambda n: F.when(~F.isnan(c[n]), c[n]).alias(n)
    used = [*(c[n].alias(n) for n in ("latitude", "longitude", "timestamp", "datestamp")), *map(number, ("altitude", "relative_altitude", "accuracy_xy", "accuracy_z"))]
    v = images(spark, d, F.when(~F.isnan(i["focal_px"]), i["focal_px"]).alias("focal_px"), *used)
    col = F.col
    placed = col("latitude").isNotNull() & col("longitude").isNotNull()
    stamp = F.when(placed & (col("datestamp") != ""), F.concat("datestamp", F.lit(" "), F.coalesce("timestamp", F.lit("")))).otherwise(col("timestamp"))
    positive = F.when(col("accuracy_z") > 0, col("accuracy_z"))
    az = F.when(col("relative_altitude").isNotNull(), col("accuracy_z")).when(col("altitude").isNotNull(), positive)
    return v.select(
        "node_id", F.when(col("focal_px") > 1, col("focal_px")).alias("focal"), F.coalesce("relative_altitude", "altitude").alias("altitude"),
        F.when(placed & (col("accuracy_xy") > 0), col("accuracy_xy")).alias("accuracy_xy"), az.alias("accuracy_z"), stamp.alias("stamp"),
    )


# --- projection and geometry ------------------------------------------------------------------------------------------------------


def _qrot_sql(q: str, v: tuple[str, str, str], sign: int = 1) -> tuple[str, str, str]:
    """Rotation by the unit quaternion columns qx qy qz qw of alias ``q``."""
    x, y, z, w = f"({sign} * {q}.qx)", f"({sign} * {q}.qy)", f"({sign} * {q}.qz)", f"{q}.qw"
    a, b, c = v
    tx, ty, tz = f"(2 * ({y} * {c} - {z} * {b}))", f"(2 * ({z} * {a} - {x} * {c}))", f"(2 * ({x} * {b} - {y} * {a}))"
    return f"({a} + {w} * {tx} + ({y} * {tz} - {z} * {ty}))", f"({b} + {w} * {ty} + ({z} * {tx} - {x} * {tz}))", f"({c} + {w} * {tz} + ({x} * {ty} - {y} * {tx}))"


_Q = f"""(SELECT node_id, batch, path, x, y, z, q[1] / n AS qx, q[2] / n AS qy, q[3] / n AS qz, q[4] / n AS qw, w_px, h_px, m.* EXCLUDE (model_id) FROM (
    SELECT node_id, batch, path, model_id, position[1] AS x, position[2] AS y, position[3] AS z, orientation AS q, sqrt(orientation[1] * orientation[1] + orientation[2] * orientation[2] + orientation[3] * orientation[3] + orientation[4] * orientation[4]) AS n
    FROM {IM} WHERE position IS NOT NULL AND orientation IS NOT NULL) i
  JOIN (SELECT model_id, pixels_cols AS w_px, pixels_rows AS h_px, focal AS f, coalesce(pp[1], 0) AS ppx, coalesce(pp[2], 0) AS ppy, coalesce(radial[1], 0) AS k1, coalesce(radial[2], 0) AS k2, coalesce(radial[3], 0) AS k3, coalesce(tangential[1], 0) AS t1, coalesce(tangential[2], 0) AS t2, projection FROM camera_models) m USING (model_id))"""
_DX = "((1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2) * ux + 2 * ux * uy * t1 + t2 * (r2 + 2 * ux * ux))"
_DY = "((1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2) * uy + 2 * ux * uy * t2 + t1 * (r2 + 2 * uy * uy))"


def solved(spark: SparkSession, d: str) -> DataFrame:
    """Solved images with their models: place x y z, quaternion qx qy qz qw, and the model's columns."""
    i = images(spark, d, "batch", "path", "model_id", "position", "orientation").filter("position is not null and orientation is not null")
    m = read(spark, d, "camera_models").select("model_id", F.col("pixels_cols").alias("w_px"), F.col("pixels_rows").alias("h_px"), "projection", *(c.alias(n) for n, c in camera.model_columns().items()))
    i = i.select("node_id", "batch", "path", "model_id", *(F.col("position")[k].alias(n) for k, n in enumerate("xyz")), *(F.col("orientation")[k].alias(n) for k, n in enumerate(("qx", "qy", "qz", "qw"))))
    return i.join(m, "model_id")


_MODEL = ["focal", "ppx", "ppy", "k1", "k2", "k3", "t1", "t2"]


def _cols(*names: str) -> tuple[Column, ...]:
    return tuple(map(F.col, names))


_CAM_X, _CAM_Y, _CAM_Z = _qrot_sql("s", ("(g.x - s.x)", "(g.y - s.y)", "(0 - s.z)"), -1)
_PROJECT_SQL = f"""
  cam AS (SELECT s.*, g.id, {_CAM_X} AS cx, {_CAM_Y} AS cy, {_CAM_Z} AS cz FROM s JOIN g ON g.link = s.node_id),
  u AS (SELECT *, cx / greatest(cz, 1e-3) AS ux, cy / greatest(cz, 1e-3) AS uy FROM cam WHERE projection = 'PLANAR' AND cz > 0.001),
  px AS (SELECT *, {_DX} * f + ppx AS px, {_DY} * f + ppy AS py FROM (SELECT *, ux * ux + uy * uy AS r2 FROM u)),
  shown AS (SELECT * FROM px WHERE px >= 0 AND px < w_px AND py >= 0 AND py < h_px)"""


def _in_frame(c: DataFrame) -> DataFrame:
    """Ground points gx gy on height 0 in the frames of their cameras, with px and py."""
    at = camera.seen((F.col("gx"), F.col("gy"), F.lit(0.0)), _cols("x", "y", "z"), _cols("qx", "qy", "qz", "qw"), {n: F.col(n) for n in _MODEL})
    c = c.filter("projection = 'PLANAR'").withColumn("seen", at).filter(F.col("seen.depth") > camera.LEAST_DEPTH)
    return c.withColumns({"px": F.col("seen.px"), "py": F.col("seen.py")}).filter("px >= 0 and px < w_px and py >= 0 and py < h_px")


@query(f"WITH s AS (SELECT * FROM {_Q}), g AS (SELECT l.edge_id AS id, l.src AS link, i.x, i.y FROM {LK} l JOIN {POS} i ON i.node_id = l.dst), {_PROJECT_SQL} SELECT id AS edge_id, round(px, 3) AS px, round(py, 3) AS py FROM shown")
def project_points(spark: SparkSession, d: str) -> DataFrame:
    """The ground below a link's second image in the frame of its first."""
    ground = positions(spark, d).select(F.col("node_id").alias("dst"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    c = links(spark, d).join(ground, "dst").join(solved(spark, d).withColumnRenamed("node_id", "src").drop("batch"), "src")
    return _in_frame(c).select("edge_id", r("px").alias("px"), r("py").alias("py"))


@query(
    f"WITH s AS (SELECT * FROM {_Q}), g AS (SELECT a.node_id AS link, b.node_id AS id, b.x, b.y FROM {POS} a JOIN {POS} b ON a.batch = b.batch AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600), {_PROJECT_SQL} SELECT id AS node_id, count(*) AS n FROM shown GROUP BY id"
)
def overlap_count(spark: SparkSession, d: str) -> DataFrame:
    """How many images of the batch, at most 60 m away, show the ground below each image."""
    p = positions(spark, d)
    ground = p.select("batch", F.col("node_id").alias("id"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    near = neighbours.radius_join(ground, solved(spark, d), 60.0, ("gx", "gy"), ("x", "y"), ("batch",))
    return _in_frame(near).groupBy(F.col("id").alias("node_id")).agg(F.count("*").alias("n"))


_RAY = f"(SELECT node_id, idx, vx, vy, vz, qx, qy, qz, qw FROM (SELECT *, 1 / n AS vz, dx / n AS vx, dy / n AS vy FROM (SELECT *, sqrt(dx * dx + dy * dy + 1) AS n FROM (SELECT *, {_DX} AS dx, {_DY} AS dy FROM (SELECT *, ux * ux + uy * uy AS r2 FROM (SELECT s.*, t.idx, (t.x - ppx) / f AS ux, (t.y - ppy) / f AS uy FROM {_Q} s JOIN {FT} t USING (node_id)))))))"
_RX, _RY, _RZ = _qrot_sql("u", ("u.vx", "u.vy", "u.vz"))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d, "x", "y").withColumnsRenamed({"x": "fx", "y": "fy"})
    return f.join(solved(spark, d), "node_id")


@query(f"SELECT node_id, idx, round({_RX}, 6) + 0.0 AS rx, round({_RY}, 6) + 0.0 AS ry, round({_RZ}, 6) + 0.0 AS rz FROM {_RAY} u")
def unproject_inverse(spark: SparkSession, d: str) -> DataFrame:
    """World rays of features by the closed form."""
    ray = camera.rotate(_cols("qx", "qy", "qz", "qw"), _cols("ux", "uy", "uz"))
    u = camera.unproject_inverse(_cols("fx", "fy"), {n: F.col(n) for n in _MODEL})
    return _pixels(spark, d).withColumns(dict(zip(("ux", "uy", "uz"), u))).select("node_id", "idx", *(r(c, 6).alias(n) for c, n in zip(ray, ("rx", "ry", "rz"))))


@query(
    f"SELECT node_id, idx, round(vx / n, 6) + 0.0 AS ux, round(vy / n, 6) + 0.0 AS uy, round(1 / n, 6) AS uz FROM (SELECT *, sqrt(vx * vx + vy * vy + 1) AS n FROM (SELECT node_id, idx, 0.5 * (t.x - ppx) / f AS vx, 0.5 * (t.y - ppy) / f AS vy FROM {_Q} s JOIN {FT} t USING (node_id)))"
)
def unproject_forward(spark: SparkSession, d: str) -> DataFrame:
    """Rays halfway out to features, projected into the frame and recovered by inverting the distortion."""
    m = {n: F.col(n) for n in _MODEL}
    half = lambda p, c: 0.5 * (F.col(p) - F.col(c)) / F.col("focal")
    px, py = camera.project((half("fx", "ppx"), half("fy", "ppy"), F.lit(1.0)), m)
    u = _pixels(spark, d).withColumns({"px": px, "py": py})
    ray = camera.unproject_forward(_cols("px", "py"), m)
    return u.select("node_id", "idx", *((r(c, 6) + 0.0).alias(n) for c, n in zip(ray[:2], ("ux", "uy"))), r(ray[2], 6).alias("uz"))


_AXIS = _qrot_sql("s", ("0", "0", "1"))
_AX = f"(SELECT node_id, path, batch, x, y, z, {_AXIS[0]} AS dx, {_AXIS[1]} AS dy, {_AXIS[2]} AS dz FROM {_Q} s)"


def _axes(spark: SparkSession, d: str) -> DataFrame:
    """Solved images with the direction of their optical axis."""
    axis = camera.rotate(_cols("qx", "qy", "qz", "qw"), (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return solved(spark, d).select("node_id", "batch", "path", "x", "y", "z", *(c.alias(n) for c, n in zip(axis, ("dx", "dy", "dz"))))


@query(
    f"""WITH a AS (SELECT * FROM {_AX}), w AS (SELECT l.edge_id, p.x, p.y, p.z, q.x AS x2, q.y AS y2, q.z AS z2, p.dx, p.dy, p.dz, q.dx AS ex, q.dy AS ey, q.dz AS ez,
    p.x - q.x AS wx, p.y - q.y AS wy, p.z - q.z AS wz FROM {LK} l JOIN a p ON p.node_id = l.src JOIN a q ON q.node_id = l.dst),
  e AS (SELECT *, dx * dx + dy * dy + dz * dz AS a, dx * ex + dy * ey + dz * ez AS b, ex * ex + ey * ey + ez * ez AS c, dx * wx + dy * wy + dz * wz AS d, ex * wx + ey * wy + ez * wz AS e FROM w),
  t AS (SELECT *, (b * e - c * d) / (a * c - b * b) AS s, (a * e - b * d) / (a * c - b * b) AS t FROM e WHERE abs(a * c - b * b) > 1e-4)
  SELECT edge_id, round((x + s * dx + x2 + t * ex) / 2, 2) + 0.0 AS mx, round((y + s * dy + y2 + t * ey) / 2, 2) + 0.0 AS my, round((z + s * dz + z2 + t * ez) / 2, 2) + 0.0 AS mz, s < 0 OR t < 0 AS behind FROM t"""
)
def ray_midpoint(spark: SparkSession, d: str) -> DataFrame:
    """Where the axes of linked images come closest; axes within about half a degree of each other are left out."""
    a = _axes(spark, d)
    p = a.select(F.col("node_id").alias("src"), "x", "y", "z", "dx", "dy", "dz")
    q = a.select(F.col("node_id").alias("dst"), *(F.col(c).alias(n) for c, n in zip(("x", "y", "z", "dx", "dy", "dz"), ("x2", "y2", "z2", "ex", "ey", "ez"))))
    d1, d2 = _cols("dx", "dy", "dz"), _cols("ex", "ey", "ez")
    b = geom.dot(d1, d2)
    e = links(spark, d).join(p, "src").join(q, "dst").filter(F.abs(geom.dot(d1, d1) * geom.dot(d2, d2) - b * b) > 1e-4)
    mid, gap = geom.ray_midpoint(d1, _cols("x", "y", "z"), d2, _cols("x2", "y2", "z2"))
    return e.select("edge_id", *(r(c, 2).alias(n) for c, n in zip(mid, ("mx", "my", "mz"))), (gap < 0).alias("behind"))


@query(
    f"""WITH a AS (SELECT *, x - z / dz * dx AS gx, y - z / dz * dy AS gy FROM {_AX} WHERE abs(dz) > 1e-3), t AS (SELECT *, (100 * (gy + 100) - 200 * (gx + 100)) AS t1, (-200) * (gy + 100) - 0 * (gx - 100) AS q2 FROM a)
  SELECT node_id, round(gx, 3) + 0.0 AS gx, round(gy, 3) + 0.0 AS gy,
    NOT ((s1 < 0 OR s2 < 0 OR s3 < 0) AND (s1 > 0 OR s2 > 0 OR s3 > 0)) AS inside, s1 < 0 AS clockwise
  FROM (SELECT *, 200 * (gy + 100) - 0 * (gx + 100) AS s1, (-100) * (gy + 100) - 200 * (gx - 100) AS s2, (-100) * (gy - 100) - (-200) * (gx - 0) AS s3 FROM a)"""
)
def ground_hits(spark: SparkSession, d: str) -> DataFrame:
    """Where an image's axis meets the ground, and whether that lies in a fixed triangle."""
    zero = F.lit(0.0)
    x, y, _ = geom.ray_plane(_cols("dx", "dy", "dz"), _cols("x", "y", "z"), (zero, zero, F.lit(1.0)), (zero, zero, zero))
    g = _axes(spark, d).filter(F.abs("dz") > 1e-3).withColumns({"gx": x, "gy": y})
    a, b, c = ((F.lit(float(u)), F.lit(float(v))) for u, v in ((-100, -100), (100, -100), (0, 100)))
    p = _cols("gx", "gy")
    return g.select("node_id", r("gx").alias("gx"), r("gy").alias("gy"), geom.in_triangle(p, a, b, c).alias("inside"), geom.clockwise(a, b, p).alias("clockwise"))


_H = [f"h[{k}]" for k in range(1, 10)]


@query(
    _MATCH_SQL
    + f""", m AS (SELECT * FROM ranked WHERE k = 1 AND (second IS NULL OR n < second)),
  c AS (SELECT m.edge_id, l.relation AS h, (m.x1 - 2000) / 4000 AS x, (m.y1 - 1500) / 4000 AS y, (m.x2 - 2000) / 4000 AS u, (m.y2 - 1500) / 4000 AS v FROM m JOIN {LK} l USING (edge_id) WHERE l.relation IS NOT NULL),
  e AS (SELECT edge_id, (h[1] * x + h[2] * y + h[3]) / (h[7] * x + h[8] * y + h[9]) - u AS a, (h[4] * x + h[5] * y + h[6]) / (h[7] * x + h[8] * y + h[9]) - v AS b FROM c)
  SELECT edge_id, count(*) AS matches, count(*) FILTER (WHERE a * a + b * b < 0.25) AS inliers, round(sum(greatest(0, 1 - (a * a + b * b) / 0.25)), 6) AS score FROM e GROUP BY edge_id"""
)
def homography_msac(spark: SparkSession, d: str) -> DataFrame:
    """Inlier score of each link's 3 x 3 relation on its matches, in units of 4000 px."""
    m = _located(spark, d, 1.0).drop("src", "dst").join(links(spark, d, "relation"), "edge_id").filter("relation is not null")
    h = [F.col("relation")[k] for k in range(9)]
    x, y, u, v = ((F.col(c) - o) / 4000 for c, o in (("x1", 2000), ("y1", 1500), ("x2", 2000), ("y2", 1500)))
    w = h[6] * x + h[7] * y + h[8]
    a, b = (h[0] * x + h[1] * y + h[2]) / w - u, (h[3] * x + h[4] * y + h[5]) / w - v
    e2 = a * a + b * b
    return m.withColumn("e2", e2).groupBy("edge_id").agg(F.count("*").alias("matches"), F.count(F.when(F.col("e2") < 0.25, 1)).alias("inliers"), r(F.sum(F.greatest(F.lit(0.0), 1 - F.col("e2") / 0.25)), 6).alias("score"))


@query(
    f"""WITH p AS (SELECT edge_id, unnest(poses) AS p, generate_subscripts(poses, 1) - 1 AS pos FROM {LK} WHERE len(poses) > 0)
  SELECT edge_id, pos, row_number() OVER (PARTITION BY edge_id ORDER BY p.score DESC, pos) AS k, round(1 / (1 + sqrt(pp[1] * pp[1] + pp[2] * pp[2] + pp[3] * pp[3])) * (1 - po[1] * po[1]) * (1 - p.score / 1000.0), 6) AS match_score
  FROM (SELECT edge_id, pos, p, p.position AS pp, p.orientation AS po FROM p)"""
)
def pose_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Relative poses of a link from best to worst, with a score of the match kind."""
    p = links(spark, d, "poses").select("edge_id", F.posexplode("poses").alias("pos", "p"))
    t, q = F.col("p.position"), F.col("p.orientation")
    score = matching.match_score(F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2]), q[0], F.col("p.score") / 1000.0, F.lit(0.0))
    k = F.row_number().over(Window.partitionBy("edge_id").orderBy(F.desc("p.score"), "pos"))
    return p.select("edge_id", F.col("pos").cast("bigint").alias("pos"), k.cast("bigint").alias("k"), r(score, 6).alias("match_score"))


# --- colour, weights, order -------------------------------------------------------------------------------------------------------

_PLACE = f"(SELECT t.node_id, t.idx, t.x, t.y, t.strength, m.pixels_cols AS w, m.pixels_rows AS h FROM {FT} t JOIN (SELECT DISTINCT node_id, model_id FROM images) i USING (node_id) JOIN camera_models m USING (model_id))"
_PLACED = f"(SELECT *, least(greatest(sqrt(dx * dx + dy * dy) / sqrt(2.0), 0), 1) AS radius, least(greatest(dx, -1), 1) AS nx, least(greatest(dy, -1), 1) AS ny FROM (SELECT *, (x - w / 2.0) / (w / 2.0) AS dx, (y - h / 2.0) / (h / 2.0) AS dy FROM {_PLACE}))"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "camera_models").select("model_id", F.col("pixels_cols").alias("w"), F.col("pixels_rows").alias("h"))
    f = features(spark, d, "x", "y", "strength").join(images(spark, d, "model_id"), "node_id").join(m, "model_id")
    return f.withColumns(dict(zip(("radius", "nx", "ny"), spatial.image_place(_cols("x", "y"), F.col("w"), F.col("h")))))


@query(
    f"""SELECT node_id, idx, round(radius, 6) AS radius, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(greatest(least(least(x, y, w - x, h - y) / (w / 2.0), 1), 1e-3) * (1 - 0.5 * least(radius, 1)) / (1 + radius * radius), 6) AS weight,
  round(2 / (1 + exp(ln(99.0) / 64 * (idx % 64))), 6) AS falloff FROM {_PLACED}"""
)
def blend_weights(spark: SparkSession, d: str) -> DataFrame:
    """Blend weights at the features' places."""
    w = spatial.blend_weight(_cols("x", "y"), F.col("w"), F.col("h"), F.col("radius"))
    return _placed(spark, d).select("node_id", "idx", r("radius", 6).alias("radius"), r("nx", 6).alias("nx"), r("ny", 6).alias("ny"), r(w, 6).alias("weight"), r(spatial.boundary_falloff(F.col("idx") % 64), 6).alias("falloff"))


@query(
    f"""SELECT node_id, idx, round(least(greatest(l - (2.0 + 8 * r2 - 3 * r2 * r2 + r2 * r2 * r2 + 1.5 * radius * radius + 4 * nx - 2 * ny), 0), 100), 5) AS l, round(least(greatest(l / 10 - 1.0, -127), 127), 5) + 0.0 AS a, round(least(greatest(0.5 - l / 20, -127), 127), 5) + 0.0 AS b
  FROM (SELECT *, radius * radius AS r2, CAST(40 + idx % 50 AS DOUBLE) AS l FROM {_PLACED})"""
)
def radiometric_correct(spark: SparkSession, d: str) -> DataFrame:
    """The radiometric model at the features' places with fixed parameters."""
    light = (40 + F.col("idx") % 50).cast("double")
    n = lambda *v: tuple(F.lit(float(x)) for x in v)
    lab = radiometry.correct((light, light / 10, -light / 20), n(2, 1, -0.5), n(8, -3, 1), F.lit(1.5), n(4, -2), F.col("radius"), F.col("radius"), F.col("nx"), F.col("ny"))
    return _placed(spark, d).select("node_id", "idx", *(r(c, 5).alias(k) for c, k in zip(lab, ("l", "a", "b"))))


def _lab_sql() -> str:
    lin = lambda c: f"CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END"
    xyz = ", ".join(f"({row[0]} * r + {row[1]} * g + {row[2]} * b) / {w} AS {n}" for row, w, n in zip(radiometry._XYZ, radiometry._WHITE, ("x", "y", "z")))
    f = lambda t: f"CASE WHEN {t} > 0.008856 THEN pow({t}, {1 / 3}) ELSE 7.787 * {t} + {16 / 116} END"
    return f"""WITH c AS (SELECT node_id, idx, CAST(floor(x) AS BIGINT) % 256 AS b, CAST(floor(y) AS BIGINT) % 256 AS g, (idx * 7) % 256 AS r FROM {FT}),
  l AS (SELECT node_id, idx, {lin("b")} AS b, {lin("g")} AS g, {lin("r")} AS r FROM c), t AS (SELECT node_id, idx, {xyz} FROM l)
  SELECT node_id, idx, round(CASE WHEN y > 0.008856 THEN 116 * pow(y, {1 / 3}) - 16 ELSE 903.3 * y END, 5) AS l, round(500 * ({f("x")} - {f("y")}), 5) + 0.0 AS a, round(200 * ({f("y")} - {f("z")}), 5) + 0.0 AS b FROM t"""


@query(_lab_sql())
def bgr_to_lab(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d, "x", "y").filter("x is not null and y is not null")
    lab = radiometry.bgr_to_lab(F.floor("x") % 256, F.floor("y") % 256, (F.col("idx") * 7) % 256)
    return f.select("node_id", "idx", *(r(c, 5).alias(n) for c, n in zip(lab, "lab")))


def _hilbert_sql(order: int) -> str:
    steps = ["h0 AS (SELECT node_id, idx, CAST(floor(x / 32) AS BIGINT) AS x, CAST(floor(y / 32) AS BIGINT) AS y, CAST(0 AS BIGINT) AS d FROM " + FT + ")"]
    for k in range(order):
        s = 2 ** (order - 1 - k)
        steps.append(f"r{k} AS (SELECT *, CAST((x & {s}) > 0 AS BIGINT) AS rx, CAST((y & {s}) > 0 AS BIGINT) AS ry FROM h{k})")
        fx, fy = (f"CASE WHEN ry = 0 AND rx = 1 THEN {2**order - 1} - {c} ELSE {c} END" for c in "xy")
        steps.append(f"h{k + 1} AS (SELECT node_id, idx, CASE WHEN ry = 0 THEN {fy} ELSE {fx} END AS x, CASE WHEN ry = 0 THEN {fx} ELSE {fy} END AS y, d + {s * s} * xor(3 * rx, ry) AS d FROM r{k})")
    return "WITH " + ", ".join(steps) + f" SELECT node_id, idx, d AS hilbert FROM h{order}"


@query(_hilbert_sql(8))
def hilbert_index(spark: SparkSession, d: str) -> DataFrame:
    """Place of features on the Hilbert curve of 32 px cells."""
    return features(spark, d, "x", "y").select("node_id", "idx", spatial.hilbert(F.floor(F.col("x") / 32), F.floor(F.col("y") / 32), 8).alias("hilbert"))


# --- frames, statistics, graphs ---------------------------------------------------------------------------------------------------


def _tm_sql() -> str:
    e, a = geo._E, geo._A

    def north(lat: str) -> str:
        xi = f"atan(sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat})))))"
        return f"{a!r} * ({xi} + " + " + ".join(f"{c!r} * sin({2 * k} * {xi})" for k, c in enumerate(geo._ALPHA, 1)) + ")"

    east_n = " + ".join(f"{c!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in enumerate(geo._ALPHA, 1))
    north_n = " + ".join(f"{c!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in enumerate(geo._ALPHA, 1))
    return f"""WITH i AS (SELECT node_id, batch, path, capture_info.latitude AS lat, capture_info.longitude AS lon FROM {IM}), v AS (SELECT * FROM i WHERE abs(lat) < 89 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)),
  o AS (SELECT batch, arg_min(lat, path) AS lat0, arg_min(lon, path) AS lon0 FROM v GROUP BY batch),
  t AS (SELECT node_id, lat0, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t, radians(lon - lon0) AS dl FROM v JOIN o USING (batch) WHERE abs(lat - lat0) < 0.5 AND abs(lon - lon0) < 0.5),
  x AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)
  SELECT node_id, round({a!r} * (eta + {east_n}), 3) + 0.0 AS east, round({a!r} * (xi + {north_n}) - {north("lat0")}, 3) + 0.0 AS north FROM x"""


@query(_tm_sql())
def local_tm(spark: SparkSession, d: str) -> DataFrame:
    """Places in the frame of the batch's first image, within half a degree of it."""
    c = F.col("capture_info")
    v = images(spark, d, "batch", "path", c["latitude"].alias("lat"), c["longitude"].alias("lon"))
    v = v.filter("abs(lat) < 89 and abs(lon) <= 180 and not (lat = 0 and lon = 0)")
    o = v.groupBy("batch").agg(F.min_by(F.struct("lat", "lon"), "path").alias("o")).select("batch", F.col("o.lat").alias("lat0"), F.col("o.lon").alias("lon0"))
    near = v.join(o, "batch").filter("abs(lat - lat0) < 0.5 and abs(lon - lon0) < 0.5")
    east, north = geo.to_local(*_cols("lat", "lon", "lat0", "lon0"))
    return near.select("node_id", r(east).alias("east"), r(north).alias("north"))


_ALT = f"(SELECT capture_info.altitude AS v FROM {IM} WHERE capture_info.altitude IS NOT NULL AND NOT isnan(capture_info.altitude))"


def _bounds_sql(source: str) -> str:
    return f"""(SELECT lo + (hi - lo) - 2 * (hi - lo) AS low, lo + (hi - lo) + 2 * (hi - lo) AS high FROM (SELECT min(v) FILTER (WHERE up > total * 0.025) AS lo, max(v) FILTER (WHERE down > total * 0.025) AS hi FROM
  (SELECT v, sum(n) OVER (ORDER BY v) AS up, sum(n) OVER (ORDER BY v DESC) AS down, sum(n) OVER () AS total FROM (SELECT CAST(trunc(v) AS BIGINT) AS v, count(*) AS n FROM {source} GROUP BY 1))))"""


@query(f"SELECT CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM {_bounds_sql(_ALT)}")
def histogram_bounds(spark: SparkSession, d: str) -> DataFrame:
    a = images(spark, d, F.col("capture_info.altitude").alias("v")).filter("not isnan(v)")
    return tables.histogram_bounds(a, "v").select(F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))


@query(f"SELECT p.node_id, p.x, p.y, p.z FROM {POS} p, {_bounds_sql('(SELECT x AS v FROM ' + POS + ')')} a, {_bounds_sql('(SELECT y AS v FROM ' + POS + ')')} b WHERE p.x > a.low AND p.x < a.high AND p.y > b.low AND p.y < b.high")
def xyz_in_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Places inside the trimmed bounds of both axes."""
    p = positions(spark, d)
    bounds = [F.broadcast(tables.histogram_bounds(p, c).select(F.col("low").alias(f"{c}l"), F.col("high").alias(f"{c}h"))) for c in "xy"]
    return p.join(bounds[0]).join(bounds[1]).filter("x > xl and x < xh and y > yl and y < yh").select("node_id", "x", "y", "z")


_TILT = 0.1, 0.05  # of the mesh's plane
_FALL = (1 + _TILT[0] ** 2 + _TILT[1] ** 2) ** 0.5


@query(
    f"""SELECT cx, cy, half, count(*) AS n, round(avg(g), 6) + 0.0 AS mean, CASE WHEN count(*) > 1 THEN round(greatest(avg(g * g) - avg(g) * avg(g), 0), 3) ELSE 0.0 END AS variance FROM
  (SELECT CAST(floor(x / 50) AS BIGINT) AS cx, CAST(floor(y / 50) AS BIGINT) AS cy, CAST((x / 50 - floor(x / 50)) + (y / 50 - floor(y / 50)) > 1 AS INT) AS half, (z - 100 - {_TILT[0]} * x - {_TILT[1]} * y) / {_FALL} AS g FROM {POS}) GROUP BY ALL"""
)
def cell_plane_stats(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean and population variance of the images' distances from the plane of the triangle they lie in, on a regular mesh over all images."""
    p = positions(spark, d)
    g = _grid(spark, p, 50.0, 50.0)
    low = [("a", 0, 0), ("b", 1, 0), ("c", 0, 1)], [("a", 1, 1), ("b", 0, 1), ("c", 1, 0)]
    z = lambda u, v: F.lit(100.0) + _TILT[0] * u + _TILT[1] * v
    halves = []
    for half, corners in enumerate(low):
        at = {n: (F.col("px") + 50.0 * u, F.col("py") + 50.0 * v) for n, u, v in corners}
        cols = [c for n, (u, v) in at.items() for c in (u.alias(f"{n}x"), v.alias(f"{n}y"), z(u, v).alias(f"{n}z"))]
        halves.append(F.struct((2 * F.col("p") + half).alias("t"), *cols))
    corners = g.select(F.explode(F.array(*halves)).alias("c")).select("c.*")
    found = mesh.triangle_counts(p.select("x", "y", "z"), corners, 50.0)
    at = g.select("p", F.col("col").alias("cx"), F.col("row").alias("cy"))
    out = found.withColumns({"p": F.floor(F.col("t") / 2), "half": (F.col("t") % 2).cast("int")}).join(at, "p")
    return out.select("cx", "cy", "half", "n", (r("mean", 6) + 0.0).alias("mean"), F.when(F.col("n") > 1, r("variance")).otherwise(F.lit(0.0)).alias("variance"))


@query(
    f"""WITH v AS (SELECT batch AS s, CAST(floor(x / 25) AS BIGINT) AS cx, CAST(floor(y / 25) AS BIGINT) AS cy, avg(z) AS h, CASE WHEN batch % 3 = 0 THEN 0 ELSE count(*) END AS w FROM {POS} GROUP BY batch, CAST(floor(x / 25) AS BIGINT), CAST(floor(y / 25) AS BIGINT))
  SELECT cx, cy, round(CASE WHEN sum(w) > 0 THEN sum(h * w) / sum(w) ELSE arg_min(h, s) END, 6) AS z FROM v GROUP BY cx, cy"""
)
def weighted_merge(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces of the batches merged: a vertex has the mean of what they say, weighted by their images around it, or what the first says where none has weight."""
    cx, cy = spatial.cell(F.col("x"), F.col("y"), 25.0)
    v = positions(spark, d).groupBy(F.col("batch").alias("surface_id"), cx.alias("cx"), cy.alias("cy")).agg(F.avg("z").alias("z"), F.count("*").alias("n"))
    v = v.select("surface_id", F.struct("cx", "cy").alias("node_id"), (25.0 * F.col("cx")).alias("x"), (25.0 * F.col("cy")).alias("y"), "z", F.when(F.col("surface_id") % 3 == 0, 0).otherwise(F.col("n")).alias("weight"))
    return mesh.merge_surfaces(v).select("node_id.cx", "node_id.cy", r("z", 6).alias("z"))


@query(f"SELECT batch, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round(avg(z), 9) AS mean_z, count(*) AS n FROM {POS} GROUP BY batch")
def bounds_mean_z(spark: SparkSession, d: str) -> DataFrame:
    e = [f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))]
    return positions(spark, d).groupBy("batch").agg(*e, r(F.avg("z"), 9).alias("mean_z"), F.count("*").alias("n"))


@query(
    f"""WITH m AS (SELECT batch, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM {POS} GROUP BY batch),
  s AS (SELECT batch, mx, my, mz, count(*) AS n, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy, sum((y - my) * (y - my)) AS yy, sum((x - mx) * (z - mz)) AS xz, sum((y - my) * (z - mz)) AS yz FROM {POS} JOIN m USING (batch) GROUP BY ALL),
  c AS (SELECT *, CASE WHEN n >= 3 AND abs(xx * yy - xy * xy) > 1e-12 THEN (xz * yy - yz * xy) / (xx * yy - xy * xy) END AS c1, CASE WHEN n >= 3 AND abs(xx * yy - xy * xy) > 1e-12 THEN (yz * xx - xz * xy) / (xx * yy - xy * xy) END AS c2 FROM s)
  SELECT batch, round(mz - c1 * mx - c2 * my, 4) AS c0, round(c1, 6) + 0.0 AS c1, round(c2, 6) + 0.0 AS c2, n FROM c"""
)
def plane_detrend(spark: SparkSession, d: str) -> DataFrame:
    """Plane through each batch's camera places."""
    f = tables.plane_fit(positions(spark, d), ["batch"], *_cols("x", "y", "z"))
    return f.select("batch", r("c0", 4).alias("c0"), r("c1", 6).alias("c1"), r("c2", 6).alias("c2"), "n")


@query(f"SELECT batch, round(avg(1 / f), 12) AS arc, round(avg(z), 9) AS mean_z, round(greatest(avg(1 / f) * abs(avg(z)), 1e-3), 9) AS gsd, sum(CAST(w_px AS BIGINT) * h_px) AS pixels, round(avg(greatest(w_px, h_px)), 6) AS size FROM {_Q} GROUP BY batch")
def fleet_stats(spark: SparkSession, d: str) -> DataFrame:
    """Ground resolution and image sizes of each batch's solved images over height 0."""
    s = solved(spark, d)
    arc, z = F.avg(ortho.pixel_arc(F.col("focal"))), F.avg("z")
    return s.groupBy("batch").agg(r(arc, 12).alias("arc"), r(z, 9).alias("mean_z"), r(F.greatest(arc * F.abs(z), F.lit(ortho.LEAST_GSD)), 9).alias("gsd"), F.sum(F.col("w_px").cast("bigint") * F.col("h_px")).alias("pixels"), r(F.avg(F.greatest("w_px", "h_px")), 6).alias("size"))


@query(
    f"""WITH d AS (SELECT a.node_id, a.idx AS p, b.idx AS q, CAST({_BITS_SQL} AS BIGINT) AS n FROM {FT} a JOIN {FT} b ON a.node_id = b.node_id AND a.idx <> b.idx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 150 * 150 WHERE a.descriptor IS NOT NULL AND b.descriptor IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY node_id, p ORDER BY n, q) AS k, lead(n) OVER (PARTITION BY node_id, p ORDER BY n, q) AS second FROM d) SELECT node_id, p, q, n AS bits FROM k WHERE k = 1 AND CASE WHEN second IS NULL THEN n / 486.0 < 0.49 ELSE n < 0.98 * second END"""
)
def guided_matches(spark: SparkSession, d: str) -> DataFrame:
    """The most similar feature within 150 px of each feature of an image, if it stands out."""
    f = features(spark, d, "x", "y", "descriptor").filter("descriptor is not null")
    a = f.select(F.col("node_id").alias("image"), F.col("idx").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("descriptor").alias("dp"))
    b = f.select(F.col("node_id").alias("image"), F.col("idx").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("descriptor").alias("dq"))
    near = F.when(F.col("p") != F.col("q"), bits.hamming(F.col("dp"), F.col("dq")) / F.lit(float(matching.BITS)))
    m = tracks.guided_matches(a, b, near, 150.0, 0.98, 0.49)
    return m.select(F.col("image").alias("node_id"), "p", "q", F.round(F.col("distance") * matching.BITS).cast("bigint").alias("bits"))


@query(f"SELECT node AS node_id, count(*) AS n, round(0.1 * sqrt(greatest(1, count(*))), 6) AS prior FROM (SELECT src AS node FROM {LK} UNION ALL SELECT dst FROM {LK}) GROUP BY node")
def pair_counts_prior(spark: SparkSession, d: str) -> DataFrame:
    """How many links an image has at either end, and the weight of its prior."""
    g = graph.degrees(links(spark, d), "src", "dst")
    return g.select(F.col("node").alias("node_id"), F.col("degree").alias("n"), r(0.1 * F.sqrt(F.greatest(F.lit(1), F.col("degree"))), 6).alias("prior"))


@query(f"WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {LK} UNION SELECT dst, src FROM {LK}), r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY node")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(links(spark, d), "src", "dst")


@query(f"WITH e AS (SELECT src AS a, dst AS b FROM {LK} UNION SELECT dst, src FROM {LK}), s AS (SELECT node_id AS n FROM {IM} WHERE batch % 7 = 0), h1 AS (SELECT n FROM s UNION SELECT b FROM e JOIN s ON a = n) SELECT DISTINCT n AS node FROM (SELECT n FROM h1 UNION SELECT b FROM e JOIN h1 ON a = n)")
def within_two_hops(spark: SparkSession, d: str) -> DataFrame:
    """Images at most two links from those of every seventh batch."""
    start = images(spark, d, "batch").filter("batch % 7 = 0").select(F.col("node_id").alias("node"))
    return graph.within_hops(links(spark, d), "src", "dst", start, 2)


@query(
    f"WITH i AS (SELECT * FROM {POS}), k AS (SELECT p.node_id AS a, q.node_id AS b, row_number() OVER (PARTITION BY p.node_id ORDER BY {_D2}, q.node_id) AS k FROM i p JOIN i q ON q.batch = p.batch AND q.node_id <> p.node_id) SELECT DISTINCT l.edge_id FROM {LK} l JOIN k ON k.k <= 10 AND ((k.a = l.src AND k.b = l.dst) OR (k.a = l.dst AND k.b = l.src))"
)
def ideal_links(spark: SparkSession, d: str) -> DataFrame:
    """Links whose far end is among the ten nearest of the batch, from either end."""
    p = positions(spark, d)
    probes, points = _probes(p).withColumnRenamed("p_batch", "batch"), _points(p).withColumnRenamed("q_batch", "batch")
    near = neighbours.knn_join(probes, points, 11, on=("batch",)).filter("p <> q")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("p").orderBy("d2", "q"))).filter("rank <= 10").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    return links(spark, d).withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(near, ["a", "b"], "left_semi").select("edge_id")


@query(
    f"""SELECT DISTINCT f[1] AS a, f[2] AS b, f[3] AS c FROM (SELECT list_sort([src, dst, third]) AS f FROM (SELECT src, dst, lead(dst) OVER (PARTITION BY src ORDER BY edge_id) AS third FROM {LK}) WHERE third IS NOT NULL AND third <> dst)"""
)
def faces_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Triples of an image and two of its links' ends, each once whatever the order."""
    third = F.lead("dst").over(Window.partitionBy("src").orderBy("edge_id"))
    f = links(spark, d).withColumn("third", third).filter("third is not null and third <> dst").select(F.array_sort(F.array("src", "dst", "third")).alias("f"))
    return f.select(*(F.col("f")[k].alias(n) for k, n in enumerate("abc"))).distinct()


_MICROS = "CAST(epoch_us(ts) AS BIGINT)"


@query(
    f"""WITH x AS (SELECT event_type AS key, {_MICROS} AS s, {_MICROS} + CAST(round(value * 1000000) AS BIGINT) AS e FROM events WHERE value > 0),
  m AS (SELECT key, t, sum(d) AS d FROM (SELECT key, s AS t, 1 AS d FROM x UNION ALL SELECT key, e, -1 FROM x) GROUP BY ALL),
  u AS (SELECT key, t, sum(d) OVER (PARTITION BY key ORDER BY t) AS run FROM m), w AS (SELECT *, coalesce(lag(run) OVER (PARTITION BY key ORDER BY t), 0) AS was FROM u),
  n AS (SELECT key, t, CASE WHEN run > 0 THEN 1 ELSE 0 END - CASE WHEN was > 0 THEN 1 ELSE 0 END AS turn FROM w), g AS (SELECT t, sum(turn) AS turn FROM n WHERE turn <> 0 GROUP BY t),
  h AS (SELECT t, sum(turn) OVER (ORDER BY t) AS n, lead(t) OVER (ORDER BY t) - t AS step FROM g), a AS (SELECT t, CASE WHEN n > 0 THEN coalesce(step, 0) / n ELSE 0 END AS part FROM h),
  z AS (SELECT t, sum(part) OVER (ORDER BY t) - part AS area FROM a)
  SELECT n.key AS event_type, round(any_value(q.total) / 1e6, 3) AS total, round(sum(-n.turn * z.area) / 1e6, 2) AS weighted FROM n JOIN z USING (t) JOIN (SELECT key, sum(e - s) AS total FROM x GROUP BY key) q ON q.key = n.key WHERE n.turn <> 0 GROUP BY n.key"""
)
def sweep_concurrency(spark: SparkSession, d: str) -> DataFrame:
    """Running time of event types, and with each stretch shared among the types that run in it. Intervals are cut at full hours."""
    hour = 3_600_000_000
    # The column has no zone and means UTC.
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    x = read(spark, d, "events").filter("value > 0").select("event_type", start.alias("s"), (start + F.round(F.col("value") * 1_000_000).cast("bigint")).alias("e"))
    x = x.withColumn("hour", F.explode(F.sequence(F.floor(F.col("s") / hour), F.floor((F.col("e") - 1) / hour))))
    out = tables.concurrency(x, "event_type", F.greatest("s", F.col("hour") * hour), F.least("e", (F.col("hour") + 1) * hour), "hour")
    return out.select(F.col("key").alias("event_type"), r(F.col("total") / 1e6).alias("total"), r(F.col("weighted") / 1e6, 2).alias("weighted"))


@query(
    f"""WITH p AS (SELECT node_id, CAST(floor(y / 32) AS BIGINT) AS r, CAST(floor(x / 32) AS BIGINT) AS c, CAST(strength AS DOUBLE) AS v FROM {FT} WHERE strength IS NOT NULL), l AS (SELECT r, c, avg(v) AS v FROM p GROUP BY ALL)
  SELECT f AS factor, CAST(floor(r / f) AS BIGINT) AS r, CAST(floor(c / f) AS BIGINT) AS c, round(avg(v), 8) AS v FROM l, (SELECT unnest([2, 4, 8]) AS f) GROUP BY ALL"""
)
def overview_pyramid(spark: SparkSession, d: str) -> DataFrame:
    """Mean pyramid of a raster of feature strengths."""
    cx, cy = spatial.cell(F.col("x"), F.col("y"), 32.0)
    base = features(spark, d, "x", "y", "strength").filter("strength is not null").groupBy(cy.alias("r"), cx.alias("c")).agg(F.avg(F.col("strength").cast("double")).alias("v"))
    out = None
    for f in (2, 4, 8):
        level = tables.overview(base, "r", "c", "v", f).select(F.lit(f).alias("factor"), "r", "c", r("v", 8).alias("v"))
        out = level if out is None else out.unionByName(level)
    return out


@query(
    f"""WITH i AS (SELECT * FROM {POS}) SELECT 'Point' AS kind, node_id AS id, path, CAST(NULL AS BIGINT) AS source, CAST(NULL AS BIGINT) AS dest, x, y, CAST(NULL AS DOUBLE) AS x2, CAST(NULL AS DOUBLE) AS y2, CAST(NULL AS BIGINT) AS inliers FROM i
  UNION ALL SELECT 'LineString', edge_id, NULL, src, dst, a.x, a.y, b.x, b.y, coalesce(len(poses), 0) FROM {LK} l JOIN i a ON a.node_id = src JOIN i b ON b.node_id = dst"""
)
def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    """The rows behind the GeoJSON sink: a point for each node, a line for each link."""
    from terraloom.sources.graph_json import feature_rows

    poses = F.when(F.col("poses").isNotNull(), F.size("poses")).otherwise(0).alias("inliers")  # the tables hold no inliers; poses stand in
    return feature_rows(positions(spark, d), links(spark, d, "poses").select("edge_id", "src", "dst", poses))


_SEEDS = [(-100.0, -100.0), (100.0, -100.0), (-100.0, 100.0), (100.0, 100.0)]


@query(
    f"""WITH i AS (SELECT * FROM {POS}), s(c, cx, cy) AS (VALUES {", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(_SEEDS))}),
  a1 AS (SELECT node_id, x, y, arg_min(c, ((x - cx) * (x - cx) + (y - cy) * (y - cy), c)) AS c FROM i, s GROUP BY ALL), s1 AS (SELECT c, avg(x) AS cx, avg(y) AS cy FROM a1 GROUP BY c),
  a2 AS (SELECT node_id, x, y, arg_min(c, ((x - cx) * (x - cx) + (y - cy) * (y - cy), c)) AS c FROM i, s1 GROUP BY ALL) SELECT c AS cluster, count(*) AS n, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy FROM a2 GROUP BY c"""
)
def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    """Two Lloyd steps from fixed seeds."""
    from terraloom.operators.clusters import lloyd

    return lloyd(positions(spark, d), ["x", "y"], _SEEDS, 2).select("cluster", "n", *(r(c, 6).alias(c) for c in ("cx", "cy")))


@query(f"WITH b AS (SELECT batch, count(*) AS weight FROM {IM} GROUP BY batch) SELECT batch, weight, round(sum(weight) OVER (ORDER BY batch) / sum(weight) OVER (), 9) AS done FROM b")
def progress_weights(spark: SparkSession, d: str) -> DataFrame:
    """Share of all images that is done after each batch."""
    b = images(spark, d, "batch").groupBy("batch").agg(F.count("*").alias("weight"))
    total = F.broadcast(b.agg(F.sum("weight").alias("all")))
    return tables.running_sum(b, ["batch"], F.col("weight"), "sum").join(total).select("batch", "weight", r(F.col("sum") / F.col("all"), 9).alias("done"))


@query(
    f"""WITH l AS (SELECT 0 AS list, node_id AS id FROM {POS} UNION ALL SELECT 1, edge_id FROM {LK} UNION ALL SELECT 2, model_id FROM camera_models),
  n AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY list) AS n FROM l) SELECT list, id, pos, round(pos / n, 9) AS at FROM n"""
)
def interleave_lists(spark: SparkSession, d: str) -> DataFrame:
    """Images, links and models spread evenly over one order: by the share of its list that stands before a row."""
    lists = [positions(spark, d).select(F.col("node_id").alias("id")), links(spark, d).select(F.col("edge_id").alias("id")), read(spark, d, "camera_models").select(F.col("model_id").alias("id"))]
    return tables.spread_evenly(lists, ["id"]).select("list", "id", "pos", r("at", 9).alias("at"))


@query("SELECT n_name AS name, 0 AS list, row_number() OVER (ORDER BY n_name) - 1 AS pos FROM nation UNION ALL SELECT r_name, 1, row_number() OVER (ORDER BY r_name) - 1 FROM region")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Two lists by turns."""
    lists = [read(spark, d, t).select(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"))]
    return tables.round_robin(lists, ["name"]).select("name", "list", F.col("pos").cast("bigint").alias("pos")).orderBy("pos", "list")


@query(
    f"SELECT 'images' AS part, node_id AS id, CAST(batch AS BIGINT) AS ref, round(x, 6) AS v FROM {POS} UNION ALL SELECT 'links', edge_id, src, CAST(len(poses) AS DOUBLE) FROM {LK} "
    f"UNION ALL SELECT 'models', model_id, CAST(pixels_cols AS BIGINT), round(focal, 6) FROM camera_models UNION ALL SELECT 'features', node_id, CAST(idx AS BIGINT), round(x, 6) FROM {FT}"
)
def checkpoint_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a state after a checkpoint was written and read again."""
    from terraloom.plans.checkpoint import load, save
    from terraloom.runtime import checkpoint_root

    state = {"images": positions(spark, d), "links": links(spark, d, "poses"), "models": read(spark, d, "camera_models"), "features": features(spark, d, "x", "y", "strength", "descriptor")}
    t = load(spark, save(f"{checkpoint_root(spark)}/terraloom/state", state, "complete")).tables
    pick = lambda name, i, ref, v: t[name].select(F.lit(name).alias("part"), F.col(i).alias("id"), F.col(ref).cast("bigint").alias("ref"), v.cast("double").alias("v"))
    out = pick("images", "node_id", "batch", r("x", 6)).unionByName(pick("links", "edge_id", "src", F.when(F.col("poses").isNotNull(), F.size("poses"))))
    return out.unionByName(pick("models", "model_id", "pixels_cols", r("focal", 6))).unionByName(pick("features", "node_id", "idx", r("x", 6)))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
