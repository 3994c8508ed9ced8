"""Queries of the general data-preparation problems, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators import nested, readings, regions, timestamps
from terraloom.runtime import materialise, read

READINGS = [
    readings.Reading("altitude", -500.0, 12_000.0),
    readings.Reading("yaw", -360.0, 360.0, period=180.0),  # half a turn is flying the line back
    readings.Reading("accuracy_xy", 0.0, None, low_open=True),
]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    info = F.col("capture_info")
    images = read(spark, d, "images").select("node_id", info["timestamp"].alias("text"), info["datestamp"].alias("date"), "site_id")
    zoned = images.join(read(spark, d, "sites").select("site_id", "tz").dropDuplicates(["site_id"]), "site_id", "left")
    return timestamps.normalise_timestamps(zoned, "node_id", F.col("text"), F.col("date"), F.col("tz"))


def p3_masks(spark: SparkSession, d: str) -> DataFrame:
    """Inventory of shape masks with their number of images."""
    images = read(spark, d, "images").groupBy("node_id").agg(F.min("capture_info.timestamp").alias("text"))
    return images.groupBy(timestamps.shape_mask(F.col("text")).alias("mask")).agg(F.count("*").alias("images"))


def _values() -> dict:
    return {r.name: F.col("capture_info")[r.name] for r in READINGS}


def p5_method(spark: SparkSession, d: str) -> DataFrame:
    """The whole method: limits, spikes and stuck values, and fences by the hour of capture."""
    fences = p5_fences(spark, d).select("node_id", "field", F.lit("fence").alias("reason"))
    return p5_reasons(spark, d).unionByName(fences)


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    out = readings.implausible(read(spark, d, "images"), "node_id", "batch", "path", READINGS, _values())
    return out.select(F.col("key").alias("node_id"), "field", "reason")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_reasons(spark, d).select("node_id", "field").distinct()


def p5_fences(spark: SparkSession, d: str) -> DataFrame:
    """Readings outside the fences of their batch in the same hour of capture (UTC; images without an instant are a context of their own)."""
    hour = F.pmod(F.floor(F.col("utc_micros") / 3_600_000_000), F.lit(24)).cast("int")
    rows = read(spark, d, "images").join(p3_found(spark, d), "node_id", "left")
    out = readings.hourly_fences(rows, "node_id", "batch", hour, READINGS, _values())
    return out.withColumnsRenamed({"key": "node_id", "source": "batch"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("capture_info")
    points = read(spark, d, "images").select("node_id", *(c[n].alias(n) for n in ("latitude", "longitude", "altitude")))
    return regions.points_nearby(points, "node_id", "latitude", "longitude", "altitude", 5.0, 10.0)


SIDE = 0.002  # degrees


def _parcels(places: DataFrame) -> DataFrame:
    """(region, ring): two parcels, a concave and a square one with shared edges, for each cell of SIDE that holds a place."""
    i, j = F.floor(F.col("x") / SIDE), F.floor(F.col("y") / SIDE)
    cells = places.select(i.alias("i"), j.alias("j")).distinct()
    at = lambda u, v: F.array((F.col("i") + u) * SIDE, (F.col("j") + v) * SIDE)
    ring = lambda *corners: F.array(*(at(u, v) for u, v in corners))
    both = F.array(
        F.struct(F.lit("angle").alias("part"), ring((0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0)).alias("ring")),
        F.struct(F.lit("corner").alias("part"), ring((0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0)).alias("ring")),
    )
    return cells.select("i", "j", F.explode(both).alias("p")).select(F.concat_ws(":", "i", "j", "p.part").alias("region"), "p.ring")


def p6_regions(spark: SparkSession, d: str) -> DataFrame:
    """The parcels that contain each image's place, those on a shared edge in both."""
    c = F.col("capture_info")
    points = read(spark, d, "images").select("node_id", *(c[n].alias(n) for n in ("latitude", "longitude", "altitude")))
    places = materialise(regions.usable_places(points, "node_id", "latitude", "longitude", "altitude"))
    out = regions.regions_of_points(places, "key", "x", "y", _parcels(places), "region", "ring")
    return out.withColumnRenamed("key", "node_id")


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    return nested.shred(read(spark, d, "graph_docs"), "graph_id", "body", frozenset({"features"}))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.graph_features(_occurrences(spark, d))


def p7_objects(spark: SparkSession, d: str) -> DataFrame:
    """Distinct subtrees with how often each occurs, by member name."""
    objects, bridge = nested.tables(_occurrences(spark, d))
    return bridge.groupBy("member").agg(F.count("*").alias("occurrences"), F.countDistinct("child_hash").alias("objects"))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_masks, p5_method, p5_found, p5_reasons, p5_fences, p6_found, p6_regions, p7_found, p7_objects)}


_P6 = """WITH p AS (SELECT DISTINCT node_id, capture_info.latitude AS la, capture_info.longitude AS lo, capture_info.altitude AS z FROM images
    WHERE abs(capture_info.latitude) <= 90 AND NOT isnan(capture_info.longitude) AND NOT isnan(capture_info.altitude) AND NOT (capture_info.latitude = 0 AND capture_info.longitude = 0)),
  pairs AS (SELECT a.node_id AS node_a, b.node_id AS node_b, a.la AS la1, a.lo AS lo1, b.la AS la2, b.lo AS lo2 FROM p a JOIN p b ON b.la BETWEEN a.la - 0.0001 AND a.la + 0.0001 AND a.node_id < b.node_id AND abs(a.z - b.z) <= 10)
  SELECT node_a, node_b FROM pairs WHERE 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(la2 - la1) / 2), 2) + cos(radians(la1)) * cos(radians(la2)) * pow(sin(radians(lo2 - lo1) / 2), 2)))) <= 5"""
_P6_REGIONS = f"""WITH p AS (SELECT DISTINCT node_id, (capture_info.longitude + 180) % 360 - 180 AS x, capture_info.latitude AS y FROM images WHERE abs(capture_info.latitude) <= 90 AND abs(capture_info.longitude) < 1e6
    AND NOT isnan(capture_info.altitude) AND capture_info.altitude IS NOT NULL AND NOT (capture_info.latitude = 0 AND capture_info.longitude = 0)),
  c AS (SELECT DISTINCT CAST(floor(x / {SIDE}) AS BIGINT) AS i, CAST(floor(y / {SIDE}) AS BIGINT) AS j FROM p),
  n AS (SELECT node_id, x, y, i, j FROM (SELECT *, CAST(floor(x / {SIDE}) AS BIGINT) + unnest([-1, 0, 1]) AS i, CAST(floor(y / {SIDE}) AS BIGINT) AS j0 FROM p), (SELECT unnest([-1, 0, 1]) AS dj) t, LATERAL (SELECT j0 + dj AS j) u),
  h AS (SELECT n.*, x >= i * {SIDE} AND x <= (i + 1.0) * {SIDE} AND y >= j * {SIDE} AND y <= (j + 1.0) * {SIDE} AS inside, x >= (i + 0.5) * {SIDE} AS right_half, y >= (j + 0.5) * {SIDE} AS upper_half, x > (i + 0.5) * {SIDE} AND y > (j + 0.5) * {SIDE} AS open_corner FROM n JOIN c USING (i, j))
  SELECT node_id, concat_ws(':', i, j, 'angle') AS region FROM h WHERE inside AND NOT open_corner UNION ALL SELECT node_id, concat_ws(':', i, j, 'corner') AS region FROM h WHERE inside AND right_half AND upper_half"""
_P7 = """WITH b AS (SELECT DISTINCT graph_id, ltrim(body, chr(65279)) AS t FROM graph_docs WHERE body IS NOT NULL), j AS (SELECT graph_id, CAST(t AS JSON) AS j FROM b WHERE json_valid(t)),
  n AS (SELECT graph_id, coalesce(j -> '$.graph.nodes', j -> '$.nodes') AS n FROM j),
  e AS (SELECT graph_id, json_type(n) AS kind, unnest(CASE json_type(n) WHEN 'OBJECT' THEN json_keys(n) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(n) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) ELSE [] END) AS k, n FROM n),
  v AS (SELECT graph_id, CASE kind WHEN 'OBJECT' THEN k ELSE n ->> ('$[' || k || '].id') END AS node_id, CASE kind WHEN 'OBJECT' THEN n -> ('$."' || k || '"') ELSE n -> ('$[' || k || ']') END AS v FROM e),
  f AS (SELECT graph_id, node_id, CASE json_type(v -> '$.model') WHEN 'OBJECT' THEN v ->> '$.model.id' WHEN 'NULL' THEN NULL ELSE v ->> '$.model' END AS model,
    CASE json_type(v -> '$.features') WHEN 'VARCHAR' THEN CAST(v ->> '$.features' AS JSON) ELSE v -> '$.features' END AS f FROM v),
  x AS (SELECT graph_id, node_id, model, unnest(CASE json_type(f) WHEN 'ARRAY' THEN range(CAST(json_array_length(f) AS BIGINT)) WHEN 'OBJECT' THEN [0] ELSE [] END) AS i, f FROM f)
  SELECT DISTINCT graph_id, node_id, CAST(i AS INT) AS feature_idx, coalesce(TRY_CAST(model AS BIGINT), -1) AS model_id FROM x WHERE json_type(f) = 'OBJECT' OR json_type(f -> ('$[' || i || ']')) = 'OBJECT'"""
_P3_MASKS = "SELECT regexp_replace(regexp_replace(trim(t), '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS mask, count(*) AS images FROM (SELECT node_id, min(capture_info.timestamp) AS t FROM images GROUP BY node_id) GROUP BY 1"


def _p5_sql(reasons: bool = False) -> str:
    """The rules as one window over each batch."""
    reason = lambda r: f", '{r}' AS reason" if reasons else ""
    fields = {"altitude": "v < -500 OR v > 12000", "yaw": "v < -360 OR v > 360", "accuracy_xy": "v <= 0"}
    gap = lambda a, b: f"CASE WHEN field = 'yaw' THEN least(abs({a} - {b}) % 180, 180 - abs({a} - {b}) % 180) ELSE abs({a} - {b}) END"
    far = lambda a, b: f"coalesce({gap(a, b)} > lim, false)"
    v = {k: ("v" if k == 0 else f"v{k}".replace("-", "m")) for k in range(-7, 8)}
    most = lambda ks: "(" + " + ".join(f"CASE WHEN {v[k]} IS NULL THEN 0 WHEN {far(v[k], 'v')} THEN 1 ELSE -1 END" for k in ks) + ") > 0"
    cases = []
    for n in (1, 2, 3):
        for s in range(-(n - 1), 1):
            e = s + n - 1
            leaves = [far(v[k], v[x]) for k in range(s, e + 1) for x in (s - 1, e + 1)]
            cases.append("(" + " AND ".join([*leaves, most(range(s - 5, s)), most(range(e + 1, e + 6))]) + ")")
    union = " UNION ALL ".join(f"SELECT node_id, batch, path, '{f}' AS field, v, {bad} AS bad FROM (SELECT DISTINCT node_id, batch, path, capture_info.{f} AS v FROM images) WHERE v IS NOT NULL AND NOT isnan(v)" for f, bad in fields.items())
    w = "PARTITION BY batch, field ORDER BY path, node_id"
    lags = ", ".join(f"{'lag' if k < 0 else 'lead'}(v, {abs(k)}) OVER w AS {v[k]}" for k in v if k)
    return f"""WITH r AS ({union}), g AS (SELECT *, row_number() OVER ({w}) - row_number() OVER (PARTITION BY batch, field, v ORDER BY path, node_id) AS island FROM r WHERE NOT bad),
  s AS (SELECT *, count(*) OVER (PARTITION BY batch, field, v, island) >= 6 AS stuck FROM g),
  t AS (SELECT *, CASE WHEN NOT stuck AND NOT lag(stuck) OVER ({w}) THEN abs(v - lag(v) OVER ({w})) END AS step FROM s),
  u AS (SELECT batch, field, quantile_disc(step, 0.5) > 0 AND count(step) >= 3 AS varies FROM t GROUP BY ALL), c AS (SELECT t.*, stuck AND coalesce(varies, false) AS is_case FROM t JOIN u USING (batch, field)),
  l AS (SELECT node_id, batch, field, v, {lags} FROM c WHERE NOT is_case WINDOW w AS ({w})), m AS (SELECT batch, field, 10 * quantile_disc({gap('v', v[-1])}, 0.5) AS lim FROM l GROUP BY ALL)
  SELECT node_id, field{reason('impossible')} FROM r WHERE bad UNION SELECT node_id, field{reason('stuck')} FROM c WHERE is_case UNION SELECT node_id, field{reason('spike')} FROM l JOIN m USING (batch, field) WHERE {' OR '.join(cases)}"""


def oracle_sql() -> dict:
    return {"p3_masks": _P3_MASKS, "p5_found": _p5_sql(), "p5_reasons": _p5_sql(True), "p6_found": _P6, "p6_regions": _P6_REGIONS, "p7_found": _P7}
