"""Measurement graphs as JSON and GeoJSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators.tables import numbered


def feature_rows(nodes: DataFrame, edges: DataFrame, place: Callable[[Column, Column], tuple[Column, Column]] | None = None, node_ids: DataFrame | None = None, edge_ids: DataFrame | None = None) -> DataFrame:
    """One row for each GeoJSON feature: a point for each node (node_id, path, x, y), a line for each edge (edge_id, src, dst, and inliers
    where there is that column) between nodes. ``node_ids`` (node_id) and ``edge_ids`` (edge_id) keep a part of them; ``place`` turns
    coordinates."""
    if "inliers" not in edges.columns:
        edges = edges.withColumn("inliers", F.lit(None).cast("bigint"))
    if edge_ids is not None:
        edges = edges.join(edge_ids.select("edge_id").distinct(), "edge_id", "left_semi")
    px, py = place(F.col("x"), F.col("y")) if place else (F.col("x"), F.col("y"))
    n = nodes.select("node_id", "path", px.alias("x"), py.alias("y"))
    none = lambda t: F.lit(None).cast(t)
    shown = n if node_ids is None else n.join(node_ids.select("node_id").distinct(), "node_id", "left_semi")
    points = shown.select(F.lit("Point").alias("kind"), F.col("node_id").alias("id"), "path", none("bigint").alias("source"), none("bigint").alias("dest"), "x", "y", none("double").alias("x2"), none("double").alias("y2"), none("bigint").alias("inliers"))
    a, b = n.select(F.col("node_id").alias("src"), "x", "y"), n.select(F.col("node_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    lines = edges.select("edge_id", "src", "dst", F.col("inliers").cast("bigint").alias("inliers")).join(a, "src").join(b, "dst")
    return points.unionByName(lines.select(F.lit("LineString").alias("kind"), F.col("edge_id").alias("id"), none("string").alias("path"), F.col("src").alias("source"), F.col("dst").alias("dest"), "x", "y", "x2", "y2", "inliers"))


def geojson(rows: DataFrame) -> DataFrame:
    """(id, feature): GeoJSON text of each row of :func:`feature_rows`."""
    point = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"), F.struct(F.col("path").alias("path"), F.col("id").cast("string").alias("id")).alias("properties")))
    line = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("LineString").alias("type"), F.array(F.array("x", "y"), F.array("x2", "y2")).alias("coordinates")).alias("geometry"),
            F.struct(F.col("id").cast("string").alias("id"), F.col("source").cast("string").alias("source"), F.col("dest").cast("string").alias("dest"), F.col("inliers").alias("inliers")).alias("properties"),
        )
    )
    return rows.select("id", F.when(F.col("kind") == "Point", point).otherwise(line).alias("feature"))


def write_geojson(rows: DataFrame, path: str) -> None:
    """A FeatureCollection as line-delimited features, sorted by id, in one folder of text files."""
    geojson(rows).repartitionByRange("id").sortWithinPartitions("id").select("feature").write.mode("overwrite").text(path)


def write_collection(rows: DataFrame, path: str) -> None:
    """One FeatureCollection over the files of a folder: read one after the other in the order of their names they are one JSON text."""
    f = numbered(geojson(rows).withColumn("at", F.monotonically_increasing_id()), ["id", "at"])
    f = f.select("_number", F.when(F.col("_number") == 0, F.col("feature")).otherwise(F.concat(F.lit(","), "feature")).alias("value"))
    ends = rows.sparkSession.createDataFrame([(-1, '{"type":"FeatureCollection","features":['), (2**62, "]}")], "_number bigint, value string")
    f.unionByName(ends).repartitionByRange("_number").sortWithinPartitions("_number").select("value").write.mode("overwrite").text(path)


_FEATURE = "array<struct<location: array<double>, strength: float, descriptor: string>>"
_NODE = f"struct<path: string, position: array<double>, orientation: array<double>, model: struct<id: bigint, dimensions: array<int>, focal_length: double>, features: {_FEATURE}, num_sparse_features: int>"
_EDGE = "struct<source: string, dest: string, relation_type: string, relation: array<double>, matches: array<array<double>>>"
DOCUMENT = f"version string, nodes map<string, {_NODE}>, edges map<string, {_EDGE}>"


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """(document, version, nodes, edges) of graph files in the plain layout; one whole file is one document."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("document"), F.from_json("value", DOCUMENT).alias("g")).select("document", "g.*")


def node_rows(graphs: DataFrame) -> DataFrame:
    return graphs.select("document", F.explode("nodes").alias("node_id", "n")).select("document", "node_id", "n.*")


def graph_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): one graph as JSON, with members in the order of their ids. ``nodes`` has node_id and node columns, ``edges`` edge_id and the rest.

    Meant for one graph's worth of rows; for more, keep the Parquet tables."""

    def members(df: DataFrame, key: str) -> DataFrame:
        fields = F.to_json(F.struct(*[c for c in df.columns if c != key]))
        row = F.struct(F.col(key).cast("decimal(20,0)").alias("k"), F.concat(F.lit('"'), F.col(key).cast("string"), F.lit('":'), fields).alias("t"))
        return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), ",").alias("text"))

    n, e = members(nodes, "node_id").withColumnRenamed("text", "n"), members(edges, "edge_id").withColumnRenamed("text", "e")
    return n.join(F.broadcast(e)).select(F.concat(F.lit('{"version":1,"nodes":{'), "n", F.lit('},"edges":{'), "e", F.lit("}}")).alias("value"))
