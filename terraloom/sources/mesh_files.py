"""Meshes as PLY and OBJ text. A mesh is a bounded table (a terrain of at most about a million vertices), written by one task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HEADER = ["ply", "format ascii 1.0"]


def faces(edges: DataFrame) -> DataFrame:
    """(a, b, c): triangles of a mesh from its edges' opposite corners, each once, smallest corner first."""
    side = F.explode(F.array("opp0", "opp1")).alias("opp")
    t = edges.select("src", "dst", side).filter("opp is not null").select(F.array_sort(F.array("src", "dst", "opp")).alias("f")).distinct()
    return t.select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), F.col("f")[2].alias("c"))


def wound(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles turned counter-clockwise as seen from above."""
    at = lambda n: nodes.select(F.col("node_id").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    t = triangles.join(at("a"), "a").join(at("b"), "b").join(at("c"), "c")
    up = (F.col("xb") - F.col("xa")) * (F.col("yc") - F.col("ya")) - (F.col("yb") - F.col("ya")) * (F.col("xc") - F.col("xa")) >= 0
    return t.select("a", F.when(up, F.col("b")).otherwise(F.col("c")).alias("b"), F.when(up, F.col("c")).otherwise(F.col("b")).alias("c"))


def ply_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, at, value): lines of a PLY file in the order of part and at. Numbers are written in full, so that reading gives the same."""
    order = nodes.select("node_id", "x", "y", "z", (F.row_number().over(Window.orderBy("node_id")) - 1).alias("at"))
    place = lambda n: order.select(F.col("node_id").alias(n), F.col("at").alias(f"i{n}"))
    tri = wound(nodes, faces(edges)).join(place("a"), "a").join(place("b"), "b").join(place("c"), "c")
    edge = edges.join(place("src"), "src").join(place("dst"), "dst")
    for n in ("opp0", "opp1"):
        edge = edge.join(place(n), n, "left")
    counts = order.agg(F.count("*").alias("v")).join(tri.agg(F.count("*").alias("f"))).join(edge.agg(F.count("*").alias("e")))
    head = [F.lit(h) for h in _HEADER] + [F.format_string("element vertex %d", "v"), F.lit("property double x"), F.lit("property double y"), F.lit("property double z"), F.format_string("element face %d", "f"), F.lit("property list uchar int vertex_indices"), F.format_string("element edge %d", "e")]
    head += [F.lit(f"property int {n}") for n in ("vertex1", "vertex2", "border", "opposite1", "opposite2")] + [F.lit("end_header")]
    header = counts.select(F.posexplode(F.array(*head)).alias("at", "value")).select(F.lit(0).alias("part"), F.col("at").cast("bigint").alias("at"), "value")
    text = lambda *c: F.concat_ws(" ", *(F.col(x).cast("string") for x in c))
    v = order.select(F.lit(1).alias("part"), F.col("at").cast("bigint").alias("at"), text("x", "y", "z").alias("value"))
    f = tri.select(F.lit(2).alias("part"), F.row_number().over(Window.orderBy("ia", "ib", "ic")).cast("bigint").alias("at"), F.concat(F.lit("3 "), text("ia", "ib", "ic")).alias("value"))
    e = edge.select(F.lit(3).alias("part"), F.row_number().over(Window.orderBy("edge_id")).cast("bigint").alias("at"), F.concat_ws(" ", F.col("isrc"), F.col("idst"), F.col("border").cast("int"), F.coalesce("iopp0", F.lit(-1)), F.coalesce("iopp1", F.lit(-1))).alias("value"))
    return header.unionByName(v).unionByName(f).unionByName(e)


def write_ply(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    ply_lines(nodes, edges).coalesce(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


def parse_ply(text: str) -> tuple[list[tuple], list[tuple]]:
    """Vertices (id, x, y, z) and edges (id, src, dst, border, opp0, opp1) of a PLY text as :func:`write_ply` makes it; ValueError on any other."""
    lines = text.splitlines()
    want = [*_HEADER, "element vertex ", "property double x", "property double y", "property double z", "element face ", "property list uchar int vertex_indices", "element edge ", *(f"property int {n}" for n in ("vertex1", "vertex2", "border", "opposite1", "opposite2")), "end_header"]
    if len(lines) < len(want) or any(a != b and not (b.endswith(" ") and a.startswith(b)) for a, b in zip(lines, want)):
        raise ValueError("unexpected header")
    nv, nf, ne = (int(lines[k].rsplit(" ", 1)[1]) for k in (2, 6, 8))
    body = lines[len(want) :]
    if len(body) != nv + nf + ne:
        raise ValueError("missing or trailing lines")
    nodes = [(i, *map(float, x.split())) for i, x in enumerate(body[:nv])]
    edges = []
    for i, x in enumerate(body[nv + nf :]):
        a, b, border, o0, o1 = map(int, x.split())
        edges.append((i, a, b, bool(border), o0 if o0 >= 0 else None, o1 if o1 >= 0 else None))
    return nodes, edges


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), each with a column ``file``."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("file"), "value")

    def rows(which: int, names: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(f, *r) for f, t in zip(b["file"], b["value"]) for r in parse_ply(t)[which]]
                yield pd.DataFrame(out, columns=["file", *names]).astype({n: "Int64" for n in names if n.startswith("opp")})

        return run

    n = files.mapInPandas(rows(0, ["node_id", "x", "y", "z"]), "file string, node_id bigint, x double, y double, z double")
    e = files.mapInPandas(rows(1, ["edge_id", "src", "dst", "border", "opp0", "opp1"]), "file string, edge_id bigint, src bigint, dst bigint, border boolean, opp0 bigint, opp1 bigint")
    return n, e


def obj_lines(nodes: DataFrame, triangles: DataFrame, bounds: tuple[float, float, float, float], material: str = "ortho") -> DataFrame:
    """(part, at, value) of a textured OBJ over all surfaces (column surface_id): texture places are shares of the bounds, numbers count
    from 1 through all surfaces."""
    x0, x1, y0, y1 = bounds
    order = nodes.select("surface_id", "node_id", "x", "y", "z", F.row_number().over(Window.orderBy("surface_id", "node_id")).cast("bigint").alias("i"))
    v = order.select(F.lit(1).alias("part"), F.col("i").alias("at"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    u = (F.col("x") - x0) / (x1 - x0), F.lit(1.0) - (F.lit(y1) - F.col("y")) / (y1 - y0)
    vt = order.select(F.lit(2).alias("part"), F.col("i").alias("at"), F.concat_ws(" ", F.lit("vt"), *u).alias("value"))
    place = lambda n: order.select("surface_id", F.col("node_id").alias(n), F.col("i").alias(f"i{n}"))
    t = triangles
    for n in "abc":
        t = t.join(place(n), ["surface_id", n])
    f = t.select(F.lit(3).alias("part"), F.row_number().over(Window.orderBy("ia", "ib", "ic")).cast("bigint").alias("at"), F.concat_ws(" ", F.lit("f"), *(F.concat_ws("/", F.col(f"i{n}"), F.col(f"i{n}")) for n in "abc")).alias("value"))
    head = nodes.sparkSession.createDataFrame([(0, 0, f"mtllib {material}.mtl"), (0, 1, f"usemtl {material}")], "part int, at bigint, value string")
    return head.unionByName(v).unionByName(vt).unionByName(f)


def mtl_text(material: str = "ortho", image: str = "ortho.jpg") -> str:
    return f"newmtl {material}\nKa 1 1 1\nKd 1 1 1\nmap_Kd {image}\n"
