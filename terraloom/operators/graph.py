"""Graphs as edge tables: degrees, components, hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.runtime import materialise

_ROUNDS = 60


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, degree) over both directions."""
    ends = edges.select(F.explode(F.array(a, b)).alias("node"))
    return ends.filter("node is not null").groupBy("node").agg(F.count("*").alias("degree"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that a node is connected with. Alternating large-star and small-star steps on distinct edges:
    every step is one pre-aggregated group-by, and the number of rounds grows with the logarithm of the longest path."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = materialise(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialise(small.filter("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components are still growing")
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def within_hops(edges: DataFrame, a: str, b: str, start: DataFrame, hops: int) -> DataFrame:
    """(node): the nodes of ``start`` (column node) and those at most ``hops`` edges away, each once."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("to")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("to"))).distinct()
    seen = start.select("node").distinct()
    for _ in range(hops):
        seen = seen.unionByName(both.join(seen, "node", "left_semi").select(F.col("to").alias("node"))).distinct()
    return seen


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``edges`` and those of ``new`` whose ends are both in ``nodes`` (column node) and whose ``key`` isn't taken."""
    known = nodes.select("node").distinct()
    fit = new.join(known.withColumnRenamed("node", a), a, "left_semi").join(known.withColumnRenamed("node", b), b, "left_semi")
    return edges.unionByName(fit.select(*edges.columns).dropDuplicates([key]).join(edges.select(key), key, "left_anti"))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of ``gone`` (column node) and without every edge at one of them."""
    gone = gone.select("node").distinct()
    left = edges.join(gone.withColumnRenamed("node", a), a, "left_anti").join(gone.withColumnRenamed("node", b), b, "left_anti")
    return nodes.join(gone, "node", "left_anti"), left.select(*edges.columns)
