"""Tracks of features seen in several images, their gates, and pairs for dense matching and colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.graph import components
from terraloom.operators.neighbours import radius_join

MOST_ERROR, MOST_ERROR_PAIR, MOST_RAYS, LEAST_RAYS = 10.0, 1.0, 5, 3
REPROJECTION_PX = 8.0


def build_tracks(matches: DataFrame, a: str, b: str, image: Column) -> DataFrame:
    """(track, node): connected features, one for each image of a track (the smallest); features alone are dropped. ``image`` tells a node's image."""
    c = components(matches, a, b).withColumn("image", image)
    one = c.groupBy("component", "image").agg(F.min("node").alias("node"))
    size = one.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return one.join(size, "component").select(F.col("component").alias("track"), "image", "node")


def gate_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks (track, image, error) whose least error passes: wider for three images or more."""
    s = tracks.groupBy("track").agg(F.min("error").alias("error"), F.countDistinct("image").alias("images"))
    return s.filter(F.col("error") <= F.when(F.col("images") >= 3, MOST_ERROR).otherwise(MOST_ERROR_PAIR))


def gate_rays(rays: DataFrame) -> DataFrame:
    """Rays (track, ray, error) within three times their track's median error, the best five; tracks left with fewer than three are dropped."""
    by = Window.partitionBy("track")
    ranked = rays.filter("error is not null and not isnan(error)").withColumn("k", F.row_number().over(by.orderBy("error", "ray"))).withColumn("n", F.count("*").over(by))
    middle = F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("error"))).over(by)
    kept = ranked.withColumn("middle", middle).filter((F.col("error") <= F.greatest(3 * F.col("middle"), F.lit(1e-6))) & (F.col("k") <= MOST_RAYS))
    return kept.withColumn("left", F.count("*").over(by)).filter(F.col("left") >= LEAST_RAYS).drop("k", "n", "middle", "left")


def uncovered(inliers: DataFrame, members: DataFrame, cells: DataFrame) -> DataFrame:
    """Inliers (…, f1, c1, f2, c2: features and cells of both ends) that add coverage: neither feature is in a track (members: node), and
    not both cells are covered (cells: cell)."""
    m, c = members.select("node").distinct(), cells.select("cell").distinct()
    left = inliers.join(m, inliers["f1"] == m["node"], "left_anti").join(m, F.col("f2") == m["node"], "left_anti")
    c1, c2 = c.select(F.col("cell").alias("c1"), F.lit(True).alias("_a")), c.select(F.col("cell").alias("c2"), F.lit(True).alias("_b"))
    return left.join(c1, "c1", "left").join(c2, "c2", "left").filter("_a is null or _b is null").drop("_a", "_b")


def guided_matches(predicted: DataFrame, features: DataFrame, distance: Column, radius: float = 150.0, ratio: float = 0.85, alone: float = 0.35) -> DataFrame:
    """(p, q, distance): for each predicted pixel (image, p, px, py, …) the most similar feature (image, q, qx, qy, …) within ``radius``: it
    must be clearly more similar than the second, or, alone, similar enough. A null ``distance`` rules a pair out."""
    pairs = radius_join(predicted, features, radius, on=("image",)).withColumn("distance", distance).filter("distance is not null")
    by = Window.partitionBy("image", "p").orderBy("distance", "q")
    pairs = pairs.withColumn("k", F.row_number().over(by)).withColumn("second", F.lead("distance").over(by)).filter("k = 1")
    return pairs.filter(F.when(F.col("second").isNull(), F.col("distance") < alone).otherwise(F.col("distance") < ratio * F.col("second"))).select("image", "p", "q", "distance")


def colour_pairs(layers: DataFrame) -> DataFrame:
    """Pairs of layers a < b of one ground pixel (p, layer, cam_id, …); a pixel has few layers, so the pairs are few, too."""
    a = layers.select("p", *(F.col(c).alias(f"{c}_a") for c in layers.columns if c != "p"))
    b = layers.select("p", *(F.col(c).alias(f"{c}_b") for c in layers.columns if c != "p"))
    return a.join(b, "p").filter("layer_a < layer_b and cam_id_a <> cam_id_b")


def reproject_gate(observations: DataFrame) -> DataFrame:
    """Observations (track, …, residual_px) within REPROJECTION_PX; tracks left with fewer than two are dropped."""
    kept = observations.filter(F.col("residual_px") <= REPROJECTION_PX)
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy("track"))).filter("_n >= 2").drop("_n")
