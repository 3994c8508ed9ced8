"""Feature matching between linked images and best-per-cell filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 486


def ratio_match(links: DataFrame, features: DataFrame, ratio: float = 0.8, block: int = 512) -> DataFrame:
    """(edge_id, idx1, idx2, distance): for each feature of a link's first image its nearest of the second, if clearly nearer than the
    second nearest (a single candidate passes). Ties go to the smaller idx. Distances are shares of all bits.

    One task holds the features of two images; candidate pairs exist only as a block of a distance matrix, never as rows."""
    f = features.filter("node_id is not null and idx is not null and descriptor is not null").groupBy("node_id", "idx").agg(F.min("descriptor").alias("descriptor"))
    ends = links.filter("edge_id is not null").select("edge_id", "src", "dst").dropDuplicates(["edge_id"])
    one = ends.join(f.select(F.col("node_id").alias("src"), F.col("idx").alias("i1"), F.col("descriptor").alias("v1")), "src").select(F.col("edge_id").alias("e1"), "i1", "v1")
    two = ends.join(f.select(F.col("node_id").alias("dst"), F.col("idx").alias("i2"), F.col("descriptor").alias("v2")), "dst").select(F.col("edge_id").alias("e2"), "i2", "v2")

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"edge_id": [], "idx1": [], "idx2": [], "distance": []})
        if not len(a) or not len(b):
            return empty
        a, b = a.sort_values("i1"), b.sort_values("i2")
        x, y = (np.stack(d.to_numpy()).astype(np.int64).view(np.uint64) for d in (a["v1"], b["v2"]))
        parts = []
        for s in range(0, len(x), block):
            d = np.bitwise_count(x[s : s + block, None] ^ y[None]).sum(2, dtype=np.int32)
            best = d.argmin(1)
            rows = np.arange(len(d))
            first = d[rows, best]
            d[rows, best] = np.iinfo(np.int32).max
            second = d.min(1)
            keep = (first < ratio * second) | (len(y) == 1)
            parts.append(pd.DataFrame({"edge_id": a["e1"].iloc[0], "idx1": a["i1"].to_numpy()[s : s + block][keep], "idx2": b["i2"].to_numpy()[best[keep]], "distance": first[keep] / BITS}))
        return pd.concat(parts)

    return one.groupBy("e1").cogroup(two.groupBy("e2")).applyInPandas(match, "edge_id bigint, idx1 int, idx2 int, distance double")


def matched(features: DataFrame, matches: DataFrame) -> DataFrame:
    """Features at either end of ``matches`` (src, idx1, dst, idx2), for what is costly to work out of all of them."""
    ends = [matches.select(F.col(n).alias("node_id"), F.col(i).alias("idx")) for n, i in (("src", "idx1"), ("dst", "idx2"))]
    return features.join(ends[0].union(ends[1]).distinct(), ["node_id", "idx"], "left_semi")


def best_per_cell(df: DataFrame, keys: list[str], x: str, y: str, side: float, score: str, tie: list[str]) -> DataFrame:
    """The row of highest score in each grid cell of each group; ties to the smallest ``tie``."""
    cx, cy = F.floor(F.col(x) / side), F.floor(F.col(y) / side)
    w = Window.partitionBy(*keys, cx, cy).orderBy(F.desc(score), *tie)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def best_of_either(df: DataFrame, ends: list[tuple[list[str], str, str]], side: float, score: str, tie: list[str]) -> DataFrame:
    """Rows that are the best of a cell in at least one of their images; ``ends`` names keys and place in each."""
    out = None
    for keys, x, y in ends:
        best = best_per_cell(df, keys, x, y, side, score, tie)
        out = best if out is None else out.unionByName(best)
    return out.distinct()


def suppress(features: DataFrame, image: str, idx: str, x: str, y: str, strength: str, spacing: float) -> DataFrame:
    """``features`` with ``kept``: strongest first, a feature is kept if none kept before lies within ``spacing``. One task holds an image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf[idx].to_numpy(), -np.nan_to_num(pdf[strength].to_numpy(float), nan=-np.inf)))
        px, py = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        cells: dict[tuple[int, int], list[int]] = {}
        kept = np.zeros(len(pdf), bool)
        for i in order:
            if not (np.isfinite(px[i]) and np.isfinite(py[i])):
                continue
            cx, cy = int(px[i] // spacing), int(py[i] // spacing)
            near = (j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in cells.get((cx + a, cy + b), ()))
            if all((px[i] - px[j]) ** 2 + (py[i] - py[j]) ** 2 > spacing * spacing for j in near):
                kept[i] = True
                cells.setdefault((cx, cy), []).append(i)
        return pdf.assign(kept=kept)

    ddl = ", ".join(f"`{n}` {t}" for n, t in features.dtypes) + ", kept boolean"
    return features.groupBy(image).applyInPandas(run, ddl)


def match_score(gap: Column, cosine: Column, distance: Column, residual: Column) -> Column:
    """How good a match is: no score behind a camera (a negative gap)."""
    return F.when(gap < 0, F.lit(0.0)).otherwise(1 / (1 + gap)) * (1 - cosine * cosine) * (1 - distance) / (1 + residual)
