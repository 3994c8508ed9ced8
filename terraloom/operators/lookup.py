"""Tiered lookups in the camera list, shared models, calibration and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.runtime import broadcast_if_small


def tiered_lookup(df: DataFrame, key: str, reference: DataFrame, order: str, tiers: list[list[str]], result: list[str]) -> DataFrame:
    """``df`` (one row for each ``key``) with ``result`` columns of the best entry and the ``tier`` that found it; null where none does.

    Every tier's columns include those of the last one, on which the sides are joined; text compares without case. Within a tier the
    first entry by ``order`` holds."""
    text = {c for c, t in df.dtypes if t == "string"}
    norm = lambda c, name: F.lower(c) if name in text else c
    names = list(dict.fromkeys(c for t in tiers for c in t))
    entry = reference.select(F.col(order).alias("_ord"), *(norm(F.col(c), c).alias(f"_e_{c}") for c in names), *(F.col(c).alias(f"_r_{c}") for c in result))
    same = lambda t: reduce(lambda a, b: a & b, (norm(F.col(c), c) == F.col(f"_e_{c}") for c in t))
    tier = F.coalesce(*(F.when(same(t), F.lit(k)) for k, t in enumerate(tiers, 1)))
    hits = df.join(broadcast_if_small(entry), same(tiers[-1]), "left").withColumn("tier", tier)
    best = Window.partitionBy(key).orderBy(F.col("tier").asc_nulls_last(), "_ord")
    out = hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return out.select(*df.columns, "tier", *(F.col(f"_r_{c}").alias(c) for c in result))


def shared_models(df: DataFrame, info: list[str], key: str) -> DataFrame:
    """``df`` with ``shared_model``: the smallest ``key`` among the rows of equal ``info`` (null equals null). The groups are pre-aggregated
    and joined back, so a model with a third of all rows is no single task."""
    first = df.groupBy(*(F.col(c).alias(f"_{c}") for c in info)).agg(F.min(key).alias("shared_model"))
    return df.join(broadcast_if_small(first), reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in info))).drop(*(f"_{c}" for c in info))


def calibrated(width: Column, height: Column, db_width: Column, db_height: Column, offset_x: Column, offset_y: Column, focal: Column, db_focal: Column) -> tuple[Column, Column, Column]:
    """(principal point x, y, focal): the list's offset, scaled where the image has another size; its focal, as listed, only where the image has none."""
    scale = F.when((width == db_width) & (height == db_height), F.lit(1.0)).otherwise(width / db_width)
    use = F.when(focal.isNotNull() & ~F.isnan(focal) & (focal > 0), focal).otherwise(F.coalesce(F.when(~F.isnan(db_focal), db_focal), focal))
    return width / 2 + offset_x * scale, height / 2 + offset_y * scale, use


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of either side by ``keys`` (null equals null); where both have a row, the values of ``new`` hold, null or not."""
    n = new.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_new"))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    o = old.select(*keys, *values).withColumn("_old", F.lit(True))
    both = o.join(n, on, "full")
    pick = lambda k: F.when(F.col("_old").isNotNull(), F.col(k)).otherwise(F.col(f"_{k}")).alias(k)
    take = lambda v: F.when(F.col("_new").isNotNull(), F.col(f"_{v}")).otherwise(F.col(v)).alias(v)
    return both.select(*map(pick, keys), *map(take, values))
