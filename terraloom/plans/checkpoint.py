"""Saved states: one Parquet table for each part, and a metadata file that is written last."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

VERSION = 1


@dataclass
class State:
    stage: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    extra: dict = field(default_factory=dict)


class InvalidCheckpoint(ValueError):
    """The folder holds no checkpoint that can be read."""


def save(folder: str, tables: dict[str, DataFrame], stage: str, extra: dict | None = None) -> str:
    """Write ``tables`` under a new version of ``folder`` and return the version's path; a broken write leaves no metadata."""
    path = f"{folder}/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    meta = json.dumps({"version": VERSION, "stage": stage, "tables": sorted(tables), "extra": extra or {}}, sort_keys=True)
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return path


def validate(spark: SparkSession, path: str) -> dict:
    """The metadata of a checkpoint, or InvalidCheckpoint."""
    try:
        rows = spark.read.text(f"{path}/metadata").collect()
        meta = json.loads("".join(r.value for r in rows))
    except Exception as e:
        raise InvalidCheckpoint(f"{path}: no readable metadata") from e
    if not isinstance(meta, dict) or meta.get("version") != VERSION:
        raise InvalidCheckpoint(f"{path}: unknown version")
    if not isinstance(meta.get("tables"), list) or not isinstance(meta.get("stage"), str):
        raise InvalidCheckpoint(f"{path}: malformed metadata")
    return meta


def load(spark: SparkSession, path: str) -> State:
    meta = validate(spark, path)
    try:
        tables = {t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"]}
    except Exception as e:
        raise InvalidCheckpoint(f"{path}: a table is missing") from e
    return State(meta["stage"], tables, meta.get("extra", {}))
