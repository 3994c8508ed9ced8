"""Duplicates hidden by formatting: canonical keys are range-partitioned, sorted externally and scanned as adjacent runs.

The sort key ends with the record's id, so a group with a third of all rows spreads over many ranges; runs that cross a range border are
joined by one summary row for each range. Keys are compared in full, never by hash.

Defined results: null and text without letters or digits are the same value; null and NaN numbers are equal; records with a null id are
left out; repeated rows of an id count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.runtime import materialise

_SEPARATOR = "\u001f"


def canonical_text(c: Column) -> Column:
    """Letters and digits only, without case (sharp s as ss, final sigma as sigma); null as the empty text."""
    folded = F.replace(F.replace(F.lower(c.cast("string")), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.coalesce(F.regexp_replace(folded, r"[^\p{L}\p{N}]", ""), F.lit(""))


def canonical_key(texts: list[Column], exact: list[Column]) -> Column:
    """One text that is equal for two records exactly if their canonical texts agree in any order and their exact fields agree."""

    def same(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.when(s != "NaN", s), F.lit(""))

    return F.concat_ws(_SEPARATOR, F.sort_array(F.array(*map(canonical_text, texts))), *map(same, exact))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, first, run) of one sorted range, then its summary (part, keys at both ends, first id and number of the last run)."""
    part = TaskContext.get().partitionId()
    empty = {"part": part, "summary": False, "low": None, "high": None}
    last_key, last_first, run, low = None, None, -1, None
    for b in batches:
        if not len(b):
            continue
        key, ids = b["key"].to_numpy(object), b["id"].to_numpy()
        new = np.empty(len(b), bool)
        new[0] = last_key is None or key[0] != last_key
        new[1:] = key[1:] != key[:-1]
        low = key[0] if low is None else low
        runs = run + np.cumsum(new)
        starts = np.flatnonzero(new)
        first = np.where(new.cumsum() > 0, ids[starts[np.maximum(new.cumsum() - 1, 0)]] if len(starts) else ids, 0)
        if not new[0]:
            first = np.where(runs == run, last_first, first)
        yield pd.DataFrame({"id": ids, "first": first, "run": runs, **empty})
        last_key, last_first, run = key[-1], first[-1], int(runs[-1])
    if last_key is not None:
        yield pd.DataFrame({"id": [last_first], "first": [last_first], "run": [run], "part": [part], "summary": [True], "low": [low], "high": [last_key]})


def collapse(df: DataFrame, record_id: str, texts: list[str], exact: list[str]) -> DataFrame:
    """Rows (id, first): every record with the smallest id of its copies. The driver receives one summary for each sort range, no more."""
    spark, kind = df.sparkSession, dict(df.dtypes)[record_id]
    keyed = df.select(F.col(record_id).alias("id"), canonical_key([F.col(t) for t in texts], [F.col(e) for e in exact]).alias("key"))
    ordered = keyed.filter("id is not null").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    schema = f"id {kind}, first {kind}, run bigint, part int, summary boolean, low string, high string"
    scanned = materialise(ordered.mapInPandas(_scan, schema))
    carry, moved = None, []
    for r in sorted(scanned.filter("summary").collect(), key=lambda r: r.part):
        first = r.first
        if carry is not None and carry[0] == r.low:
            moved.append((r.part, carry[1]))
            if r.run == 0:
                first = carry[1]
        carry = (r.high, first)
    fields = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("carried", df.schema[record_id].dataType)])
    table = F.broadcast(spark.createDataFrame(moved, fields))
    rows = scanned.filter("not summary").select("id", "first", "run", "part").join(table, "part", "left")
    return rows.select("id", F.when(F.col("run") == 0, F.coalesce("carried", "first")).otherwise(F.col("first")).alias("first"))


def copies(members: DataFrame) -> DataFrame:
    """(first, copies) from the rows of :func:`collapse`; a repeated row of an id is no further copy."""
    return members.dropDuplicates(["id"]).groupBy("first").agg(F.count("*").alias("copies"))
