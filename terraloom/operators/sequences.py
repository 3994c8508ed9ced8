"""Ordered sequences per source, cut into chunks of bounded size so that a hot source never lands in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.runtime import materialise

CHUNK, POS, OWN = "_chunk", "_pos", "_own"
_ROW_BITS = 33  # of monotonically_increasing_id


def chunk_sequences(df: DataFrame, order: list[str], chunk_rows: int = 65536, halo: int = 16) -> DataFrame:
    """Sort by ``order`` over all partitions and number the rows; each row goes to chunk ``_pos div chunk_rows`` as its own, and within
    ``halo`` rows of a chunk's edge also to the neighbour chunk (``_own`` false). A window partitioned by ``_chunk`` then sees ``halo``
    rows on either side of every row it owns, and no window holds more than ``chunk_rows + 2 * halo`` rows whatever the skew.
    The driver receives one count for each partition, nothing else."""
    if not 0 < halo < chunk_rows:
        raise ValueError("halo must be positive and smaller than a chunk")
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = materialise(ordered)
    part = F.shiftright("_id", _ROW_BITS)
    offsets, total = [], 0
    for p, n in sorted(map(tuple, kept.groupBy(part.alias("p")).count().collect())):
        offsets.append((p, total))
        total += n
    table = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "_part long, _offset long"))
    pos = F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    here, at = F.floor(F.col(POS) / chunk_rows), F.col(POS) % chunk_rows
    numbered = kept.withColumn("_part", part).join(table, "_part").withColumn(POS, pos).drop("_part", "_offset", "_id")
    edge = lambda cond, chunk: F.when(cond, F.struct(chunk.cast("long").alias("c"), F.lit(False).alias("o")))
    copies = F.array_compact(F.array(F.struct(here.cast("long").alias("c"), F.lit(True).alias("o")), edge((at < halo) & (here > 0), here - 1), edge(at >= chunk_rows - halo, here + 1)))
    return numbered.withColumn("_copy", F.explode(copies)).withColumn(CHUNK, F.col("_copy.c")).withColumn(OWN, F.col("_copy.o")).drop("_copy")
