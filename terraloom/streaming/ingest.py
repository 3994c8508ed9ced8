"""Micro-batch ingest of image metadata with links to the nearest images already there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from terraloom.operators.neighbours import knn_join

NEIGHBOURS = 10


def link_batch(state: DataFrame, batch: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(src, dst): each new image with its nearest among the images there and the batch itself, itself left out."""
    pick = lambda df: df.filter("position is not null").select("node_id", F.col("position")[0].alias("x"), F.col("position")[1].alias("y"))
    new = pick(batch)
    all_ = pick(state).unionByName(new).dropDuplicates(["node_id"])
    near = knn_join(new.select(F.col("node_id").alias("p"), F.col("x").alias("px"), F.col("y").alias("py")), all_.select(F.col("node_id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy")), k)
    return near.filter("p <> q").select(F.col("p").alias("src"), F.col("q").alias("dst"))


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, state: str, files_per_batch: int = 1) -> StreamingQuery:
    """Read Parquet files that arrive in ``source`` until none is left; images and links go to folders of ``target``, one for each batch.

    Writing a batch again replaces its folder, so a batch that failed half-way leaves nothing twice. An image delivered before is left out:
    the ids seen are the stream's own state, kept by key from batch to batch. Of earlier batches only keys and places are read, to link
    with. Images without a node_id are left out."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream = stream.filter("node_id is not null").dropDuplicates(["node_id"])

    def step(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        batch.select(*schema.names).write.mode("overwrite").parquet(f"{target}/images/batch={number}")
        there = s.read.schema(schema).option("basePath", f"{target}/images").parquet(*[f"{target}/images/batch={i}" for i in range(number)]) if number else s.createDataFrame([], schema)
        new = s.read.schema(schema).parquet(f"{target}/images/batch={number}")
        link_batch(there.select("node_id", "position"), new.select("node_id", "position")).write.mode("overwrite").parquet(f"{target}/links/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; beyond what the imagery pipeline has, for streams of readings."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
