"""Session-level helpers shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK_DIRS: dict[str, str] = {}
#: Above this estimated size a lookup table isn't broadcast by the operators.
BROADCAST_LIMIT_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _FALLBACK_DIRS[app] = tempfile.mkdtemp(prefix="terraloom-")
    return _FALLBACK_DIRS[app]


@atexit.register
def _drop_fallback_dirs() -> None:
    import shutil

    for d in _FALLBACK_DIRS.values():
        shutil.rmtree(d, ignore_errors=True)


def _own_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/terraloom/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove everything this application has written by :func:`materialise`. Results that weren't fetched or saved are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into all shuffle partitions: for groups that cost time rather than bytes, which adaptive execution would
    put together by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only where the rows, counted, at the width of their types are within ``limit``; beyond it Catalyst picks a shuffled
    join. Catalyst's estimate comes first, so that nothing large is counted; alone it would be the size of compressed files."""
    if estimated_bytes(df) > limit:
        return df
    return F.broadcast(df) if df.count() * (int(df._jdf.schema().defaultSize()) + 16) <= limit else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't use yet (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name
