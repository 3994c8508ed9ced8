"""Statistics, bounds, orders and rasters as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.runtime import materialise


def histogram_bounds(df: DataFrame, column: str, tail: float = 0.025) -> DataFrame:
    """(low, high): values are cut to whole numbers and counted; the bounds leave ``tail`` on either side and are widened around the upper
    one. Counts are summed up over sorted ranges of the whole numbers."""
    h = df.filter(F.col(column).isNotNull()).groupBy(F.expr(f"cast(`{column}` as bigint)").alias("v")).agg(F.count("*").alias("n"))
    h = materialise(running_sum(h, ["v"], F.col("n"), "up"))
    total = F.broadcast(h.agg(F.max("up").alias("total")))  # one row
    h = h.join(total).withColumn("down", F.col("total") - F.col("up") + F.col("n"))
    e = h.agg(F.min(F.when(F.col("up") > F.col("total") * tail, F.col("v"))).alias("lo"), F.max(F.when(F.col("down") > F.col("total") * tail, F.col("v"))).alias("hi"))
    w = 2 * (F.col("hi") - F.col("lo"))
    return e.select((F.col("lo") + w / 2 - w).alias("low"), (F.col("lo") + w / 2 + w).alias("high"))


def plane_fit(df: DataFrame, keys: list[str], x: Column, y: Column, z: Column) -> DataFrame:
    """(keys, c0, c1, c2, n) of z = c0 + c1 x + c2 y by least squares over centred sums; null for fewer than three rows or no spread."""
    means = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.avg(z).alias("_mz"))
    c = df.join(means, keys) if keys else df.join(F.broadcast(means))  # without keys a single row
    dx, dy, dz = x - F.col("_mx"), y - F.col("_my"), z - F.col("_mz")
    s = c.groupBy(*keys, "_mx", "_my", "_mz").agg(F.count("*").alias("n"), F.sum(dx * dx).alias("xx"), F.sum(dx * dy).alias("xy"), F.sum(dy * dy).alias("yy"), F.sum(dx * dz).alias("xz"), F.sum(dy * dz).alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    ok = (F.col("n") >= 3) & (F.abs(det) > 1e-12)
    c1 = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det
    c2 = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    s = s.withColumn("c1", F.when(ok, c1)).withColumn("c2", F.when(ok, c2))
    return s.select(*keys, (F.col("_mz") - F.col("c1") * F.col("_mx") - F.col("c2") * F.col("_my")).alias("c0"), "c1", "c2", "n")


def concurrency(df: DataFrame, key: str, start: Column, end: Column, chunk: str) -> DataFrame:
    """(key, total, weighted): running time of each key, and with every stretch divided among the keys that run in it.

    Intervals are cut at the borders of ``chunk`` (a column's name: a span of time, such as an hour), so every window holds one chunk."""
    rows = df.select(F.col(key).alias("key"), F.col(chunk).alias("c"), start.alias("s"), end.alias("e")).filter("e > s")
    total = rows.groupBy("key").agg(F.sum(F.col("e") - F.col("s")).alias("total"))
    marks = rows.select("c", "key", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("m"))
    marks = marks.groupBy("c", "key", F.col("m.t").alias("t")).agg(F.sum("m.d").alias("d"))
    per = Window.partitionBy("c", "key").orderBy("t")
    marks = marks.withColumn("run", F.sum("d").over(per)).withColumn("was", F.coalesce(F.lag("run").over(per), F.lit(0)))
    # A key's turns on and off; between two turns of any key every running key gets one part in as many as run.
    turns = marks.select("c", "key", "t", (F.when(F.col("run") > 0, 1).otherwise(0) - F.when(F.col("was") > 0, 1).otherwise(0)).alias("turn")).filter("turn <> 0")
    times = turns.groupBy("c", "t").agg(F.sum("turn").alias("turn"))
    at = Window.partitionBy("c").orderBy("t")
    times = times.withColumn("n", F.sum("turn").over(at)).withColumn("step", F.lead("t").over(at) - F.col("t"))
    part = F.when(F.col("n") > 0, F.coalesce("step", F.lit(0)) / F.col("n")).otherwise(F.lit(0.0))
    times = times.withColumn("area", F.sum(part).over(at) - part)
    weighted = turns.join(times.select("c", "t", "area"), ["c", "t"]).groupBy("key").agg(F.sum(-F.col("turn") * F.col("area")).alias("weighted"))
    return total.join(weighted, "key")


def overview(df: DataFrame, row: str, col: str, value: str, factor: int) -> DataFrame:
    """Mean of blocks of ``factor`` by ``factor`` cells."""
    return df.groupBy(F.floor(F.col(row) / factor).alias(row), F.floor(F.col(col) / factor).alias(col)).agg(F.avg(value).alias(value))


def boundary(df: DataFrame, row: str, col: str, label: str) -> DataFrame:
    """Cells with one of their four neighbours under another label."""
    r = [F.lag(label).over(Window.partitionBy(row).orderBy(col)), F.lead(label).over(Window.partitionBy(row).orderBy(col))]
    c = [F.lag(label).over(Window.partitionBy(col).orderBy(row)), F.lead(label).over(Window.partitionBy(col).orderBy(row))]
    marked = df
    for k, n in enumerate([*r, *c]):
        marked = marked.withColumn(f"_n{k}", n)
    differs = [F.coalesce(F.col(f"_n{k}") != F.col(label), F.lit(False)) for k in range(4)]
    return marked.filter(differs[0] | differs[1] | differs[2] | differs[3]).drop(*(f"_n{k}" for k in range(4)))


def round_robin(tables: list[DataFrame], order: list[str]) -> DataFrame:
    """Rows of several tables interleaved by their place; column ``list`` tells the table, ``pos`` the place."""
    out = None
    for k, t in enumerate(tables):
        t = numbered(t, order).withColumnRenamed("_number", "pos").withColumn("list", F.lit(k))
        out = t if out is None else out.unionByName(t)
    return out


def spread_evenly(lists: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of ``lists`` with ``list``, ``pos`` and ``at``, the share of its list that stands before a row: ordered by ``at`` and list,
    every list is spread evenly over the whole. A list is numbered over sorted partitions, of which one count each reaches the driver."""
    out = None
    for k, df in enumerate(lists):
        rows = numbered(df, order).withColumnRenamed("_number", "pos")
        n = df.sparkSession.createDataFrame([(df.count(),)], "_n bigint")
        one = rows.join(F.broadcast(n)).withColumn("list", F.lit(k)).withColumn("at", F.col("pos") / F.greatest("_n", F.lit(1))).drop("_n")
        out = one if out is None else out.unionByName(one)
    return out


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_number``: its place, from 0, in the order of ``order`` (which should end with a key)."""
    return _offset(df, order, F.lit(1), "_number", inclusive=False)


def running_sum(df: DataFrame, order: list[str], weight: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` up to and with each row in the order of ``order`` (which should end with a key)."""
    return _offset(df, order, weight, name, inclusive=True)


def _offset(df: DataFrame, order: list[str], weight: Column, name: str, inclusive: bool) -> DataFrame:
    """Sums over sorted range partitions: within each by a window, before it by the partitions' totals."""
    kept = materialise(df.withColumn("_w", weight).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    spark, before, table = df.sparkSession, 0, []
    for p, w in sorted(map(tuple, kept.groupBy("_part").agg(F.sum("_w")).collect())):
        table.append((p, before))
        before += w or 0
    kind = "double" if any(isinstance(b, float) for _, b in table) or isinstance(before, float) else "bigint"
    offsets = F.broadcast(spark.createDataFrame([(p, float(b) if kind == "double" else b) for p, b in table] or [(0, 0 if kind == "bigint" else 0.0)], f"_part int, _before {kind}"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("_before") + F.sum("_w").over(w) - (F.lit(0) if inclusive else F.col("_w"))
    return kept.join(offsets, "_part").withColumn(name, total).drop("_w", "_part", "_before")
