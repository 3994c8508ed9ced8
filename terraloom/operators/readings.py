"""Implausible readings: physical limits, spikes against the source's usual rate of change, stuck values, hourly fences.

Per-source statistics are mergeable quantile sketches (``percentile_approx``: partial sketches on the map side, merged after the
shuffle), so a source with a third of all rows costs one sketch for each task. Neighbour rules run on chunks of bounded size
(:mod:`terraloom.operators.sequences`).

Defined results: null and NaN are no readings; repeated rows of a key count once; a source with fewer than three usable readings has
no spikes; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.sequences import CHUNK, OWN, POS, chunk_sequences
from terraloom.runtime import materialise

#: Relative rank error of the quantile sketches is 1 / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000
STUCK_RUN = 6
LONGEST_SPIKE = 3
SPIKE_FACTOR = 10.0
_LEVEL = 5  # readings on either side that make up the level


@dataclass(frozen=True)
class Reading:
    """A measured field: its plausible range, and the period after which its values repeat (None: a plain number)."""

    name: str
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    period: float | None = None


def _impossible(r: Reading, v: Column) -> Column:
    tests = []
    if r.low is not None:
        tests.append(v <= r.low if r.low_open else v < r.low)
    if r.high is not None:
        tests.append(v > r.high)
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def long_readings(df: DataFrame, key: str, source: str, order: str, readings: list[Reading], values: dict[str, Column]) -> DataFrame:
    """One row (key, source, order, field, value, impossible) for each reading of each key; repeated rows of a key count once."""
    items = F.array(*(F.struct(F.lit(r.name).alias("field"), values[r.name].cast("double").alias("value"), _impossible(r, values[r.name]).alias("impossible")) for r in readings))
    one = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(order).alias("ord"), items.alias("items")).filter("key is not null")
    one = one.groupBy("key").agg(F.min(F.struct("source", "ord", "items")).alias("r")).select("key", "r.source", "r.ord", F.explode("r.items").alias("i"))
    return one.select("key", "source", "ord", "i.field", "i.value", "i.impossible").filter("value is not null and not isnan(value)")


def _gap(a: Column, b: Column, period: Column) -> Column:
    """Distance of two readings; with a period, on its circle."""
    d = F.abs(a - b)
    m = F.pmod(d, period)
    return F.when(period.isNull(), d).otherwise(F.least(m, period - m))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def stuck(readings: DataFrame, run: int = STUCK_RUN, chunk_rows: int = 65536) -> DataFrame:
    """``readings`` with ``is_stuck``: part of a run of ``run`` or more equal readings of its source; and ``free_step``: the change from
    the reading before, where neither is part of such a run."""
    c = chunk_sequences(readings, ["source", "field", "ord", "key"], chunk_rows, 4 * run)
    w = Window.partitionBy(CHUNK, "source", "field").orderBy(POS)
    same = F.coalesce((F.col("value") == F.lag("value").over(w)).cast("int"), F.lit(0))
    ends = F.coalesce((F.sum("_same").over(w.rowsBetween(-(run - 2), 0)) == run - 1).cast("int"), F.lit(0))
    c = c.withColumn("_same", same).withColumn("_ends", ends).withColumn("is_stuck", F.max("_ends").over(w.rowsBetween(0, run - 1)) == 1)
    c = c.withColumn("free_step", F.when(~F.col("is_stuck") & ~F.lag("is_stuck").over(w), F.abs(F.col("value") - F.lag("value").over(w))))
    return c.filter(OWN).drop(CHUNK, POS, OWN, "_same", "_ends")


def spikes(readings: DataFrame, periods: dict[str, float | None], factor: float = SPIKE_FACTOR, chunk_rows: int = 65536) -> DataFrame:
    """The readings that are one of at most three in a row which leave the level on both sides by more than ``factor`` times the
    source's usual change (the sketched median change between neighbours). The level on a side is its nearest reading and the
    majority of its nearest five, so a reading between two spikes stays and a lasting step is none."""
    known = [F.when(F.col("field") == k, F.lit(float(p))) for k, p in periods.items() if p is not None]
    period = F.coalesce(*known) if known else F.lit(None).cast("double")
    c = chunk_sequences(readings.withColumn("_period", period), ["source", "field", "ord", "key"], chunk_rows, 3 * (LONGEST_SPIKE + _LEVEL))
    w = Window.partitionBy(CHUNK, "source", "field").orderBy(POS)
    reach = LONGEST_SPIKE - 1 + _LEVEL
    v = {0: F.col("value")} | {k: F.col(f"_v{k}".replace("-", "m")) for k in range(-reach, reach + 1) if k}
    c = c.select("*", *((F.lag("value", -k) if k < 0 else F.lead("value", k)).over(w).alias(f"_v{k}".replace("-", "m")) for k in range(-reach, reach + 1) if k))
    p = F.col("_period")
    c = c.withColumn("_step", _gap(v[0], v[-1], p))
    usual = c.filter(OWN).groupBy("source", "field").agg(F.percentile_approx("_step", 0.5, SKETCH_ACCURACY).alias("usual_change"))
    usual = usual.withColumnsRenamed({"source": "_s", "field": "_f"})
    limit = F.col("_limit")
    far = lambda a, b: F.coalesce(_gap(a, b, p) > limit, F.lit(False))
    most = lambda ks: sum(F.when(v[k].isNull(), 0).when(far(v[k], v[0]), 1).otherwise(-1) for k in ks) > 0
    cases = []
    for length in range(1, LONGEST_SPIKE + 1):
        for start in range(-(length - 1), 1):
            end = start + length - 1
            leaves = [far(v[k], v[edge]) for k in range(start, end + 1) for edge in (start - 1, end + 1)]
            cases.append(reduce(lambda a, b: a & b, [*leaves, most(range(start - _LEVEL, start)), most(range(end + 1, end + _LEVEL + 1))]))
    own = c.filter(OWN).join(usual, F.col("source").eqNullSafe(F.col("_s")) & (F.col("field") == F.col("_f")))
    own = own.withColumn("_limit", factor * F.col("usual_change")).filter(_any(cases))
    return own.select("key", "source", "ord", "field", "value", "usual_change")


def implausible(df: DataFrame, key: str, source: str, order: str, readings: list[Reading], values: dict[str, Column], chunk_rows: int = 65536) -> DataFrame:
    """Rows (key, field, reason) with reason ``impossible``, ``stuck`` or ``spike``.

    A stuck run is a case only in a source whose reading otherwise varies: outside such runs the sketched median change between neighbours
    isn't zero, over more neighbours than one spike can make. Elsewhere equal readings are the level, from which a spike can leave."""
    rows = materialise(long_readings(df, key, source, order, readings, values))
    flagged = materialise(stuck(rows.filter("not impossible"), chunk_rows=chunk_rows))
    varies = flagged.groupBy(F.col("source").alias("_s"), F.col("field").alias("_f")).agg(
        ((F.percentile_approx("free_step", 0.5, SKETCH_ACCURACY) > 0) & (F.count("free_step") >= LONGEST_SPIKE)).alias("varies")
    )
    flagged = flagged.join(varies, F.col("source").eqNullSafe(F.col("_s")) & (F.col("field") == F.col("_f")))
    flagged = flagged.withColumn("is_case", F.col("is_stuck") & F.coalesce("varies", F.lit(False)))
    stuck_rows = flagged.filter("is_case")
    rest = flagged.filter("not is_case").select("key", "source", "ord", "field", "value")
    jumps = spikes(rest, {r.name: r.period for r in readings}, chunk_rows=chunk_rows)
    pick = lambda x, why: x.select("key", "field", F.lit(why).alias("reason"))
    return pick(rows.filter("impossible"), "impossible").unionByName(pick(stuck_rows, "stuck")).unionByName(pick(jumps, "spike"))


def hourly_fences(df: DataFrame, key: str, source: str, hour: Column, readings: list[Reading], values: dict[str, Column], spread: float = 3.0) -> DataFrame:
    """Readings outside ``[q1 - spread * iqr, q3 + spread * iqr]`` of their source in the same hour of day; quartiles are sketched."""
    rows = long_readings(df.withColumn("_hour", hour), key, source, "_hour", readings, values).filter("not impossible")
    q = rows.groupBy(F.col("source").alias("_s"), F.col("ord").alias("_h"), F.col("field").alias("_f")).agg(F.percentile_approx("value", [0.25, 0.75], SKETCH_ACCURACY).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    q = q.select("_s", "_h", "_f", (low - spread * (high - low)).alias("fence_low"), (high + spread * (high - low)).alias("fence_high"))
    out = rows.join(q, F.col("source").eqNullSafe(F.col("_s")) & F.col("ord").eqNullSafe(F.col("_h")) & (F.col("field") == F.col("_f")))
    out = out.filter((F.col("value") < F.col("fence_low")) | (F.col("value") > F.col("fence_high")))
    return out.select("key", "source", F.col("ord").alias("hour"), "field", "value", "fence_low", "fence_high")
