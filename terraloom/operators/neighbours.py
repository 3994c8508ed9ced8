"""Exact nearest-neighbour and radius joins: blocks of the leaves of a sampled hierarchy, or grid cells, never a cross join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.regions import TopTree
from terraloom.runtime import materialise

_ROUNDS = 40
#: Most points fetched to choose the first cell side, or to place the splits of a hierarchy.
SAMPLE_POINTS = 65_536
LEAF_ROWS, BLOCK_ROWS = 512, 8192
#: Points in the first slice of an order; every further slice holds four times as many.
FIRST_SLICE = 4096


def _around(df: DataFrame, reach: int = 1) -> DataFrame:
    """Each probe row once for each cell of its neighbourhood."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    df = df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return df.withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy")).drop("_dx", "_dy")


def _cells(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(x) / side)).withColumn("_cy", F.floor(F.col(y) / side))


def _usable(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return df.filter(f"`{key}` is not null and `{x}` is not null and `{y}` is not null and not isnan(`{x}`) and not isnan(`{y}`)")


def radius_join(probes: DataFrame, points: DataFrame, radius: float, p_xy: tuple[str, str] = ("px", "py"), q_xy: tuple[str, str] = ("qx", "qy"), on: tuple[str, ...] = (), block_rows: int = 16384) -> DataFrame:
    """All pairs at most ``radius`` apart with equal ``on`` columns, with d2. Other column names of the two sides must differ; cells have
    the radius as side, so none is lost. Cells with more than ``block_rows`` points are cut into blocks, and each probe there meets every
    block in a task of its own, so a crowded cell is spread over many."""
    a, b = _cells(probes, *p_xy, radius), _cells(points, *q_xy, radius)
    keys = ["_cx", "_cy", *on]
    full = materialise(b.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks")).filter("_blocks > 1"))
    a = _around(a)
    if not full.isEmpty():  # at most rows / block_rows cells
        many = F.coalesce("_blocks", F.lit(1))
        b = b.join(full, keys, "left").withColumn("_block", F.pmod(F.xxhash64(*points.columns), many).cast("int")).drop("_blocks")
        a = a.join(full, keys, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), many - 1))).drop("_blocks")
        keys.append("_block")
    dx, dy = F.col(p_xy[0]) - F.col(q_xy[0]), F.col(p_xy[1]) - F.col(q_xy[1])
    return a.join(b, keys).withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") <= radius * radius).drop("_cx", "_cy", "_block")


def _first_side(points: DataFrame, n: int, extent: float, k: int) -> float:
    """The cell side at which a point's own cell holds about k points, as the points are spread: from a bounded sample."""
    share = min(1.0, SAMPLE_POINTS / n)
    xy = points.select("qx", "qy")
    xy = (xy.sample(share, seed=5) if share < 1 else xy).toPandas().to_numpy(float)
    side = extent
    for _ in range(_ROUNDS // 2):
        c = np.unique(np.floor(xy / side), axis=0, return_counts=True)[1].astype(float)
        if not len(c) or ((c - 1) * c).sum() / c.sum() / share <= k:
            break
        side /= 2
    return side


def _nearest(d2: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest finite values of each row, sorted by row, value and q."""
    if d2.shape[1] > k:
        edge = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        i, j = np.nonzero((d2 <= edge) & np.isfinite(d2))
    else:
        i, j = np.nonzero(np.isfinite(d2))
    order = np.lexsort((q[j], d2[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def _slices(points: DataFrame, n: int, order: bool) -> list[tuple[object, int, DataFrame]]:
    """(greatest order, about how many, points up to it) of slices that grow fourfold; the last holds all. About where they end is enough."""
    if not order:
        return [(None, n, points)]
    shares = []
    while FIRST_SLICE * 4 ** len(shares) < n:
        shares.append(FIRST_SLICE * 4 ** len(shares) / n)
    ends = sorted(set(points.agg(F.percentile_approx("_until", shares, 1000)).first()[0])) if shares else []
    return [(e, min(n, FIRST_SLICE * 4**k), points.filter(F.col("_until") <= F.lit(e))) for k, e in enumerate(ends)] + [(None, n, points)]


def knn_join(probes: DataFrame, points: DataFrame, k: int, until: tuple[str, str] | None = None, on: tuple[str, ...] = (), axes: str = "xy", leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(p, q, d2, rank): the k nearest points of each probe, ties to the smaller q. ``probes`` has p, px, py (, pz) and ``points`` q, qx, qy
    (, qz) as ``axes`` says. With ``until`` = (column of the probes, column of the points) only points whose order isn't above the
    probe's count; with ``on`` only those with equal columns (then in the plane, by cells).

    Probes at one place (and order) are looked up once. Of the points at one place (and order) only the k smallest can count, so a place
    that holds a third of all points is cut before anything is joined. Points are cut into slices by their order, each four times the one
    before, and a probe looks into the smallest slice that holds all its order allows: at least a quarter of what it meets counts, and
    probes that fewer than k points precede meet the first slice only. A slice has a hierarchy placed by a bounded sample; a probe's own
    leaf bounds its k-th distance, and only leaves within that distance are looked at besides. Leaves with more than ``block_rows`` rows
    are cut into blocks on both sides."""
    if on:
        if until is not None or axes != "xy":
            raise ValueError("joins on columns are in the plane and without order")
        return _knn_by_cells(probes, points, k, on)
    ps, qs = [f"p{a}" for a in axes], [f"q{a}" for a in axes]
    kinds = dict(probes.dtypes)["p"], dict(points.dtypes)["q"]
    number = "bigint" if until is None else dict(points.dtypes)[until[1]]
    order = lambda c: F.lit(0).cast("bigint") if c is None else F.col(c)
    fit = lambda df, key, cols: df.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) for c in cols), F.col(key).isNotNull() & F.col("_until").isNotNull()))
    all_ = probes.select("p", *(F.col(c).cast("double").alias(c) for c in ps), order(until and until[0]).alias("_until"))
    all_ = materialise(fit(all_, "p", ps))
    asked = materialise(all_.groupBy(*ps, "_until").agg(F.min("p").alias("p")))
    held = fit(points.select("q", *(F.col(c).cast("double").alias(c) for c in qs), order(until and until[1]).alias("_until")), "q", qs)
    held = materialise(held.withColumn("_k", F.row_number().over(Window.partitionBy(*qs, "_until").orderBy("q"))).filter(F.col("_k") <= k).drop("_k"))
    n = held.count()
    trees, ends = [], []
    for end, size, part in _slices(held, n, until is not None) if n else []:
        share = min(1.0, SAMPLE_POINTS / max(size, 1))
        sample = (part.sample(share, seed=5) if share < 1 else part).select(*qs).toPandas().to_numpy(float).reshape(-1, len(qs))
        depth = 0
        while size > leaf_rows * 2**depth and 2 ** (depth + 1) <= max(1, len(sample) // 4):
            depth += 1
        low, high = (sample.min(0), sample.max(0)) if len(sample) else (np.zeros(len(qs)), np.zeros(len(qs)))
        trees.append((TopTree(sample, depth), low, high))
        ends.append(end)
    if not trees:
        return _nothing(all_, held)
    shared = all_.sparkSession.sparkContext.broadcast(trees)
    later = [F.col("_until") > F.lit(e) for e in ends[:-1]]  # a probe's slice: how many ends it lies behind
    piece = reduce(lambda a, b: a + b, (c.cast("int") for c in later), F.lit(0))
    asked = asked.withColumn("_slice", piece)
    held = held.withColumn("_slice", F.explode(F.sequence(piece, F.lit(len(ends) - 1))))

    def place(cols: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                at, leaf = b[cols].to_numpy(float), np.zeros(len(b), np.int64)
                for g in set(b["_slice"]):
                    rows = (b["_slice"] == g).to_numpy()
                    leaf[rows] = shared.value[g][0].leaf_of(at[rows])
                yield b.assign(_leaf=leaf)

        return run

    p_ddl = f"p {kinds[0]}, " + ", ".join(f"{c} double" for c in ps) + f", _until {number}, _slice int"
    q_ddl = f"q {kinds[1]}, " + ", ".join(f"{c} double" for c in qs) + f", _until {number}, _slice int, _leaf bigint"
    held = materialise(held.select("q", *qs, "_until", "_slice").mapInPandas(place(qs), q_ddl))
    spot = ["_slice", "_leaf"]

    def crowded(df: DataFrame, name: str) -> DataFrame | None:
        """How many blocks the leaves with more than ``block_rows`` rows are cut into: at most rows / block_rows; nothing where there are none."""
        sizes = df.groupBy(*spot).agg(F.count("*").alias("_n"))
        if (sizes.agg(F.max("_n")).first()[0] or 0) <= block_rows:
            return None
        return materialise(sizes.filter(F.col("_n") > block_rows).select(*spot, F.ceil(F.col("_n") / block_rows).cast("int").alias(name)))

    q_full = crowded(held, "_qn")
    none = lambda name: all_.sparkSession.createDataFrame([], f"_slice int, _leaf bigint, {name} int")
    found = f"p {kinds[0]}, " + ", ".join(f"{c} double" for c in ps) + f", _until {number}, _slice int, _leaf bigint, near array<struct<d2:double,q:{kinds[1]}>>"

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        near = [[] for _ in range(len(a))]
        if len(a) and len(b):
            x, y, q = a[ps].to_numpy(float), b[qs].to_numpy(float), b["q"].to_numpy()
            reach = a["_reach"].to_numpy(float)
            step = max(1, (1 << 21) // len(b))
            for s in range(0, len(a), step):
                d2 = sum(np.square(x[s : s + step, None, c] - y[None, :, c]) for c in range(len(ps)))
                d2[d2 > reach[s : s + step, None]] = np.inf
                if until is not None:
                    d2[b["_until"].to_numpy()[None] > a["_until"].to_numpy()[s : s + step, None]] = np.inf
                i, j = _nearest(d2, q, k)
                cuts = np.searchsorted(i, np.arange(len(d2) + 1))
                pairs = list(zip(d2[i, j].tolist(), q[j].tolist()))
                for r in range(len(d2)):
                    near[s + r] = pairs[cuts[r] : cuts[r + 1]]
        lists = np.empty(len(a), object)
        lists[:] = near
        return a[["p", *ps, "_until", *spot]].assign(near=lists)

    def look(a: DataFrame) -> DataFrame:
        """``a`` (p, …, _slice, _leaf, _reach) with what its leaf holds within the reach."""
        b, keys = held, list(spot)
        a_full = crowded(a, "_pn")
        if q_full is not None or a_full is not None:
            one = lambda c: F.coalesce(F.col(c), F.lit(1))
            cuts = (none("_pn") if a_full is None else a_full).join(none("_qn") if q_full is None else q_full, spot, "full")
            a, b = a.join(cuts, spot, "left"), b.join(cuts, spot, "left")
            a = a.withColumn("_pb", F.pmod(F.xxhash64("p"), one("_pn")).cast("int")).withColumn("_qb", F.explode(F.sequence(F.lit(0), one("_qn") - 1))).drop("_pn", "_qn")
            b = b.withColumn("_qb", F.pmod(F.xxhash64("q"), one("_qn")).cast("int")).withColumn("_pb", F.explode(F.sequence(F.lit(0), one("_pn") - 1))).drop("_pn", "_qn")
            keys += ["_pb", "_qb"]
        out = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(match, found)
        return _merged(out, ps, spot, k) if q_full is not None else out

    first = look(asked.select("p", *ps, "_until", "_slice").mapInPandas(place(ps), p_ddl + ", _leaf bigint").withColumn("_reach", F.lit(float("inf"))))
    first = materialise(first)
    whole = F.element_at(F.array(*(F.lit(t.depth == 0) for t, _, _ in trees)), F.col("_slice") + 1)  # one leaf is all there is
    kth = F.get("near", F.lit(k - 1))["d2"]
    settled = first.filter(whole).select("p", "near")
    others = first.filter(~whole)

    def around(own: bool):
        """Each probe once for every leaf within its reach, its own only if ``own``."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                at, r = b[ps].to_numpy(float), np.sqrt(b["_reach"].to_numpy(float))[:, None] * (1 + 1e-9)
                for g in set(b["_slice"]):
                    rows = np.flatnonzero((b["_slice"] == g).to_numpy())
                    i, leaf = shared.value[g][0].leaves_of(at[rows] - r[rows], at[rows] + r[rows])
                    out = b.iloc[rows[i]].assign(_leaf=leaf, _own=b["_leaf"].to_numpy()[rows[i]])
                    yield (out if own else out[out["_leaf"] != out["_own"]]).drop(columns="_own")

        return run

    reach_ddl = p_ddl + ", _leaf bigint, _reach double"
    bounded = others.filter(kth.isNotNull())
    more = look(bounded.select("p", *ps, "_until", *spot, kth.alias("_reach")).mapInPandas(around(False), reach_ddl))
    done = settled.unionByName(bounded.select("p", "near")).unionByName(more.filter(F.size("near") > 0).select("p", "near"))
    open_ = materialise(others.filter(kth.isNull()).select("p", *ps, "_until", *spot))
    span = max(float((hi - lo).max()) for _, lo, hi in trees)
    spread = open_.select(F.max(reduce(F.greatest, [F.abs(F.col(c)) for c in ps]))).first()[0] or 0.0
    far = 2 * (span + spread + max(float(np.abs(np.concatenate([lo, hi])).max()) for _, lo, hi in trees)) + 1.0
    reach = max(span, 1e-9) / 2 ** max(t.depth / len(qs) for t, _, _ in trees)
    for _ in range(_ROUNDS):
        if open_.isEmpty():
            break
        reach = reach * 2 if reach * 2 < span else far
        got = look(open_.withColumn("_reach", F.lit(reach * reach)).mapInPandas(around(True), reach_ddl))
        got = materialise(_merged(got, ps, ["_slice"], k))
        ready = got.filter(F.lit(reach >= far) | (F.size("near") >= k)).select("p", "near")
        done = done.unionByName(ready)
        if reach >= far:
            break
        open_ = materialise(open_.join(ready.select("p"), "p", "left_anti"))
    else:
        raise RuntimeError("nearest neighbours are still open")
    near = done.groupBy("p").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    near = near.select("p", F.posexplode("near").alias("rank", "x")).select("p", "x.q", "x.d2", (F.col("rank") + 1).alias("rank"))
    if asked.count() == all_.count():
        return near
    first_of = asked.select(*(F.col(c).alias(f"_{c}") for c in [*ps, "_until"]), F.col("p").alias("_first"))
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in [*ps, "_until"]))
    members = all_.join(first_of, same).select("p", "_first")
    return members.join(near.withColumnRenamed("p", "_first"), "_first").select("p", "q", "d2", "rank")


def _merged(found: DataFrame, ps: list[str], spot: list[str], k: int) -> DataFrame:
    """One row for each probe with the k nearest of what its rows found."""
    one = found.groupBy("p", *spot).agg(*(F.first(c).alias(c) for c in [*ps, "_until"]), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return one.select("p", *ps, "_until", *spot, "near")


def _knn_by_cells(probes: DataFrame, points: DataFrame, k: int, on: tuple[str, ...]) -> DataFrame:
    """:func:`knn_join` with equal ``on`` columns. Of the points at one place only the k smallest are kept. A round looks at the 3 x 3 cells
    around each open probe; it is settled once its k-th distance is within a cell side, as nothing nearer can lie outside, or at once where
    its group has no more than k points. The others go on with cells of twice the side, until a round covers the whole extent."""
    points = _usable(points, "q", "qx", "qy")
    place = Window.partitionBy(*on, "qx", "qy").orderBy("q")
    points = points.withColumn("_k", F.row_number().over(place)).filter(F.col("_k") <= k).drop("_k")
    probes, points = materialise(_usable(probes, "p", "px", "py")), materialise(points)
    e = points.agg(F.count("*"), F.min("qx"), F.max("qx"), F.min("qy"), F.max("qy")).first()
    f = probes.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if not e[0] or f[0] is None:
        return _nothing(probes, points)
    extent = max(max(e[2], f[1]) - min(e[1], f[0]), max(e[4], f[3]) - min(e[3], f[2]), 1e-9)
    side = _first_side(points, e[0], extent, k)
    w = Window.partitionBy("p").orderBy("d2", "q")
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    ranked = lambda pairs: pairs.select("p", "q", (dx * dx + dy * dy).alias("d2")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    small = materialise(points.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") <= k).select(*on))
    done = materialise(ranked(probes.join(small, list(on)).join(points, list(on))))
    open_ = materialise(probes.join(small, list(on), "left_anti"))
    for _ in range(_ROUNDS):
        last = side >= extent
        a = _around(_cells(open_, "px", "py", side))
        pairs = a.join(_cells(points, "qx", "qy", side), ["_cx", "_cy", *on])
        best = materialise(ranked(pairs))
        if last:
            return done.unionByName(best)
        settled = best.filter((F.col("rank") == k) & (F.col("d2") <= side * side)).select("p")
        now = best.join(settled, "p", "left_semi")
        done = done.unionByName(now)
        open_ = materialise(open_.join(settled, "p", "left_anti"))
        if open_.isEmpty():
            return done
        side *= 2
    raise RuntimeError("nearest neighbours are still open")


def _nothing(probes: DataFrame, points: DataFrame) -> DataFrame:
    return probes.limit(0).select("p").join(points.limit(0).select("q"), F.lit(False), "left").select("p", "q", F.lit(0.0).alias("d2"), F.lit(0).alias("rank"))


def median_spacing(points: DataFrame) -> DataFrame:
    """(spacing): root of the middle one of the squared distances to the nearest other point. The middle is found by counting: distances
    are sorted over ranges, and only the range that holds it is numbered."""
    second = materialise(knn_join(points.select(F.col("q").alias("p"), F.col("qx").alias("px"), F.col("qy").alias("py")), points, 2).filter("rank = 2").select("d2"))
    spark = points.sparkSession
    part = materialise(second.repartitionByRange("d2").withColumn("_part", F.spark_partition_id()))
    sizes = sorted(map(tuple, part.groupBy("_part").count().collect()))
    at, before = sum(n for _, n in sizes) // 2, 0
    for p, n in sizes:
        if before <= at < before + n:
            one = part.filter(F.col("_part") == p).orderBy("d2").offset(at - before).limit(1)
            return one.select(F.sqrt("d2").alias("spacing"))
        before += n
    return spark.createDataFrame([(None,)], "spacing double")
