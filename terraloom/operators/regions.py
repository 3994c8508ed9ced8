"""Points near other points or in regions: ear-clipped triangles, distributed through a bounding-volume hierarchy.

A top hierarchy, split at the medians of a bounded sample of points, gives each point exactly one leaf and each triangle the leaves its
box overlaps. Within a leaf a linear hierarchy over the triangles finds candidates, which are tested exactly. Leaves with more points or
triangles than ``block_rows`` are split into blocks on both sides, and every pair of blocks is a task of its own: no crowded place is a
single task, and none sees more than ``block_rows`` of either side. Shared-boundary hits are dropped where they arise, over all blocks
where a leaf's triangles lie in several.

Defined results: points or polygons with null, NaN or unusable coordinates take part in nothing; polygons of zero area contain
nothing; a boundary counts as inside; a point in two regions gives two rows; repeated rows of a key count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.runtime import materialise

EARTH_RADIUS_M = 6_371_008.8
#: Most points fetched to place the splits of the top hierarchy.
SAMPLE_POINTS = 65_536
_LEAF = 8


def ear_clip(ring: np.ndarray) -> np.ndarray:
    """Triangles (n, 3, 2) of a simple polygon given as its corners; none for fewer than three different corners or zero area."""
    pts = [p for k, p in enumerate(map(tuple, np.asarray(ring, float))) if k == 0 or p != tuple(ring[k - 1])]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    if len(pts) < 3 or not np.isfinite(pts).all():
        return np.empty((0, 3, 2))
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1])) < 0:
        pts.reverse()
    out, idle = [], 0
    k = 0
    while len(pts) > 3 and idle < len(pts):
        n = len(pts)
        a, b, c = pts[(k - 1) % n], pts[k % n], pts[(k + 1) % n]
        turn = cross(a, b, c)
        if turn == 0:
            pts.pop(k % n)
            idle = 0
            continue
        others = (p for p in pts if p not in (a, b, c))
        if turn > 0 and not any(cross(a, b, p) >= 0 and cross(b, c, p) >= 0 and cross(c, a, p) >= 0 for p in others):
            out.append((a, b, c))
            pts.pop(k % n)
            idle = 0
        else:
            k, idle = k + 1, idle + 1
    if len(pts) == 3 and cross(*pts) > 0:
        out.append(tuple(pts))
    return np.array(out).reshape(-1, 3, 2)


class TopTree:
    """Axis-aligned splits of space: node k has children 2k+1 and 2k+2; the leaves are numbered from left to right. ``scale`` says how
    wide the boxes that will be looked up are along each axis, so that nodes are cut where they are widest in boxes."""

    def __init__(self, at: np.ndarray, depth: int, scale: np.ndarray | None = None):
        self.depth = depth
        inner = 2**depth - 1
        scale = np.ones(at.shape[1]) if scale is None else scale
        self.axis, self.at = np.zeros(inner, np.int8), np.zeros(inner)
        parts = {0: at}
        for k in range(inner):
            p = parts.pop(k)
            if len(p):
                self.axis[k] = axis = int(((p.max(0) - p.min(0)) / scale).argmax())
                v = p[:, axis]
                self.at[k] = np.median(v)
                if (v >= self.at[k]).all() and v.max() > self.at[k]:  # half of them at one value: cut behind it
                    self.at[k] = v[v > self.at[k]].min()
            right = p[:, self.axis[k]] >= self.at[k]
            parts[2 * k + 1], parts[2 * k + 2] = p[~right], p[right]

    def leaf_of(self, at: np.ndarray) -> np.ndarray:
        k, rows = np.zeros(len(at), np.int64), np.arange(len(at))
        for _ in range(self.depth):
            k = 2 * k + 1 + (at[rows, self.axis[k]] >= self.at[k])
        return k - (2**self.depth - 1)

    def leaves_of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf a box overlaps, edges included."""
        rows, k = np.arange(len(low)), np.zeros(len(low), np.int64)
        for _ in range(self.depth):
            a, s = self.axis[k], self.at[k]
            left, right = low[rows, a] < s, high[rows, a] >= s
            rows, k = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * k[left] + 1, 2 * k[right] + 2])
        return rows, k - (2**self.depth - 1)


class TriangleTree:
    """Linear bounding-volume hierarchy over triangles (n, 3, 2) in Morton order; with ``heights`` (n, 2) each holds in that range only."""

    def __init__(self, tri: np.ndarray, heights: np.ndarray | None = None):
        low, high = tri.min(1), tri.max(1)
        if heights is not None:
            low, high = np.column_stack([low, heights[:, 0]]), np.column_stack([high, heights[:, 1]])
        dims = low.shape[1]
        mid = (low + high) / 2
        span = np.maximum(np.ptp(mid, axis=0), 1e-300)
        q = ((mid - mid.min(0)) / span * 65535).astype(np.uint64)
        code = np.zeros(len(tri), np.uint64)
        for b in range(16):
            for d in range(dims):
                code |= ((q[:, d] >> np.uint64(b)) & np.uint64(1)) << np.uint64(dims * b + d)
        self.order = np.argsort(code, kind="stable")
        leaves = 1
        while leaves * _LEAF < len(tri):
            leaves *= 2
        pad = leaves * _LEAF - len(tri)
        self.low, self.high = low[self.order], high[self.order]
        lo = np.concatenate([self.low, np.full((pad, dims), np.inf)]).reshape(leaves, _LEAF, dims).min(1)
        hi = np.concatenate([self.high, np.full((pad, dims), -np.inf)]).reshape(leaves, _LEAF, dims).max(1)
        self.levels = [(lo, hi)]
        while len(lo) > 1:
            lo, hi = lo.reshape(-1, 2, dims).min(1), hi.reshape(-1, 2, dims).max(1)
            self.levels.insert(0, (lo, hi))
        self.tri = tri[self.order]

    def containing(self, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, triangle) for every triangle that contains a point, boundary included."""
        rows, node = np.arange(len(xy)), np.zeros(len(xy), np.int64)
        for k, (lo, hi) in enumerate(self.levels):
            if k:
                rows, node = np.repeat(rows, 2), (2 * node[:, None] + [0, 1]).ravel()
            inside = ((xy[rows] >= lo[node]) & (xy[rows] <= hi[node])).all(1)
            rows, node = rows[inside], node[inside]
        rows, t = np.repeat(rows, _LEAF), (node[:, None] * _LEAF + np.arange(_LEAF)).ravel()
        real = t < len(self.tri)
        rows, t = rows[real], t[real]
        boxed = ((xy[rows] >= self.low[t]) & (xy[rows] <= self.high[t])).all(1)
        rows, t = rows[boxed], t[boxed]
        p, c = xy[rows], self.tri[t]
        side = [(c[:, (k + 1) % 3, 0] - c[:, k, 0]) * (p[:, 1] - c[:, k, 1]) - (c[:, (k + 1) % 3, 1] - c[:, k, 1]) * (p[:, 0] - c[:, k, 0]) for k in range(3)]
        side = np.array(side)
        inside = (side >= 0).all(0) | (side <= 0).all(0)
        return rows[inside], self.order[t[inside]]


def _top_tree(points: DataFrame, axes: list[str], leaf_rows: int, scale: list[float] | None = None) -> TopTree:
    n = points.count()
    share = min(1.0, SAMPLE_POINTS / max(n, 1))
    sample = points.select(*(F.col(c).cast("double") for c in axes))
    sample = (sample.sample(share, seed=7) if share < 1 else sample).toPandas().to_numpy(float).reshape(-1, len(axes))
    depth = 0
    while n > leaf_rows * 2**depth and 2 ** (depth + 1) <= max(1, len(sample) // 4):
        depth += 1
    return TopTree(sample, depth, None if scale is None else np.array(scale))


def _join(points: DataFrame, triangles: DataFrame, tree: TopTree, match, schema: str, block_rows: int, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Bring points and triangles of a leaf together and run ``match(points, triangles)`` on each pair of blocks.

    ``points`` has the ``axes``, ``triangles`` ax … cy, and for a third axis its range z_low, z_high; both may have more columns."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=shared.value.leaf_of(b[list(axes)].to_numpy(float)))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = b[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy(float).reshape(-1, 3, 2)
            low, high = t.min(1), t.max(1)
            if len(axes) > 2:
                low, high = np.column_stack([low, b["z_low"]]), np.column_stack([high, b["z_high"]])
            rows, leaf = shared.value.leaves_of(low, high)
            yield b.iloc[rows].assign(leaf=leaf)

    ddl = lambda df: ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", leaf long"
    placed, spread_out = points.mapInPandas(place, ddl(points)), triangles.mapInPandas(spread, ddl(triangles))
    full = lambda df: {r.leaf: -(-r.n // block_rows) for r in df.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).collect()}
    p_blocks, t_blocks = full(placed), full(spread_out)

    def cut(df: DataFrame, own: dict, other: dict, mine: str, theirs: str) -> DataFrame:
        many = lambda d: F.coalesce(F.create_map(*(F.lit(int(v)) for kv in d.items() for v in kv))[F.col("leaf").cast("int")], F.lit(1)) if d else F.lit(1)
        df = df.withColumn(mine, F.pmod(F.xxhash64(*df.columns), many(own)).cast("int"))
        return df.withColumn(theirs, F.explode(F.sequence(F.lit(0), many(other).cast("int") - 1)) if other else F.lit(0))

    placed, spread_out = cut(placed, p_blocks, t_blocks, "_pb", "_tb"), cut(spread_out, t_blocks, p_blocks, "_tb", "_pb")

    def both(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        return match(p, t)

    keys = ["leaf", "_pb", "_tb"]
    out = placed.groupBy(*keys).cogroup(spread_out.groupBy(*keys)).applyInPandas(both, schema)
    return out.distinct() if t_blocks else out


def _pairs(p: pd.DataFrame, t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    if not len(p) or not len(t):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    heights = t[["z_low", "z_high"]].to_numpy(float) if "z_low" in t else None
    tree = TriangleTree(t[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy(float).reshape(-1, 3, 2), heights)
    return tree.containing(p[["x", "y"] if heights is None else ["x", "y", "alt"]].to_numpy(float))


def triangulate(polygons: DataFrame, key: str, ring: str, key_type: str = "bigint") -> DataFrame:
    """One row (region, ax, ay, bx, by, cx, cy) for each triangle of each polygon; ``ring`` is an array of [x, y]."""

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, r in zip(b["region"], b["ring"]):
                if r is None or any(c is None or len(c) != 2 for c in r):
                    continue
                rows += [(k, *t.ravel()) for t in ear_clip(np.array([list(c) for c in r], float).reshape(-1, 2))]
            yield pd.DataFrame(rows, columns=["region", "ax", "ay", "bx", "by", "cx", "cy"])

    schema = f"region {key_type}, ax double, ay double, bx double, by double, cx double, cy double"
    return polygons.select(F.col(key).alias("region"), F.col(ring).alias("ring")).filter("region is not null and ring is not null").mapInPandas(clip, schema)


def regions_of_points(points: DataFrame, key: str, x: str, y: str, polygons: DataFrame, region: str, ring: str, leaf_rows: int = 16384, block_rows: int = 65536) -> DataFrame:
    """Rows (key, region) for each region that contains a point. Shared-boundary hits within a region count once."""
    types = dict(points.dtypes), dict(polygons.dtypes)
    usable = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    usable = materialise(usable.filter("key is not null and x is not null and y is not null and not isnan(x) and not isnan(y)").dropDuplicates(["key"]))

    def match(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        i, j = _pairs(p, t)
        return pd.DataFrame({"key": p["key"].to_numpy()[i], "region": t["region"].to_numpy()[j]}).drop_duplicates()

    out = _join(usable, triangulate(polygons, region, ring, types[1][region]), _top_tree(usable, ["x", "y"], leaf_rows), match, f"key {types[0][key]}, region {types[1][region]}", block_rows)
    return out


def _discs(lat: np.ndarray, lon: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, ring) of longitude-latitude rectangles around the discs; one over the date line gives two."""
    d = metres / EARTH_RADIUS_M * (1 + 1e-9) + 1e-12
    phi = np.radians(lat)
    reach = np.sin(d) / np.maximum(np.cos(phi), 1e-300)
    wide = np.where((np.abs(phi) + d >= np.pi / 2) | (reach >= 1), 180.0, np.degrees(np.arcsin(np.minimum(reach, 1)))) * (1 + 1e-9) + 1e-10
    tall = np.degrees(d) + 1e-10
    west, east, south, north = lon - wide, lon + wide, lat - tall, lat + tall
    rows = np.arange(len(lat))
    full = wide >= 180
    west, east = np.where(full, -180.0, west), np.where(full, 180.0, east)
    over_w, over_e = west < -180, east > 180
    rows_all = np.concatenate([rows, rows[over_w], rows[over_e]])
    w = np.concatenate([np.maximum(west, -180), west[over_w] + 360, np.full(over_e.sum(), -180.0)])
    e = np.concatenate([np.minimum(east, 180), np.full(over_w.sum(), 180.0), east[over_e] - 360])
    s, n = south[rows_all], north[rows_all]
    return rows_all, np.stack([np.stack([w, s], 1), np.stack([e, s], 1), np.stack([e, n], 1), np.stack([w, n], 1)], 1)


def haversine_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b, c, d = map(np.radians, (lat1, lon1, lat2, lon2))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(h)))


def usable_places(points: DataFrame, key: str, lat: str, lon: str, alt: str) -> DataFrame:
    """(key, x, y, alt) of the points that are somewhere; longitudes from -180 up to 180, repeated rows of a key once."""
    p = points.select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(n) for c, n in ((lat, "y"), (lon, "lon"), (alt, "alt"))))
    ok = " and ".join(f"{c} is not null and not isnan({c})" for c in ("y", "lon", "alt"))
    p = p.filter(f"key is not null and {ok} and abs(y) <= 90 and abs(lon) < 1e6 and not (y = 0 and lon = 0)").dropDuplicates(["key"])
    return p.select("key", (F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180).alias("x"), (F.col("y") + 0.0).alias("y"), (F.col("alt") + 0.0).alias("alt"))


def place_classes(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, members): one row (key, x, y, alt) for each different place, with the smallest key there, and the rows (first, key)
    of all points at places that hold more than one."""
    classes = materialise(places.groupBy("x", "y", "alt").agg(F.min("key").alias("first"), F.count("*").alias("n")))
    several = classes.filter("n > 1").drop("n")
    members = places.join(several, ["x", "y", "alt"]).select("first", "key")
    return classes.select(F.col("first").alias("key"), "x", "y", "alt"), members


def points_nearby(points: DataFrame, key: str, lat: str, lon: str, alt: str, metres: float, climb: float, leaf_rows: int = 16384, block_rows: int = 65536) -> DataFrame:
    """Pairs (node_a, node_b), smaller key first, at most ``metres`` apart on the sphere and ``climb`` in altitude.

    Points at exactly one place are one representative until the end: pairs of representatives come from the hierarchy, and only they
    are written out for all members. Latitudes beyond 90 and (0, 0) are no places."""
    places = materialise(usable_places(points, key, lat, lon, alt))
    representatives, members = place_classes(places)
    near = nearby_places(representatives, metres, climb, leaf_rows, block_rows)
    members = materialise(members)
    if members.isEmpty():
        return near
    pairs = near.join(members.select(F.col("first").alias("node_a"), F.col("key").alias("_a")), "node_a", "left").join(members.select(F.col("first").alias("node_b"), F.col("key").alias("_b")), "node_b", "left")
    a, b = F.coalesce("_a", "node_a"), F.coalesce("_b", "node_b")
    pairs = pairs.select(F.least(a, b).alias("node_a"), F.greatest(a, b).alias("node_b"))
    one, two = members.select("first", F.col("key").alias("node_a")), members.select("first", F.col("key").alias("node_b"))
    return pairs.unionByName(one.join(two, "first").filter("node_a < node_b").select("node_a", "node_b"))


def nearby_places(p: DataFrame, metres: float, climb: float, leaf_rows: int = 16384, block_rows: int = 65536) -> DataFrame:
    """Pairs (node_a, node_b) of different places (key, x, y, alt).

    Around each place stands the region its disc fits into, clipped into triangles, from ``climb`` below to ``climb`` above; the places in
    them are the candidates and the great-circle distance decides. The top hierarchy splits by altitude too, so a crowd of places above
    each other is cut."""
    kind = dict(p.dtypes)["key"]

    def discs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, rings = _discs(b["y"].to_numpy(), b["x"].to_numpy(), metres)
            # Every ring is a convex quadrilateral, so one clipping serves the batch as corner numbers.
            corners = [[int(np.flatnonzero((np.array([[0, 0], [1, 0], [1, 1], [0, 1]]) == c).all(1))[0]) for c in t] for t in ear_clip(np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float))]
            tri = np.concatenate([rings[:, c] for c in corners])
            at = np.tile(rows, len(corners))
            out = pd.DataFrame(tri.reshape(-1, 6), columns=["ax", "ay", "bx", "by", "cx", "cy"])
            z = b["alt"].to_numpy()[at]
            yield pd.DataFrame({"owner": b["key"].to_numpy()[at], "olat": b["y"].to_numpy()[at], "olon": b["x"].to_numpy()[at], "oalt": z}).join(out).assign(z_low=z - climb, z_high=z + climb)

    schema = f"owner {kind}, olat double, olon double, oalt double, ax double, ay double, bx double, by double, cx double, cy double, z_low double, z_high double"

    def match(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        i, j = _pairs(p, t)
        a, b = t["owner"].to_numpy()[j], p["key"].to_numpy()[i]
        keep = a < b
        i, j = i[keep], j[keep]
        near = haversine_m(t["olat"].to_numpy()[j], t["olon"].to_numpy()[j], p["y"].to_numpy()[i], p["x"].to_numpy()[i]) <= metres
        near &= np.abs(t["oalt"].to_numpy()[j] - p["alt"].to_numpy()[i]) <= climb
        return pd.DataFrame({"node_a": t["owner"].to_numpy()[j[near]], "node_b": p["key"].to_numpy()[i[near]]}).drop_duplicates()

    wide = float(np.degrees(metres / EARTH_RADIUS_M))
    tree = _top_tree(p, ["x", "y", "alt"], leaf_rows, [wide, wide, max(climb, 1e-9)])
    return _join(p, p.mapInPandas(discs, schema), tree, match, f"node_a {kind}, node_b {kind}", block_rows, ("x", "y", "alt"))
