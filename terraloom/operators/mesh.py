"""Terrain meshes: built and counted as tables, refined in one task (a mesh is a bounded table)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.operators.neighbours import knn_join

MOST_CELLS = 1000
DEPTH = 10
MOST_POINTS = 20  # of a triangle that isn't refined
LEAST_SIZE = 1.0  # metres of the longest edge; smaller triangles aren't refined


def grid_mesh(cameras: DataFrame, spacing: float, margin: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a regular triangle mesh over the cameras (node_id, x, y, z) and a margin; a vertex has the height of its nearest camera. A side has at most MOST_CELLS cells, as in the original: above that, spacing grows with the extent.

    nodes: node_id, x, y, z. edges: edge_id, src, dst, border, opp0, opp1."""
    spark = cameras.sparkSession
    e = cameras.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if e[0] is None:
        n = spark.createDataFrame([], "node_id bigint, x double, y double, z double")
        return n, spark.createDataFrame([], "edge_id bigint, src bigint, dst bigint, border boolean, opp0 bigint, opp1 bigint")
    x0, y0 = e[0] - margin, e[2] - margin
    w, h = (min(MOST_CELLS, max(1, int(np.ceil((hi + margin - lo) / spacing)))) for lo, hi in ((x0, e[1]), (y0, e[3])))
    dx, dy = max((e[1] + margin - x0) / w, 1e-9), max((e[3] + margin - y0) / h, 1e-9)
    g = spark.range((w + 1) * (h + 1)).select(F.col("id").alias("p"), (x0 + dx * (F.col("id") % (w + 1))).alias("px"), (y0 + dy * F.floor(F.col("id") / (w + 1))).alias("py"))
    near = knn_join(g, cameras.select(F.col("node_id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy")), 1).select("p", "q")
    nodes = g.join(near, "p").join(cameras.select(F.col("node_id").alias("q"), "z"), "q").select(F.col("p").alias("node_id"), F.col("px").alias("x"), F.col("py").alias("y"), "z")
    # Cells are cut along the diagonal from their low corner; every cell gives its bottom, left and diagonal edges, the last row and column their outer ones.
    c = spark.range((w + 1) * (h + 1)).select((F.col("id") % (w + 1)).alias("i"), F.floor(F.col("id") / (w + 1)).alias("j"))
    at = lambda i, j: (i + j * (w + 1)).cast("bigint")
    i, j = F.col("i"), F.col("j")
    low = F.when((i < w), F.struct(at(i, j).alias("src"), at(i + 1, j).alias("dst"), ((j == 0) | (j == h)).alias("border"), F.when(j < h, at(i + 1, j + 1)).alias("opp0"), F.when(j > 0, at(i, j - 1)).alias("opp1")))
    left = F.when((j < h), F.struct(at(i, j).alias("src"), at(i, j + 1).alias("dst"), ((i == 0) | (i == w)).alias("border"), F.when(i < w, at(i + 1, j + 1)).alias("opp0"), F.when(i > 0, at(i - 1, j)).alias("opp1")))
    diagonal = F.when((i < w) & (j < h), F.struct(at(i, j).alias("src"), at(i + 1, j + 1).alias("dst"), F.lit(False).alias("border"), at(i + 1, j).alias("opp0"), at(i, j + 1).alias("opp1")))
    edges = c.select(F.explode(F.array_compact(F.array(low, left, diagonal))).alias("e")).select("e.*")
    return nodes, edges.select((F.col("src") * 4 + F.when(F.col("dst") == F.col("src") + 1, 0).when(F.col("dst") == F.col("src") + w + 1, 1).otherwise(2)).alias("edge_id"), "src", "dst", "border", "opp0", "opp1")


def minimal_mesh(cameras: DataFrame, margin: float) -> tuple[DataFrame, DataFrame]:
    """Four vertices around the cameras at their mean height, with two triangles."""
    b = cameras.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("z").alias("z")).filter("x0 is not null")
    corner = lambda k, x, y: F.struct(F.lit(k).cast("bigint").alias("node_id"), x.alias("x"), y.alias("y"), F.col("z"))
    x0, x1, y0, y1 = F.col("x0") - margin, F.col("x1") + margin, F.col("y0") - margin, F.col("y1") + margin
    nodes = b.select(F.explode(F.array(corner(0, x0, y0), corner(1, x1, y0), corner(2, x0, y1), corner(3, x1, y1))).alias("n")).select("n.*")
    edges = cameras.sparkSession.createDataFrame([(0, 0, 1, True, 3, None), (1, 1, 3, True, 0, None), (2, 2, 3, True, 0, None), (3, 0, 2, True, 3, None), (4, 0, 3, False, 1, 2)], "edge_id bigint, src bigint, dst bigint, border boolean, opp0 bigint, opp1 bigint")
    return nodes, edges


class Mesh:
    """A triangle mesh in memory that refines without hanging vertices: a triangle is cut at its longest edge, after its neighbour there
    was refined until that edge is its longest, too."""

    def __init__(self, xyz: np.ndarray, triangles: np.ndarray):
        self.xyz = [np.array(p, float) for p in xyz]
        self.triangles = {i: tuple(map(int, t)) for i, t in enumerate(triangles)}
        self.next = len(self.triangles)
        self.at: dict[frozenset, set[int]] = {}
        for i, t in self.triangles.items():
            self._add(i, t)

    def _add(self, i: int, t: tuple) -> None:
        self.triangles[i] = t
        for k in range(3):
            self.at.setdefault(frozenset((t[k], t[(k + 1) % 3])), set()).add(i)

    def _drop(self, i: int) -> None:
        t = self.triangles.pop(i)
        for k in range(3):
            e = frozenset((t[k], t[(k + 1) % 3]))
            self.at[e].discard(i)
            if not self.at[e]:
                del self.at[e]

    def longest(self, t: tuple) -> frozenset:
        """Longest edge in the plane; ties to the smaller vertices."""
        length = lambda a, b: float(((self.xyz[a][:2] - self.xyz[b][:2]) ** 2).sum())
        edges = [(t[k], t[(k + 1) % 3]) for k in range(3)]
        return frozenset(max(edges, key=lambda e: (round(length(*e), 9), -min(e), -max(e))))

    def bisect(self, edge: frozenset) -> None:
        a, b = sorted(edge)
        self.xyz.append((self.xyz[a] + self.xyz[b]) / 2)
        m = len(self.xyz) - 1
        for i in sorted(self.at[edge]):
            t = self.triangles[i]
            self._drop(i)
            for old in (a, b):
                self._add(self.next, tuple(m if v == old else v for v in t))
                self.next += 1

    def refine(self, i: int, depth: int = DEPTH) -> None:
        if i not in self.triangles:
            return
        e = self.longest(self.triangles[i])
        for j in sorted(self.at[e] - {i}):
            if depth and self.longest(self.triangles[j]) != e:
                self.refine(j, depth - 1)
        if i in self.triangles and e in self.at:
            self.bisect(e)

    def refine_where(self, wanted, passes: int = 10) -> int:
        """Refine triangles whose middle ``wanted(x, y, z)`` accepts, until none is left or the passes are over; the number of cuts."""
        cuts = 0
        for _ in range(passes):
            hit = [i for i, t in self.triangles.items() if wanted(*np.mean([self.xyz[v] for v in t], axis=0))]
            if not hit:
                break
            for i in hit:
                if i in self.triangles:
                    self.refine(i)
                    cuts += 1
        return cuts

    def conforming(self) -> bool:
        return all(len(s) <= 2 for s in self.at.values())

    def tables(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        n = pd.DataFrame(np.array(self.xyz), columns=["x", "y", "z"]).rename_axis("node_id").reset_index()
        rows = []
        for k, (e, ts) in enumerate(sorted(self.at.items(), key=lambda x: tuple(sorted(x[0])))):
            a, b = sorted(e)
            opp = [next(v for v in self.triangles[i] if v not in e) for i in sorted(ts)]
            rows.append((k, a, b, len(opp) == 1, opp[0], opp[1] if len(opp) > 1 else None))
        return n, pd.DataFrame(rows, columns=["edge_id", "src", "dst", "border", "opp0", "opp1"]).astype({"opp1": "Int64"})


class PointMesh(Mesh):
    """A mesh whose triangles know which of the points (n, 3) lie in them; each point is held by one triangle."""

    def __init__(self, xyz: np.ndarray, triangles: np.ndarray, points: np.ndarray):
        super().__init__(xyz, triangles)
        self.points = points[np.isfinite(points).all(1)]
        self.held: dict[int, np.ndarray] = {}
        free = np.arange(len(self.points))
        for i in sorted(self.triangles):
            inside = self._inside(i, free)
            self.held[i], free = free[inside], free[~inside]

    def _inside(self, i: int, rows: np.ndarray) -> np.ndarray:
        p, (a, b, c) = self.points[rows], (self.xyz[v][:2] for v in self.triangles[i])
        s = [(t[0] - f[0]) * (p[:, 1] - f[1]) - (t[1] - f[1]) * (p[:, 0] - f[0]) for f, t in ((a, b), (b, c), (c, a))]
        return ~((np.min(s, 0) < 0) & (np.max(s, 0) > 0))

    def bisect(self, edge: frozenset) -> None:
        old, new = [self.held.pop(i) for i in sorted(self.at[edge])], self.next
        super().bisect(edge)
        for k, rows in enumerate(old):
            one, two = new + 2 * k, new + 2 * k + 1
            inside = self._inside(one, rows)
            self.held[one], self.held[two] = rows[inside], rows[~inside]

    def variance(self, i: int) -> float:
        """Of the points' distances from the triangle's plane, as in :func:`triangle_counts`."""
        a, b, c = (self.xyz[v] for v in self.triangles[i])
        n = np.cross(b - a, c - a)
        return float(np.var((self.points[self.held[i]] - a) @ n / max(np.linalg.norm(n), 1e-300)))

    def crowded(self, i: int, most: int, least_variance: float, least_size: float) -> bool:
        if len(self.held[i]) <= most:
            return False
        t = self.triangles[i]
        size = max(float(np.linalg.norm(self.xyz[t[k]][:2] - self.xyz[t[(k + 1) % 3]][:2])) for k in range(3))
        return size >= least_size and self.variance(i) > least_variance

    def refine_crowded(self, most: int = MOST_POINTS, least_variance: float = 0.0, least_size: float = LEAST_SIZE) -> None:
        """Refine until no triangle has more than ``most`` points whose distances from its plane vary by more than ``least_variance`` and a
        longest edge of at least ``least_size``."""
        todo = sorted(self.triangles)
        while todo:
            new = self.next
            for i in todo:
                if i in self.triangles and self.crowded(i, most, least_variance, least_size):
                    self.refine(i)
            todo = range(new, self.next)  # the others hold what they held


def triangle_counts(points: DataFrame, corners: DataFrame, cell: float) -> DataFrame:
    """(t, n, mean, variance) of the points' distances from the plane of the triangle (t, ax … cz) they lie in; a point on a shared edge
    counts in the smaller t. Triangles meet points by the grid cells their boxes cover."""
    span = lambda c: F.sequence(F.floor(F.least(f"a{c}", f"b{c}", f"c{c}") / cell), F.floor(F.greatest(f"a{c}", f"b{c}", f"c{c}") / cell))
    t = corners.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))
    p = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    from terraloom.functions import geom

    col = lambda *n: tuple(map(F.col, n))
    a, b, c = col("ax", "ay", "az"), col("bx", "by", "bz"), col("cx", "cy", "cz")
    hit = p.join(t, ["_cx", "_cy"]).filter(geom.in_triangle(col("x", "y"), a[:2], b[:2], c[:2]))
    n = geom.plane(a, b, c)
    length = F.sqrt(geom.dot(n, n))
    hit = hit.withColumn("g", geom.dot(n, geom.sub(col("x", "y", "z"), a)) / length * F.signum(n[2]))
    one = hit.groupBy("_id").agg(F.min(F.struct("t", "g")).alias("m")).select("m.*")
    var = F.when(F.count("*") > 1, F.greatest(F.avg(F.col("g") * F.col("g")) - F.avg("g") * F.avg("g"), F.lit(0.0))).otherwise(F.lit(0.0))
    return one.groupBy("t").agg(F.count("*").alias("n"), F.avg("g").alias("mean"), var.alias("variance"))


def merge_surfaces(nodes: DataFrame) -> DataFrame:
    """(node_id, x, y, z) from rows (surface_id, node_id, x, y, z, weight): weighted mean of what the surfaces say of a vertex, or what the
    first says where none has weight."""
    w = F.sum("weight")
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("weight")) / F.nullif(w, F.lit(0.0)), F.min_by(c, "surface_id")).alias(c)
    return nodes.groupBy("node_id").agg(*map(mean, "xyz"))


def ray_hits(directions: np.ndarray, origins: np.ndarray, xyz: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triangle, point) that each ray meets first; -1 and NaN where it misses. Vertical rays go by the triangles' boxes first; the mesh is
    bounded, rays come in batches."""
    a, b, c = (xyz[triangles[:, k]] for k in range(3))
    best, where = np.full(len(origins), -1), np.full((len(origins), 3), np.nan)
    e1, e2 = b - a, c - a
    for k, (d, o) in enumerate(zip(directions, origins)):
        p = np.cross(d, e2)
        det = (e1 * p).sum(1)
        ok = np.abs(det) > 1e-9
        inv = np.where(ok, 1 / np.where(ok, det, 1), 0)
        s = o - a
        u = (s * p).sum(1) * inv
        q = np.cross(s, e1)
        v, t = (q @ d) * inv, (e2 * q).sum(1) * inv
        hit = np.flatnonzero(ok & (u >= -1e-12) & (v >= -1e-12) & (u + v <= 1 + 1e-12) & (t >= 0))
        if len(hit):
            i = hit[np.argmin(t[hit])]
            best[k], where[k] = i, o + t[i] * d
    return best, where


def ground_triangle(cameras: np.ndarray, height: float) -> np.ndarray:
    """Three corners at ``height`` that hold all cameras' places."""
    lo, hi = cameras[:, :2].min(0), cameras[:, :2].max(0)
    size = max((hi - lo).max(), 1.0) * 4
    m = (lo + hi) / 2
    return np.array([[m[0] - size, m[1] - size, height], [m[0] + size, m[1] - size, height], [m[0], m[1] + size, height]])


#: What a walk over the mesh ends with.
HIT, PARALLEL, OUTSIDE, INCONSISTENT, UNINITIALIZED = "INTERSECTION", "RAY_PARALLEL_TO_PLANE", "OUTSIDE_BORDER", "GRAPH_STRUCTURE_INCONSISTENT", "UNINITIALIZED"
MOST_STEPS = 100


class Walker:
    """Where rays meet a mesh given as tables (``Mesh.tables``): all rays of a batch walk at once, each from triangle to triangle across
    the edge its plane hit lies beyond, from a common first triangle. A walk of more than MOST_STEPS ends where it is, as a hit."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        self.xyz = nodes[["x", "y", "z"]].to_numpy(float)
        at = {n: i for i, n in enumerate(nodes["node_id"])}
        self.corners, self.across = np.zeros((0, 3), int), np.zeros((0, 3), int)
        found: dict[tuple, int] = {}
        beside: dict[tuple, list[int]] = {}
        for a, b, o0, o1 in zip(edges["src"], edges["dst"], edges["opp0"], edges["opp1"]):
            for o in (o0, o1):
                if not pd.isna(o):
                    t = tuple(sorted((at[a], at[b], at[int(o)])))
                    k = found.setdefault(t, len(found))
                    if k not in beside.setdefault(tuple(sorted((at[a], at[b]))), []):
                        beside[tuple(sorted((at[a], at[b])))].append(k)
        if found:
            self.corners = np.array(list(found), int)
            p = self.xyz[self.corners]
            u, v = p[:, 1, :2] - p[:, 0, :2], p[:, 2, :2] - p[:, 0, :2]
            turned = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0] < 0
            self.corners[turned, :2] = self.corners[turned, 1::-1]
            # Beyond the edge from corner k to the next: another triangle, -1 for the border, -2 for an edge the tables don't have.
            known = {tuple(sorted((at[a], at[b]))) for a, b in zip(edges["src"], edges["dst"])}
            self.across = np.full(self.corners.shape, -2)
            for i, t in enumerate(self.corners):
                for k in range(3):
                    e = tuple(sorted((t[k], t[(k + 1) % 3])))
                    if e in known:
                        self.across[i, k] = next((j for j in beside[e] if j != i), -1)

    def walk(self, directions: np.ndarray, origins: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code, triangle, point, steps) of each ray."""
        n = len(origins)
        code, at, where, steps = np.full(n, UNINITIALIZED, object), np.full(n, start), np.full((n, 3), np.nan), np.zeros(n, int)
        if not len(self.corners):
            return code, at, where, steps
        code[:] = ""
        todo = np.arange(n)
        while len(todo):
            p = self.xyz[self.corners[at[todo]]]
            normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
            normal /= np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)
            slope = (normal * directions[todo]).sum(1)
            flat = ~(np.abs(slope) >= 1e-9)
            t = (normal * (p[:, 0] - origins[todo])).sum(1) / np.where(flat, 1.0, slope)
            hit = origins[todo] + t[:, None] * directions[todo]
            hit[flat] = np.nan
            where[todo] = hit
            nxt = np.roll(p, -1, axis=1)
            side = (nxt[:, :, 0] - p[:, :, 0]) * (hit[:, None, 1] - p[:, :, 1]) - (nxt[:, :, 1] - p[:, :, 1]) * (hit[:, None, 0] - p[:, :, 0])
            beyond = side < 0
            edge = beyond.argmax(1)
            inside = ~beyond.any(1)
            then = self.across[at[todo], edge]
            long = steps[todo] >= MOST_STEPS
            code[todo[flat]] = PARALLEL
            code[todo[~flat & (inside | long)]] = HIT
            go = ~flat & ~inside & ~long
            code[todo[go & (then == -1)]] = OUTSIDE
            code[todo[go & (then == -2)]] = INCONSISTENT
            go &= then >= 0
            at[todo[go]] = then[go]
            steps[todo[go]] += 1
            todo = todo[go]
        return code, at, where, steps
