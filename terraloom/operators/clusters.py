"""k-means with balanced sizes and spectral clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.runtime import materialise

BALANCE_RATIO = 2.71828
MOST_DENSE = 4096  # nodes of one group that a dense eigenproblem may hold


def _assign(df: DataFrame, cols: list[str], centres: list[tuple[float, ...]]) -> Column:
    """Number of the nearest centre; ties to the smaller number."""
    d = [sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(cols[1:], m[1:])), (F.col(cols[0]) - float(m[0])) * (F.col(cols[0]) - float(m[0]))) for m in centres]
    return F.array_min(F.array(*(F.struct(x.alias("d"), F.lit(k).alias("c")) for k, x in enumerate(d))))["c"] if d else F.lit(None)


def lloyd(df: DataFrame, cols: list[str], centres: list[tuple[float, ...]], steps: int) -> DataFrame:
    """(cluster, n, c<column>…) after ``steps`` rounds. A round sends one row for each cluster to the driver."""
    rows = materialise(df.select(*cols))
    for k in range(steps):
        means = rows.groupBy(_assign(rows, cols, centres).alias("cluster")).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in cols))
        if k == steps - 1:
            return means
        found = {r.cluster: tuple(r[f"c{c}"] for c in cols) for r in means.collect()}
        centres = [found.get(i, m) for i, m in enumerate(centres)]
    return rows.limit(0).select(F.lit(0).alias("cluster"), F.lit(0).alias("n"), *(F.col(c).alias(f"c{c}") for c in cols))


def farthest_first(df: DataFrame, cols: list[str], k: int) -> list[tuple[float, ...]]:
    """Seeds: the smallest row, then again and again the row farthest from the seeds so far."""
    first = df.agg(F.min(F.struct(*cols)).alias("s")).first().s
    if first is None:
        return []
    seeds = [tuple(map(float, first))]
    while len(seeds) < k:
        d = F.least(*[e for m in seeds for e in [sum((F.pow(F.col(c) - v, 2) for c, v in zip(cols, m)), F.lit(0.0))]], F.lit(float("inf")))
        seeds.append(tuple(map(float, df.agg(F.max(F.struct(d.alias("d"), *cols)).alias("s")).first().s[1:])))
    return seeds


def kmeans(df: DataFrame, key: str, cols: list[str], k: int, rounds: int = 10, balanced: bool = False) -> DataFrame:
    """(key, cluster), clusters numbered from the largest. ``balanced``: a cluster more than BALANCE_RATIO times the smallest gives one of
    its ends as the smallest's next centre."""
    rows = materialise(df.select(F.col(key).alias("key"), *cols).filter(" and ".join(f"`{c}` is not null" for c in cols)))
    centres = farthest_first(rows, cols, k)
    if not centres:
        return rows.select(F.col("key").alias(key), F.lit(0).alias("cluster"))
    for r in range(rounds):
        at = rows.withColumn("cluster", _assign(rows, cols, centres))
        found = {x.cluster: x for x in at.groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in cols), *(F.stddev_pop(c).alias(f"s_{c}") for c in cols)).collect()}
        new = [tuple(found[i][c] for c in cols) if i in found else m for i, m in enumerate(centres)]
        sizes = [found[i].n if i in found else 0 for i in range(len(new))]
        if balanced and r < rounds - 1 and max(sizes) > BALANCE_RATIO * max(1, min(sizes)):
            big, small = int(np.argmax(sizes)), int(np.argmin(sizes))
            spread = [found[big][f"s_{c}"] for c in cols]
            new[small] = tuple(m + s for m, s in zip(new[big], spread))
            new[big] = tuple(m - s for m, s in zip(new[big], spread))
        elif new == centres:
            break
        centres = new
    at = rows.withColumn("c", _assign(rows, cols, centres))
    order = [x.c for x in sorted(at.groupBy("c").agg(F.count("*").alias("n")).collect(), key=lambda x: (-x.n, x.c))]
    names = F.create_map(*(F.lit(v) for i, c in enumerate(order) for v in (c, i)))
    return at.select(F.col("key").alias(key), names[F.col("c")].alias("cluster"))


def spectral_groups(n: int, edges: np.ndarray, weights: np.ndarray, k: int, places: np.ndarray, self_weight: float = 0.1, rounds: int = 10) -> np.ndarray:
    """Cluster of each of ``n`` nodes, numbered from the largest. Each component of linked nodes is clustered by itself from the first
    eigenvectors of its normalised Laplacian, nodes without a link together by ``places``. Of ``k`` clusters each of these parts has one,
    the others go to the part with the most nodes for each of its clusters; with more parts than ``k`` there are as many clusters as parts."""
    if k <= 1 or n <= k:
        return np.zeros(n, int) if k <= 1 else np.arange(n)
    edges, weights = np.asarray(edges, int).reshape(-1, 2), np.asarray(weights, float)
    other = edges[:, 0] != edges[:, 1]
    edges, weights = edges[other], weights[other]
    found = connected(n, edges)
    parts = [p for p in found if len(p) > 1]
    alone = [p for p in found if len(p) == 1]
    if alone:
        parts.append(np.concatenate(alone))
    share = np.ones(len(parts), int)
    for _ in range(k - len(parts)):
        share[np.argmax([len(p) / s for p, s in zip(parts, share)])] += 1
    at, of = np.zeros(n, int), np.empty(n, int)
    for c, p in enumerate(parts):
        of[p], at[p] = c, np.arange(len(p))
    clusters, first = np.zeros(n, int), 0
    for c, (p, s) in enumerate(zip(parts, share)):
        if s > 1 and alone and c == len(parts) - 1:
            clusters[p] = first + _small_kmeans(places[p], int(s), rounds)
        elif s > 1:
            own = of[edges[:, 0]] == c
            v = _eigenvectors(len(p), at[edges[own]], weights[own], int(s), self_weight)
            clusters[p] = first + _small_kmeans(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), int(s), rounds)
        else:
            clusters[p] = first
        first += s
    return _by_size(clusters, first)


def _eigenvectors(n: int, edges: np.ndarray, weights: np.ndarray, k: int, self_weight: float) -> np.ndarray:
    """(n, k): first eigenvectors of the normalised Laplacian; by Lanczos steps on the links where a dense matrix would be too large."""
    i, j = edges.T
    root = 1 / np.sqrt(self_weight + np.bincount(i, weights, n) + np.bincount(j, weights, n))
    if n > MOST_DENSE:
        w = weights * root[i] * root[j]
        return _leading(lambda x: self_weight * root * root * x + np.bincount(i, w * x[j], n) + np.bincount(j, w * x[i], n), n, k)
    a = np.eye(n) * self_weight
    np.add.at(a, (i, j), weights)
    np.add.at(a, (j, i), weights)
    return np.linalg.eigh(np.eye(n) - root[:, None] * a * root)[1][:, :k]


def _leading(times, n: int, k: int, tolerance: float = 1e-8, every: int = 50) -> np.ndarray:
    """(n, k): eigenvectors of the greatest eigenvalues of a symmetric matrix given by its product ``times``, by Lanczos steps that go on
    until their residuals are within ``tolerance``."""
    rng = np.random.default_rng(0)
    q, diagonal, beside = np.empty((0, n)), [], []
    x = rng.normal(size=n)
    x /= np.linalg.norm(x)
    while True:
        if len(q) == len(diagonal):
            q = np.concatenate([q, np.empty((every, n))])
        m = len(diagonal)
        q[m] = x
        y = times(x)
        diagonal.append(float(x @ y))
        for _ in range(2):
            y -= q[: m + 1].T @ (q[: m + 1] @ y)
        size = float(np.linalg.norm(y))
        last = m + 1 == n
        if last or (m + 1) % every == 0 and m + 1 > k:
            values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
            if last or size * np.abs(vectors[-1, -k:]).max() <= tolerance and size > 1e-10:
                return q[: m + 1].T @ vectors[:, ::-1][:, :k]
        if size <= 1e-10:  # all of one invariant subspace: go on beside it
            y, size = rng.normal(size=n), 0.0
            for _ in range(2):
                y -= q[: m + 1].T @ (q[: m + 1] @ y)
        beside.append(size)
        x = y / np.linalg.norm(y)


def connected(n: int, edges: np.ndarray) -> list[np.ndarray]:
    """Nodes of each component of ``n`` nodes, breadth first from its smallest node; components in the order of those."""
    near: dict[int, set[int]] = {}
    for i, j in edges:
        near.setdefault(int(i), set()).add(int(j))
        near.setdefault(int(j), set()).add(int(i))
    seen, parts = np.zeros(n, bool), []
    for start in range(n):
        if seen[start]:
            continue
        part, seen[start] = [start], True
        for node in part:
            for other in sorted(near.get(node, ())):
                if not seen[other]:
                    seen[other] = True
                    part.append(other)
        parts.append(np.array(part))
    return parts


def link_groups(n: int, edges: np.ndarray, size: int, least: int) -> list[np.ndarray]:
    """Groups of about ``size`` of ``n`` nodes: components side by side, none cut unless it is larger than a group; a last group under
    ``least`` goes to the one before."""
    groups: list[np.ndarray] = []
    for part in connected(n, edges):
        for piece in np.split(part, range(size, len(part), size)):
            if groups and len(groups[-1]) + len(piece) <= size:
                groups[-1] = np.concatenate([groups[-1], piece])
            else:
                groups.append(piece)
    if len(groups) > 1 and len(groups[-1]) < least:
        last = groups.pop()
        groups[-1] = np.concatenate([groups[-1], last])
    return groups


def _small_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    c = [x[0]]
    while len(c) < k:
        c.append(x[np.min([((x - m) ** 2).sum(1) for m in c], axis=0).argmax()])
    c = np.array(c)
    for _ in range(rounds):
        at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(k)])
    return _by_size(at, k)


def _by_size(at: np.ndarray, k: int) -> np.ndarray:
    order = np.argsort(-np.bincount(at, minlength=k), kind="stable")
    rank = np.empty(k, int)
    rank[order] = np.arange(k)
    return rank[at]


def group_count(images: int, intrinsics: bool) -> int:
    """How many groups a solve is cut into."""
    return max(1, images // (150 if intrinsics else 50))
