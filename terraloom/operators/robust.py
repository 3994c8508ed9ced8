"""Robust two-view models: a plug-in protocol, sample consensus, and three models on bearing pairs."""

from __future__ import annotations

from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from terraloom.runtime import spread

SEED, LEAST_ROUNDS, MOST_ROUNDS, CONFIDENCE, REFITS = 42, 20, 10_000, 0.999, 5
EARLY, EARLY_SHARE = 20, 0.6
POOL_EVERY = 10
BLOCK, BLOCK_CELLS = 500, 1 << 18  # samples bounded at once, and their errors held
#: Samples with triangles below FLAT of the spread, and pairs spread wider than WIDE, are too near degenerate to be bounded; SLACK is what
#: a bound allows for rounding, of a pair's part in the score.
FLAT, WIDE, SLACK = 1e-4, 10.0, 1e-6


class Model(Protocol):
    """What sample consensus needs of a model. ``a`` and ``b`` are bearings (n, 3); ``fit`` may return None for a degenerate sample."""

    points: int
    threshold: float

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray | None: ...
    def refit(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray | None: ...
    def error(self, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    # A model may also have ``bounds(a, b, picks)``: for each sample a score that its model doesn't exceed, infinite where that isn't known.


def _plane(v: np.ndarray) -> np.ndarray:
    return v[:, :2] / np.where(np.abs(v[:, 2:]) < 1e-12, 1e-12, v[:, 2:])


def _null(rows: np.ndarray) -> np.ndarray:
    return np.linalg.svd(rows)[2][-1]


def collinear(p: np.ndarray) -> np.ndarray:
    """Any three of four points on one line; of samples (k, 4, 2) for each."""
    flat = False
    for i, j, k in ((1, 2, 3), (0, 2, 3), (0, 1, 3), (0, 1, 2)):
        a, b, c = (p[..., n, :] for n in (i, j, k))
        flat |= np.abs((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])) < 1e-10
    return flat


def _centred(p: np.ndarray) -> tuple[np.ndarray, float]:
    """(points as (n, 3) around their mean within one, their spread)."""
    d = p - p.mean(0)
    scale = float(np.abs(d).max())
    return np.column_stack([d / max(scale, 1e-300), np.ones(len(p))]), scale


def _triangles(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of samples of four points (k, 4, 3): the lines opposite the first three, the fourth's products with them, the least triangle of each."""
    lines = np.stack([np.cross(x[:, 1], x[:, 2]), np.cross(x[:, 2], x[:, 0]), np.cross(x[:, 0], x[:, 1])], 1)
    fourth = np.einsum("krj,kj->kr", lines, x[:, 3])
    whole = np.einsum("kj,kj->k", lines[:, 0], x[:, 0])
    return lines, fourth, np.minimum(np.abs(fourth).min(1), np.abs(whole))


def _squared(h: np.ndarray, p: np.ndarray, q: np.ndarray, scale: float) -> np.ndarray:
    """(k, n) squared distances from ``q`` of ``p`` under homographies (k, 3, 3)."""
    to = (h.reshape(-1, 3) @ p.T).reshape(len(h), 3, -1)
    return (scale * (to[:, 0] / to[:, 2] - q[:, 0])) ** 2 + (scale * (to[:, 1] / to[:, 2] - q[:, 1])) ** 2


class Homography:
    points, threshold = 4, 0.005

    def _solve(self, p: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray | None:
        z, o = np.zeros((len(p), 3)), np.column_stack([p, np.ones(len(p))])
        rows = np.concatenate([np.column_stack([o, z, -q[:, :1] * o]), np.column_stack([z, o, -q[:, 1:] * o])]) * np.concatenate([w, w])[:, None]
        if len(rows) < 9:
            rows = np.vstack([rows, np.zeros((9 - len(rows), 9))])
        h = _null(rows).reshape(3, 3)
        return h / h[2, 2] if abs(h[2, 2]) > 1e-9 else h / np.linalg.norm(h)

    def fit(self, a, b):
        p, q = _plane(a), _plane(b)
        return None if collinear(p) or collinear(q) else self._solve(p, q, np.ones(len(p)))

    def refit(self, a, b, w):
        return self._solve(_plane(a), _plane(b), w)

    def bounds(self, a, b, picks):
        """By the four points' homography in closed form: a sample's own points add one each at most, and the others are looked at both
        ways only where one is near enough one way. Collinear points give none."""
        p, q = _plane(a), _plane(b)
        none = collinear(p[picks]) | collinear(q[picks])
        (p, scale_p), (q, scale_q) = _centred(p), _centred(q)
        if not (0 < scale_p < WIDE and 0 < scale_q < WIDE):
            return np.where(none, -np.inf, np.inf)
        x, y, near = p[picks], q[picks], self.threshold**2
        (c, u, least_p), (d, v, least_q) = _triangles(x), _triangles(y)
        sure = (least_p > FLAT) & (least_q > FLAT)
        hope = np.where(sure, float(self.points), np.inf)
        with np.errstate(all="ignore"):
            go = _squared(np.einsum("kri,kr,krj->kij", y[:, :3], v / u, c), p, q, scale_q) / 2
            go[np.arange(len(picks))[:, None], picks] = np.inf
            some = np.flatnonzero(sure & ~(go.min(1) >= near * (1 + SLACK)))
            if len(some):
                back = _squared(np.einsum("kri,kr,krj->kij", x[some, :3], u[some] / v[some], d[some]), q, p, scale_p) / 2
                more = np.maximum(0, 1 + SLACK - (go[some] + back) / near).sum(1)
                hope[some] += np.where(np.isnan(more), np.inf, more)
        return np.where(none, -np.inf, hope)

    def error(self, m, a, b):
        """Root mean square of the transfer errors both ways."""
        p, q = _plane(a), _plane(b)
        go = lambda h, x: _plane(np.column_stack([x, np.ones(len(x))]) @ h.T)
        try:
            back = np.linalg.inv(m)
        except np.linalg.LinAlgError:
            return np.full(len(a), np.inf)
        return np.sqrt((((go(m, p) - q) ** 2).sum(1) + ((go(back, q) - p) ** 2).sum(1)) / 2)

    def decompose(self, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Up to four (rotation, translation per plane distance, plane normal) of a plane's homography."""
        h = m / np.linalg.svd(m)[1][1]
        if np.linalg.det(h) < 0:
            h = -h
        _, s, vt = np.linalg.svd(h.T @ h)
        v1, v2, v3 = vt
        if np.linalg.det(vt) < 0:
            v1, v2, v3 = -v1, -v2, -v3
        if s[0] - s[2] < 1e-9:
            return [(h, np.zeros(3), np.array([0.0, 0.0, 1.0]))]
        a, b = np.sqrt(max(1 - s[2], 0)), np.sqrt(max(s[0] - 1, 0))
        out = []
        for sign in (1, -1):
            u = (a * v1 + sign * b * v3) / np.sqrt(s[0] - s[2])
            us = np.column_stack([v2, u, np.cross(v2, u)])
            ws = np.column_stack([h @ v2, h @ u, np.cross(h @ v2, h @ u)])
            r, n = ws @ us.T, np.cross(v2, u)
            t = (h - r) @ n
            out += [(r, t, n), (r, -t, -n)]
        return out

    @staticmethod
    def votes(r: np.ndarray, n: np.ndarray, a: np.ndarray) -> int:
        """Bearings in front of the plane in both views."""
        return int(((a @ n >= 0) & (a @ (r.T @ (r @ n)) >= 0)).sum())


def _sampson(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    fa, fb = a @ f.T, b @ f
    return np.abs((b * fa).sum(1)) / np.sqrt(np.maximum((fa[:, :2] ** 2).sum(1) + (fb[:, :2] ** 2).sum(1), 1e-18))


def _kron(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ni,nj->nij", b, a).reshape(len(a), 9)


def _flat(v: np.ndarray) -> np.ndarray:
    return np.column_stack([_plane(v), np.ones(len(v))])


class Fundamental:
    points, threshold = 8, 0.01
    PLANAR, OFF_PLANE = 0.7, 2

    def _rank2(self, f: np.ndarray) -> np.ndarray:
        u, s, vt = np.linalg.svd(f)
        return u @ np.diag([s[0], s[1], 0]) @ vt

    def _scaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = x[:, :2].mean(0)
        s = np.sqrt(2) / max(np.sqrt(((x[:, :2] - c) ** 2).sum(1)).mean(), 1e-12)
        t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
        return x @ t.T, t

    def refit(self, a, b, w):
        (x, tx), (y, ty) = self._scaled(_flat(a)), self._scaled(_flat(b))
        rows = _kron(x, y) * w[:, None]
        if len(rows) < 9:
            rows = np.vstack([rows, np.zeros((9 - len(rows), 9))])
        f = ty.T @ self._rank2(_null(rows).reshape(3, 3)) @ tx
        return f / max(np.linalg.norm(f), 1e-18)

    def fit(self, a, b):
        return self.refit(a, b, np.ones(len(a)))

    def error(self, m, a, b):
        return _sampson(m, _flat(a), _flat(b))

    def rescue(self, m: np.ndarray, a: np.ndarray, b: np.ndarray, inliers: np.ndarray, rng) -> np.ndarray:
        """Should most inliers lie in one plane, the plane and two points off it fix the model."""
        h, flat = consensus(Homography(), a[inliers], b[inliers], rounds=200)[1:]
        if h is None or flat.mean() < self.PLANAR or (~flat).sum() < self.OFF_PLANE:
            return m
        p, q = _flat(a), _flat(b)
        off = np.flatnonzero(Homography().error(h, a, b) > 3 * Homography.threshold)
        if len(off) < 2:
            return m
        best, score = m, np.maximum(0, 1 - (self.error(m, a, b) / self.threshold) ** 2).sum()
        lines = np.cross(p @ h.T, q)
        for _ in range(200):
            i, j = rng.choice(off, 2, replace=False)
            e = np.cross(lines[i], lines[j])
            f = np.array([[0, -e[2], e[1]], [e[2], 0, -e[0]], [-e[1], e[0], 0]]) @ h
            f = f / max(np.linalg.norm(f), 1e-18)
            s = np.maximum(0, 1 - (self.error(f, a, b) / self.threshold) ** 2).sum()
            if s > score:
                best, score = f, s
        return best


class Essential(Fundamental):
    points, threshold = 5, 0.01

    def fit(self, a, b):
        """The smoothest matrix that five pairs allow, put on equal singular values; the eight-point form takes over from there."""
        return self.refit(a, b, np.ones(len(a)))

    def refit(self, a, b, w):
        rows = _kron(_flat(a), _flat(b)) * w[:, None]
        if len(rows) < 9:
            rows = np.vstack([rows, np.zeros((9 - len(rows), 9))])
        u, _, vt = np.linalg.svd(_null(rows).reshape(3, 3))
        return u @ np.diag([1.0, 1.0, 0.0]) @ vt / np.sqrt(2)

    def decompose(self, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Four (rotation, direction)."""
        u, _, vt = np.linalg.svd(m)
        u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
        w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
        return [(r, s * u[:, 2]) for r in (u @ w @ vt, u @ w.T @ vt) for s in (1, -1)]

    def rescue(self, m, a, b, inliers, rng):
        return m


class _Draws:
    """The samples of :func:`consensus`, which follow from the number of pairs alone, so that the groups of a task share them."""

    def __init__(self, n: int, points: int, ranked: bool, seed: int):
        self.n, self.points, self.ranked, self.rng = n, points, ranked, np.random.default_rng(seed)
        self.order = self.rng.permutation(n)
        self.blocks: list[np.ndarray] = []
        self.states = [self.rng.bit_generator.state]

    def _draw(self, rng: np.random.Generator, r: int) -> np.ndarray:
        return rng.choice(min(self.n, self.points + r // POOL_EVERY) if self.ranked else self.n, self.points, replace=False)

    def block(self, k: int) -> np.ndarray:
        while len(self.blocks) <= k:
            s = len(self.blocks) * BLOCK
            self.blocks.append(np.array([self._draw(self.rng, r) for r in range(s, s + BLOCK)], np.int32))
            self.states.append(self.rng.bit_generator.state)
        return self.blocks[k]

    def after(self, rounds: int) -> np.random.Generator:
        """The generator as it is after so many samples."""
        rng, k = np.random.default_rng(0), rounds // BLOCK
        if k:
            self.block(k - 1)
        rng.bit_generator.state = self.states[k]
        for r in range(k * BLOCK, rounds):
            self._draw(rng, r)
        return rng


@lru_cache(maxsize=64)
def _draws(n: int, points: int, ranked: bool, seed: int) -> _Draws:
    return _Draws(n, points, ranked, seed)


def consensus(model: Model, a: np.ndarray, b: np.ndarray, quality: np.ndarray | None = None, rounds: int = MOST_ROUNDS, seed: int = SEED) -> tuple[float, np.ndarray | None, np.ndarray]:
    """(score per pair, model, inlier mask). Pairs of better (lower) quality are drawn first where it is known; a candidate that does badly
    on the first pairs in random order is dropped; a new best is refitted on its inliers. Samples whose bound is no better than the best
    aren't fitted: nothing would come of it."""
    n = len(a)
    none = np.zeros(n, bool)
    if n < model.points:
        return 0.0, None, none
    ranked = np.argsort(quality, kind="stable") if quality is not None and (quality != 0).any() else None
    draws = _draws(n, model.points, ranked is not None, seed)
    first = draws.order[:EARLY]

    def rate(m):
        e = model.error(m, a, b)
        return np.maximum(0, 1 - (e / model.threshold) ** 2).sum(), e < model.threshold

    best, found, mask, r, last = 0.0, None, none, 0, 0
    limit, least, step = rounds, min(LEAST_ROUNDS, rounds), max(1, min(BLOCK, BLOCK_CELLS // n))
    while r < limit:
        k, at = divmod(r, BLOCK)
        picks = draws.block(k)[at : at + step]
        picks = picks if ranked is None else ranked[picks]
        hope = model.bounds(a, b, picks) if hasattr(model, "bounds") else np.full(len(picks), np.inf)
        for i in np.flatnonzero(~(hope <= best)):
            if r + i >= limit:
                break
            if hope[i] <= best:
                continue
            pick = picks[i]
            m = model.fit(a[pick], b[pick])
            if m is None or not np.isfinite(m).all():
                continue
            if found is not None and n > 2 * EARLY:
                part = np.maximum(0, 1 - (model.error(m, a[first], b[first]) / model.threshold) ** 2).sum()
                if part < EARLY_SHARE * best * len(first) / n:
                    continue
            score, inside = rate(m)
            if score <= best:
                continue
            for _ in range(REFITS):
                if inside.sum() < max(model.points, 4):
                    break
                m2 = model.refit(a[inside], b[inside], np.ones(inside.sum()))
                if m2 is None:
                    break
                s2, i2 = rate(m2)
                if s2 <= score:
                    break
                m, score, inside = m2, s2, i2
            best, found, mask, last = score, m, inside, r + int(i) + 1
            share = min(best / n, 1 - 1e-9)
            if share > 0:
                need = np.log(1 - CONFIDENCE) / np.log(max(1 - share**model.points, 1e-300))
                limit = max(min(need, rounds), least)
        r += len(picks)
    if found is not None and hasattr(model, "rescue") and mask.sum() >= 8:
        m = model.rescue(found, a, b, mask, draws.after(max(last, int(np.ceil(limit)))))
        s, inside = rate(m)
        if s > best:
            best, found, mask = s, m, inside
    return best / n, found, mask


def ransac(df: DataFrame, by: str, model: Model, kind: str = "bigint") -> DataFrame:
    """(by, score, model, pairs, inliers) for each group of correspondences (a, b: arrays of 3; quality). One task holds one image pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(pdf["a"].to_numpy()).astype(float), np.stack(pdf["b"].to_numpy()).astype(float)
        ok = np.isfinite(a).all(1) & np.isfinite(b).all(1)
        order = np.lexsort((*b[ok].T, *a[ok].T))
        score, m, inside = consensus(model, a[ok][order], b[ok][order], pdf["quality"].to_numpy(float)[ok][order])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "score": [score], "model": [None if m is None else m.ravel().tolist()], "pairs": [len(pdf)], "inliers": [int(inside.sum())]})

    return spread(df, by).groupBy(by).applyInPandas(run, f"`{by}` {kind}, score double, model array<double>, pairs int, inliers int")


LEAST_INLIERS = Homography.points * 1.5  # a link holds with more of them
REFRESHES = 3
_LINK = "score double, relation array<double>, inliers int, decomposable boolean, accepted boolean, matches array<struct<idx1:int,idx2:int>>"


def _accepted(by: str, pdf: pd.DataFrame, score: float, m: np.ndarray | None, inside: np.ndarray, a: np.ndarray) -> pd.DataFrame:
    """One row of a link: its inlier matches only if the homography can be taken apart and enough of them are left; the link stays either way."""
    poses = [] if m is None or not np.isfinite(m).all() else Homography().decompose(m)
    decomposable = any(Homography.votes(r, n, a[inside]) > 0 for r, _, n in poses)
    accepted = decomposable and inside.sum() > LEAST_INLIERS
    pairs = sorted(zip(pdf["idx1"].to_numpy()[inside].tolist(), pdf["idx2"].to_numpy()[inside].tolist())) if accepted else []
    return pd.DataFrame({by: [pdf[by].iloc[0]], "score": [score], "relation": [None if m is None else m.ravel().tolist()], "inliers": [int(inside.sum())], "decomposable": [decomposable], "accepted": [bool(accepted)], "matches": [pairs]})


def _bearings(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    a, b = np.stack(pdf["a"].to_numpy()).astype(float), np.stack(pdf["b"].to_numpy()).astype(float)
    ok = np.isfinite(a).all(1) & np.isfinite(b).all(1)
    order = np.lexsort((*b[ok].T, *a[ok].T))
    return pdf[ok].iloc[order], a[ok][order], b[ok][order]


def accept_links(df: DataFrame, by: str, kind: str = "bigint") -> DataFrame:
    """(by, score, relation, inliers, decomposable, accepted, matches) for each group of correspondences (idx1, idx2, a, b, quality)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, a, b = _bearings(pdf)
        score, m, inside = consensus(Homography(), a, b, rows["quality"].to_numpy(float))
        return _accepted(by, rows if len(rows) else pdf, score, m, inside, a)

    return spread(df, by).groupBy(by).applyInPandas(run, f"`{by}` {kind}, {_LINK}")


def refresh_links(df: DataFrame, by: str, kind: str = "bigint") -> DataFrame:
    """As :func:`accept_links` for links whose cameras have changed, without sampling: from the matches that were inliers (``inlier``) the
    homography is fitted and the inliers taken again, three times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, a, b = _bearings(pdf)
        h, m, score = Homography(), None, 0.0
        inside = rows["inlier"].to_numpy(bool)
        for _ in range(REFRESHES):
            if inside.sum() < h.points:
                m, inside = None, np.zeros(len(rows), bool)
                break
            m = h.refit(a[inside], b[inside], np.ones(inside.sum()))
            e = h.error(m, a, b)
            inside, score = e < h.threshold, float(np.maximum(0, 1 - (e / h.threshold) ** 2).mean())
        return _accepted(by, rows if len(rows) else pdf, score, m, inside, a)

    return spread(df, by).groupBy(by).applyInPandas(run, f"`{by}` {kind}, {_LINK}")
