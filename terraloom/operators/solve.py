"""Least squares on poses, points and cameras: one dense problem for each group of images, solved by Levenberg-Marquardt in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import IntFlag

import numpy as np

ITERATIONS = 100
FOCAL_BOUNDS = (100.0, 20_000.0)


class Options(IntFlag):
    """What a solve may change, and on which surface."""

    ORIENTATION = 1
    POSITION = 2
    GROUND_PLANE = 4
    GROUND_MESH = 8
    MINIMAL_MESH = 16
    POINTS_3D = 32
    FOCAL = 64
    RADIAL_1 = 128
    RADIAL_2 = 256
    RADIAL_3 = 512
    PRINCIPAL_POINT = 1024
    TANGENTIAL = 2048
    LENS_MONOTONE = 4096

    def has_all(self, other: Options) -> bool:
        return self & other == other

    def has_any(self, other: Options) -> bool:
        return bool(self & other)

    def excess(self, other: Options) -> Options:
        return self & ~other


#: What the camera solve frees from one iteration to the next.
INTRINSICS_SCHEDULE = [
    Options.FOCAL,
    Options.FOCAL | Options.RADIAL_1,
    Options.FOCAL | Options.RADIAL_1 | Options.RADIAL_2,
    Options.FOCAL | Options.RADIAL_1 | Options.RADIAL_2 | Options.RADIAL_3 | Options.PRINCIPAL_POINT,
]


def rotation(v: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors (n, 3)."""
    v = np.atleast_2d(v)
    angle = np.linalg.norm(v, axis=1)
    k = np.where(angle[:, None] > 1e-12, v / np.maximum(angle[:, None], 1e-300), 0)
    z = np.zeros(len(v))
    s = np.stack([np.stack([z, -k[:, 2], k[:, 1]], 1), np.stack([k[:, 2], z, -k[:, 0]], 1), np.stack([-k[:, 1], k[:, 0], z], 1)], 1)
    a = angle[:, None, None]
    return np.eye(3) + np.sin(a) * s + (1 - np.cos(a)) * (s @ s)


def matrix(q: np.ndarray) -> np.ndarray:
    """Rotation matrices of quaternions (n, 4: x, y, z, w)."""
    x, y, z, w = (np.atleast_2d(q) / np.linalg.norm(np.atleast_2d(q), axis=1, keepdims=True)).T
    return np.stack([np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], 1), np.stack([2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], 1), np.stack([2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1)], 1)


def quaternion(r: np.ndarray) -> np.ndarray:
    """Unit quaternions (n, 4: x, y, z, w), w not negative, of rotation matrices (n, 3, 3): the dominant eigenvector of each one's form."""
    r = r.reshape(-1, 3, 3)
    k = np.zeros((len(r), 4, 4))
    t = np.trace(r, axis1=1, axis2=2)
    k[:, :3, :3] = r + np.transpose(r, (0, 2, 1)) - t[:, None, None] * np.eye(3)
    k[:, :3, 3] = k[:, 3, :3] = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], 1)
    k[:, 3, 3] = t
    q = np.linalg.eigh(k)[1][:, :, -1]
    return q * np.where(q[:, 3:] < 0, -1.0, 1.0)


def huber(r: np.ndarray, d: float) -> np.ndarray:
    """Weights whose squares make the plain loss a Huber loss."""
    a = np.abs(r)
    return np.sqrt(np.where(a <= d, 1.0, d / np.maximum(a, 1e-300)))


def levenberg(residuals: Callable[[np.ndarray], np.ndarray], x: np.ndarray, robust: float | None = None, iterations: int = ITERATIONS, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Minimise by damped normal equations with a forward-difference Jacobian. ``low`` and ``high`` bound the parameters."""
    x = x.astype(float).copy()
    clip = lambda v: v if low is None else np.clip(v, low, high)
    rho = lambda r: (np.where(np.abs(r) <= robust, r * r, 2 * robust * np.abs(r) - robust**2) if robust else r * r).sum()
    r, damp = residuals(x), 1e-3
    cost = rho(r)
    for _ in range(iterations):
        j = np.empty((len(r), len(x)))
        for k in range(len(x)):
            h = 1e-6 * max(1.0, abs(x[k]))
            y = x.copy()
            y[k] += h
            j[:, k] = (residuals(y) - r) / h
        w = huber(r, robust) if robust else np.ones_like(r)
        jw, rw = j * w[:, None], r * w
        a, g = jw.T @ jw, jw.T @ rw
        for _ in range(10):
            step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g, rcond=None)[0]
            y = clip(x + step)
            ry = residuals(y)
            c = rho(ry)
            if np.isfinite(c) and c < cost:
                done = cost - c <= 1e-12 * cost or np.linalg.norm(step) < 1e-12 * (1 + np.linalg.norm(x))
                x, r, cost, damp = y, ry, c, max(damp / 5, 1e-12)
                if done:
                    return x
                break
            damp *= 4
        else:
            return x
    return x


@dataclass
class Camera:
    focal: float
    pp: np.ndarray
    radial: np.ndarray
    tangential: np.ndarray

    def project(self, v: np.ndarray) -> np.ndarray:
        p = v[:, :2] / np.maximum(v[:, 2:], 1e-3)
        r2 = (p * p).sum(1, keepdims=True)
        s = 1 + self.radial[0] * r2 + self.radial[1] * r2**2 + self.radial[2] * r2**3
        t = self.tangential
        d = s * p + 2 * p[:, :1] * p[:, 1:] * t + t[::-1] * (r2 + 2 * p * p)
        return d * self.focal + self.pp


def monotone_radius(radial: np.ndarray) -> float:
    """The distance from the axis (at depth 1) up to which the radial distortion only grows; nothing beyond it has a pixel of its own."""
    roots = np.roots([7 * radial[2], 5 * radial[1], 3 * radial[0], 1.0])
    turns = roots[(np.abs(roots.imag) < 1e-9) & (roots.real > 0)].real
    return float(np.sqrt(turns.min())) if len(turns) else np.inf


def relative_orientations(rotations: np.ndarray, edges: np.ndarray, relative: np.ndarray, robust_degrees: float = 10.0, down_weight: float = 1e-2) -> np.ndarray:
    """Orientations (n, 3, 3) that best agree with ``relative`` rotations (edge i to j: R_j^T R_i), with a weak pull of the axes downwards.
    An unknown (NaN) orientation first looks down and north."""
    start = rotations.copy()
    start[~np.isfinite(start).all((1, 2))] = np.diag([1.0, -1.0, -1.0])
    n = len(start)

    def residuals(x: np.ndarray) -> np.ndarray:
        r = rotation(x.reshape(n, 3)) @ start
        d = np.einsum("eji,ejk->eik", r[edges[:, 1]], r[edges[:, 0]]) @ np.transpose(relative, (0, 2, 1))
        skew = np.stack([d[:, 2, 1] - d[:, 1, 2], d[:, 0, 2] - d[:, 2, 0], d[:, 1, 0] - d[:, 0, 1]], 1) / 2
        angle = np.arctan2(np.linalg.norm(skew, axis=1), (np.trace(d, axis1=1, axis2=2) - 1) / 2)
        norm = np.linalg.norm(skew, axis=1)
        v = np.where(norm[:, None] > 1e-12, skew * (angle / np.maximum(norm, 1e-300))[:, None], skew)
        return np.concatenate([v.ravel(), down_weight * (r[:, :2, 2]).ravel()])

    x = levenberg(residuals, np.zeros(3 * n), np.radians(robust_degrees), 50)
    return rotation(x.reshape(n, 3)) @ start


def bundle(camera: Camera, positions: np.ndarray, rotations: np.ndarray, points: np.ndarray, observations: np.ndarray, pixels: np.ndarray, options: Options = Options.ORIENTATION | Options.POINTS_3D, robust_px: float = 10.0, iterations: int = ITERATIONS) -> tuple[Camera, np.ndarray, np.ndarray, np.ndarray]:
    """Camera, positions, rotations and points that best explain ``pixels`` of ``observations`` (camera, point). Rotations map camera to world."""
    n, m = len(positions), len(points)
    blocks: list[tuple[str, int]] = []
    if options & Options.ORIENTATION:
        blocks.append(("turn", 3 * n))
    if options & Options.POSITION:
        blocks.append(("move", 3 * n))
    if options & Options.POINTS_3D:
        blocks.append(("points", 3 * m))
    if options & Options.FOCAL:
        blocks.append(("focal", 1))
    radial = [k for k, f in enumerate((Options.RADIAL_1, Options.RADIAL_2, Options.RADIAL_3)) if options & f]
    if radial:
        blocks.append(("radial", len(radial)))
    if options & Options.PRINCIPAL_POINT:
        blocks.append(("pp", 2))
    if options & Options.TANGENTIAL:
        blocks.append(("tangential", 2))
    ends = np.cumsum([s for _, s in blocks])
    cam, pt = observations[:, 0], observations[:, 1]

    def state(x: np.ndarray):
        part = dict(zip((b for b, _ in blocks), np.split(x, ends[:-1]))) if blocks else {}
        r = rotation(part["turn"].reshape(n, 3)) @ rotations if "turn" in part else rotations
        p = positions + part["move"].reshape(n, 3) if "move" in part else positions
        w = points + part["points"].reshape(m, 3) if "points" in part else points
        k = camera.radial.copy()
        if radial:
            k[radial] += part["radial"]
        focal = float(np.clip(camera.focal * np.exp(part["focal"][0]), *FOCAL_BOUNDS)) if "focal" in part else camera.focal
        c = Camera(focal, camera.pp + 100 * part["pp"] if "pp" in part else camera.pp, k, camera.tangential + part["tangential"] if "tangential" in part else camera.tangential)
        return c, p, r, w

    def residuals(x: np.ndarray) -> np.ndarray:
        c, p, r, w = state(x)
        v = np.einsum("nji,nj->ni", r[cam], w[pt] - p[cam])
        return (c.project(v) - pixels).ravel()

    return state(levenberg(residuals, np.zeros(int(ends[-1]) if blocks else 0), robust_px, iterations)) if blocks else state(np.zeros(0))


def ground_plane(camera: Camera, positions: np.ndarray, rotations: np.ndarray, pairs: np.ndarray, px1: np.ndarray, px2: np.ndarray, height: float, robust_degrees: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and plane (a, b, c of z = a x + b y + c) on which the rays of matched pixels (image pairs) meet."""
    n = len(positions)

    def bearing(px: np.ndarray) -> np.ndarray:
        p = (px - camera.pp) / camera.focal
        u = p.copy()
        for _ in range(10):
            u = u + p - (Camera(1.0, np.zeros(2), camera.radial, camera.tangential).project(np.column_stack([u, np.ones(len(u))])))
        return np.column_stack([u, np.ones(len(u))])

    b1, b2 = bearing(px1), bearing(px2)
    centre = positions.mean(0)

    def hit(r, p, b, plane):
        d = np.einsum("nij,nj->ni", r, b)
        t = (plane[0] * (p[:, 0] - centre[0]) + plane[1] * (p[:, 1] - centre[1]) + plane[2] - p[:, 2]) / (d[:, 2] - plane[0] * d[:, 0] - plane[1] * d[:, 1])
        return p + t[:, None] * d, np.abs(t)

    def residuals(x: np.ndarray) -> np.ndarray:
        r, plane = rotation(x[: 3 * n].reshape(n, 3)) @ rotations, x[3 * n :]
        h1, t1 = hit(r[pairs[:, 0]], positions[pairs[:, 0]], b1, plane)
        h2, t2 = hit(r[pairs[:, 1]], positions[pairs[:, 1]], b2, plane)
        gap = (h1 - h2) / np.maximum((t1 + t2) / 2, 1e-6)[:, None]
        return np.concatenate([gap.ravel(), 1e-3 * r[:, :2, 2].ravel()])

    x = levenberg(residuals, np.concatenate([np.zeros(3 * n), [0, 0, height]]), np.radians(robust_degrees), 60)
    a, b, c = x[3 * n :]
    return rotation(x[: 3 * n].reshape(n, 3)) @ rotations, np.array([a, b, c - a * centre[0] - b * centre[1]])


def triangulate(positions: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Point nearest to several rays."""
    d = directions / np.linalg.norm(directions, axis=1, keepdims=True)
    a = np.eye(3) - np.einsum("ni,nj->nij", d, d)
    return np.linalg.lstsq(a.sum(0), np.einsum("nij,nj->i", a, positions), rcond=None)[0]


def robust_centroid(points: np.ndarray, errors: np.ndarray, limit: float, most: int = 5, rounds: int = 3) -> np.ndarray:
    """Weighted middle of up to five points of least error; points far from it lose weight until the weights are even."""
    keep = np.argsort(errors, kind="stable")[:most]
    p, base = points[keep], 1 / (errors[keep] + 1e-8)
    w = base.copy()
    c = (p * w[:, None]).sum(0) / w.sum()
    for _ in range(rounds):
        e = np.linalg.norm(p - c, axis=1)
        w = base * np.where(e > limit, limit / np.maximum(e, 1e-300), 1.0)
        c = (p * w[:, None]).sum(0) / w.sum()
        if w.min() > w.max() / 2:
            break
    return c


def convert_model(camera: Camera, width: int, height: int, steps: int = 20) -> Camera:
    """The model of the other direction: coefficients that undo ``camera``'s distortion, fitted on a grid of about ``steps`` squared pixels."""
    g = np.stack(np.meshgrid(np.linspace(0, width, steps), np.linspace(0, height, steps)), -1).reshape(-1, 2)
    p = (g - camera.pp) / camera.focal
    plain = Camera(1.0, np.zeros(2), camera.radial, camera.tangential)
    d = plain.project(np.column_stack([p, np.ones(len(p))]))
    one = np.column_stack([d, np.ones(len(d))])
    x = levenberg(lambda k: (Camera(1.0, np.zeros(2), k[:3], k[3:]).project(one) - p).ravel(), np.zeros(5))
    return Camera(camera.focal, camera.pp, x[:3], x[3:])


def refine_point(camera: Camera, positions: np.ndarray, rotations: np.ndarray, pixels: np.ndarray, iterations: int = 50) -> np.ndarray:
    """Point of least pixel error from two or more views, started where their rays come closest."""
    back = convert_model(camera, int(2 * camera.pp[0]) or 1, int(2 * camera.pp[1]) or 1) if camera.radial.any() or camera.tangential.any() else camera
    u = Camera(1.0, np.zeros(2), back.radial, back.tangential).project(np.column_stack([(pixels - camera.pp) / camera.focal, np.ones(len(pixels))])) if back is not camera else (pixels - camera.pp) / camera.focal
    start = triangulate(positions, np.einsum("nij,nj->ni", rotations, np.column_stack([u, np.ones(len(u))])))
    view = lambda w: camera.project(np.einsum("nji,nj->ni", rotations, w - positions))
    return levenberg(lambda w: (view(w) - pixels).ravel(), start, iterations=iterations)


def monotone_distortion(camera: Camera, reach: float, samples: int = 10) -> np.ndarray:
    """Residuals that are positive where distortion turns back: growth of the distorted radius, at ``samples`` radii up to ``reach``."""
    r = np.linspace(0, reach, samples + 1)[1:]
    k = camera.radial
    return np.minimum(1 + 3 * k[0] * r**2 + 5 * k[1] * r**4 + 7 * k[2] * r**6, 0)


def ground_mesh(camera: Camera, positions: np.ndarray, rotations: np.ndarray, observations: np.ndarray, pixels: np.ndarray, vertices: np.ndarray, cells: np.ndarray, weights: np.ndarray, edges: np.ndarray, smooth: float = 1e-2, iterations: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(rotations, vertex heights): tracks are points on a mesh. Track t lies in the triangle ``cells[t]`` at ``weights[t]``; ``observations``
    are (camera, track). Neighbouring heights (``edges``) are pulled together weakly."""
    n, v = len(positions), len(vertices)
    xy = np.einsum("tk,tkc->tc", weights, vertices[cells][:, :, :2])

    def residuals(x: np.ndarray) -> np.ndarray:
        r, z = rotation(x[: 3 * n].reshape(n, 3)) @ rotations, x[3 * n :]
        p = np.column_stack([xy, (weights * z[cells]).sum(1)])
        d = np.einsum("nji,nj->ni", r[observations[:, 0]], p[observations[:, 1]] - positions[observations[:, 0]])
        return np.concatenate([(camera.project(d) - pixels).ravel(), smooth * (z[edges[:, 0]] - z[edges[:, 1]]), 1e-3 * r[:, :2, 2].ravel()])

    x = levenberg(residuals, np.concatenate([np.zeros(3 * n), vertices[:, 2]]), 10.0, iterations)
    return rotation(x[: 3 * n].reshape(n, 3)) @ rotations, x[3 * n :]


def solver_for(options: Options) -> str:
    """Which solve a set of options asks for, the most demanding first."""
    for flag, name in ((Options.GROUND_MESH, "ground_mesh"), (Options.POINTS_3D, "bundle"), (Options.GROUND_PLANE, "ground_plane")):
        if options & flag:
            return name
    return "relative_orientations"
