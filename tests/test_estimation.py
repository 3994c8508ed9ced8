import numpy as np
import pytest

from terraloom.operators import colour, robust, solve


def homography_scene(n, outliers, seed=42):
    rng = np.random.default_rng(seed)
    c, s = np.cos(0.1), np.sin(0.1)
    h = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) + np.outer([0.05, -0.03, 0], [0, 0, 1]) / 10
    p = rng.uniform(-1, 1, (n, 2))
    q = np.column_stack([p, np.ones(n)]) @ h.T
    a, b = np.column_stack([p, np.ones(n)]), q / q[:, 2:]
    a = np.concatenate([a, np.column_stack([rng.uniform(-2, 2, (outliers, 2)), np.ones(outliers)])])
    b = np.concatenate([b, np.column_stack([rng.uniform(-2, 2, (outliers, 2)), np.ones(outliers)])])
    return a, b, np.arange(n + outliers) < n, h


def epipolar_scene(n, outliers, planar=0.0, seed=42):
    rng = np.random.default_rng(seed)
    c, s = np.cos(0.15), np.sin(0.15)
    r = np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])
    z = np.where(np.arange(n) < planar * n, 10.0, rng.uniform(5, 15, n))
    x = np.column_stack([rng.uniform(-3, 3, (n, 2)), z])
    a, b = x / z[:, None], (x - [0.5, 0, 0]) @ r.T
    b = b / b[:, 2:]
    a = np.concatenate([a, np.column_stack([rng.uniform(-0.5, 0.5, (outliers, 2)), np.ones(outliers)])])
    b = np.concatenate([b, np.column_stack([rng.uniform(-0.5, 0.5, (outliers, 2)), np.ones(outliers)])])
    return a, b, np.arange(n + outliers) < n


def rates(found, truth):
    return (found & truth).sum() / max(1, found.sum()), (found & truth).sum() / truth.sum()


@pytest.mark.parametrize("n, out, precision, recall", [(200, 0, 0.99, 0.99), (140, 60, 0.90, 0.85), (80, 120, 0.80, 0.70), (40, 160, 0.70, 0.60)])
def test_homography(n, out, precision, recall):
    a, b, truth, h = homography_scene(n, out)
    score, m, found = robust.consensus(robust.Homography(), a, b)
    p, r = rates(found, truth)
    assert p >= precision and r >= recall
    if not out:
        assert np.abs(m / m[2, 2] - h / h[2, 2]).max() < 1e-6 and score > 0.99


def test_near_degenerate_homography():
    rng = np.random.default_rng(1)
    a, b, _, h = homography_scene(80, 0)
    line = np.column_stack([rng.uniform(-1, 1, 20), 0.5 + rng.uniform(-0.001, 0.001, 20), np.ones(20)])
    to = line @ h.T
    _, m, found = robust.consensus(robust.Homography(), np.concatenate([line, a]), np.concatenate([to / to[:, 2:], b]))
    assert found.mean() >= 0.95 and np.abs(m / m[2, 2] - h / h[2, 2]).max() < 1e-6


@pytest.mark.parametrize("model", [robust.Fundamental(), robust.Essential()])
@pytest.mark.parametrize("n, out, planar, precision, recall", [(200, 0, 0.0, 0.95, 0.80), (140, 60, 0.0, 0.85, 0.70), (200, 0, 0.8, 0.95, 0.95)])
def test_epipolar(model, n, out, planar, precision, recall):
    a, b, truth = epipolar_scene(n, out, planar)
    _, _, found = robust.consensus(model, a, b, rounds=2000)
    p, r = rates(found, truth)
    assert p >= precision and r >= recall


def test_essential_decomposes():
    a, b, _ = epipolar_scene(100, 0)
    _, m, _ = robust.consensus(robust.Essential(), a, b, rounds=500)
    c, s = np.cos(0.15), np.sin(0.15)
    want = np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])
    assert min(np.abs(r - want).max() for r, _ in robust.Essential().decompose(m)) < 0.05


def test_homography_decomposes():
    r = solve.rotation(np.array([0.05, -0.1, 0.2]))[0]
    t, n = np.array([0.3, -0.1, 0.05]), np.array([0.1, 0.2, 1.0]) / np.linalg.norm([0.1, 0.2, 1.0])
    found = robust.Homography().decompose((r + np.outer(t, n)) * 3)
    assert len(found) == 4
    assert min(np.abs(x - r).max() + np.abs(u - t).max() for x, u, _ in found) < 1e-7


def test_too_few_pairs_and_collinear_samples():
    a = np.column_stack([np.linspace(-1, 1, 10), np.linspace(-1, 1, 10), np.ones(10)])
    assert robust.consensus(robust.Homography(), a[:3], a[:3])[0] == 0
    assert robust.consensus(robust.Homography(), a, a, rounds=50)[1] is None


def test_ransac_groups(spark):
    a, b, truth, _ = homography_scene(60, 20)
    rows = [(k, x.tolist(), y.tolist(), 0.0) for k in (1, 2) for x, y in zip(a, b)] + [(3, [0.0, 0.0, 1.0], [0.0, 0.0, 1.0], 0.0)]
    out = {r.edge_id: r for r in robust.ransac(spark.createDataFrame(rows, "edge_id bigint, a array<double>, b array<double>, quality double"), "edge_id", robust.Homography()).collect()}
    assert out[1].inliers >= 55 and out[1].score == out[2].score and out[3].model is None


def scene():
    pos = np.array([[9.0, 9, 9], [11, 9, 9], [11, 11, 9]])
    down = np.diag([1.0, -1.0, -1.0])
    rot = np.stack([down @ solve.rotation(np.array(v))[0] for v in ([0, 0, 0.2], [0.1, 0, 0], [0, -0.1, 0])])
    g = np.stack(np.meshgrid(np.arange(5, 15), np.arange(5, 15)), -1).reshape(-1, 2).astype(float)
    pts = np.column_stack([g, -10 + (g.sum(1) % 2)])
    cam = solve.Camera(600.0, np.array([400.0, 300.0]), np.zeros(3), np.zeros(2))
    obs = np.array([(i, j) for i in range(3) for j in range(100)])
    v = np.einsum("nji,nj->ni", rot[obs[:, 0]], pts[obs[:, 1]] - pos[obs[:, 0]])
    return cam, pos, rot, pts, obs, cam.project(v)


def angle(a, b):
    return np.arccos(np.clip((np.trace(np.transpose(a, (0, 2, 1)) @ b, axis1=1, axis2=2) - 1) / 2, -1, 1)).max()


def test_bundle_recovers_orientations():
    cam, pos, rot, pts, obs, px = scene()
    start = solve.rotation(np.random.default_rng(0).normal(0, 0.03, (3, 3))) @ rot
    _, _, r, _ = solve.bundle(cam, pos, start, pts, obs, px, solve.Options.ORIENTATION)
    assert angle(start, rot) > 0.02 and angle(r, rot) < 1e-5


def test_bundle_recovers_focal_length():
    cam, pos, rot, pts, obs, px = scene()
    off = solve.Camera(630.0, cam.pp, cam.radial, cam.tangential)
    got, *_ = solve.bundle(off, pos, rot, pts, obs, px, solve.Options.FOCAL | solve.Options.RADIAL_1)
    assert got.focal == pytest.approx(600, abs=0.1)


def test_ground_plane():
    cam, pos, rot, pts, obs, _ = scene()
    pts[:, 2] = -10 + 1e-3 * pts[:, 0] + 1e-2 * pts[:, 1]
    v = np.einsum("nji,nj->ni", rot[obs[:, 0]], pts[obs[:, 1]] - pos[obs[:, 0]])
    px = cam.project(v).reshape(3, 100, 2)
    pairs = np.array([(i, j) for i, j in ((0, 1), (1, 2), (2, 0)) for _ in range(100)])
    p1, p2 = np.concatenate([px[0], px[1], px[2]]), np.concatenate([px[1], px[2], px[0]])
    start = solve.rotation(np.random.default_rng(1).normal(0, 0.01, (3, 3))) @ rot
    r, plane = solve.ground_plane(cam, pos, start, pairs, p1, p2, -9.0)
    assert angle(r, rot) < 2e-2
    assert plane == pytest.approx([1e-3, 1e-2, -10], abs=0.3)


def test_relative_orientations():
    rng = np.random.default_rng(2)
    rot = solve.rotation(rng.normal(0, 0.05, (5, 3))) @ np.diag([1.0, -1, -1])
    edges = np.array([(i, j) for i in range(5) for j in range(i)])
    rel = np.stack([rot[j].T @ rot[i] for i, j in edges])
    start = rot.copy()
    start[2] = np.nan
    got = solve.relative_orientations(start, edges, rel, down_weight=1e-6)
    assert np.abs(np.stack([got[j].T @ got[i] for i, j in edges]) - rel).max() < 1e-5


def test_triangulation_and_centroid():
    p = np.array([1.0, 2, -10])
    o = np.array([[0.0, 0, 0], [5, 0, 0], [0, 5, 1]])
    assert solve.triangulate(o, p - o) == pytest.approx(p)
    pts = np.concatenate([np.zeros((4, 3)), [[100.0, 0, 0]]])
    assert np.linalg.norm(solve.robust_centroid(pts, np.ones(5), 0.1)) < 5


def test_options():
    o = solve.Options.FOCAL | solve.Options.RADIAL_1
    assert o.has_all(solve.Options.FOCAL) and o.has_any(solve.Options.FOCAL | solve.Options.POSITION) and o.excess(solve.Options.FOCAL) == solve.Options.RADIAL_1 and o.bit_count() == 2


CORR = "cam_a bigint, cam_b bigint, model_a bigint, model_b bigint, lab_a array<double>, lab_b array<double>, r_a double, r_b double, theta_a double, theta_b double, nx_a double, ny_a double, nx_b double, ny_b double"


def pair(a, b, shift, i, r=0.3, theta=0.1):
    light = 100.0 + i % 50
    return (a, b, 1, 1, [light + shift[0], 128.0 + shift[1], 128.0 + shift[2]], [light, 128.0, 128.0], r, r, theta, theta, 0.0, 0.0, 0.0, 0.0)


def test_colour_offsets(spark):
    rows = [pair(100, 200, (15, 10, -5), i) for i in range(200)]
    images, _ = colour.balance(spark.createDataFrame(rows, CORR), 5)
    assert images[100][:3] - images[200][:3] == pytest.approx([15, 10, -5], abs=1)


def test_colour_chain(spark):
    rows = [pair(1, 2, (8, 0, 0), i, theta=0.05) for i in range(100)] + [pair(2, 3, (4, 0, 0), i, theta=0.05) for i in range(100)]
    images, _ = colour.balance(spark.createDataFrame(rows, CORR), 5)
    assert images[1][0] - images[2][0] == pytest.approx(8, abs=1.5) and images[2][0] - images[3][0] == pytest.approx(4, abs=1.5)
    assert colour.balance(spark.createDataFrame([], CORR)) == ({}, {})
