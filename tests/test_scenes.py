"""Known scenes for the dense points, the walk over meshes and the acceptance of links."""

import numpy as np
import pandas as pd
import pytest

from terraloom.operators import dense, mesh, robust, solve

FLAT_NODES = pd.DataFrame({"node_id": range(4), "x": [-50.0, 50, -50, 50], "y": [-50.0, -50, 50, 50], "z": 0.0})
FLAT_EDGES = pd.DataFrame([(0, 0, 1, True, 3, None), (1, 1, 3, True, 0, None), (2, 2, 3, True, 0, None), (3, 0, 2, True, 3, None), (4, 0, 3, False, 1, 2)], columns=["edge_id", "src", "dst", "border", "opp0", "opp1"]).astype({"opp1": "Int64"})
DOWN = np.array([1.0, 0, 0, 0])  # x, y, z, w: turned over the x axis


def scene(spark, px=0.0, degrees=0.0, flips=0):
    """Two cameras at 100 m, 10 m apart, over points of the ground; (points found, largest and mean distance from a true point)."""
    rng = np.random.default_rng(12345)
    base = solve.matrix(DOWN)[0]
    rot = [base @ solve.rotation(rng.normal(0, np.radians(degrees), 3))[0] if degrees else base for _ in range(2)]
    quat = []
    for m in rot:
        w = np.sqrt(max(0, 1 + np.trace(m))) / 2
        if w > 1e-4:
            quat.append([(m[2, 1] - m[1, 2]) / (4 * w), (m[0, 2] - m[2, 0]) / (4 * w), (m[1, 0] - m[0, 1]) / (4 * w), w])
        else:
            x = np.sqrt(max(0, 1 + m[0, 0] - m[1, 1] - m[2, 2])) / 2
            quat.append([x, (m[0, 1] + m[1, 0]) / (4 * x), (m[0, 2] + m[2, 0]) / (4 * x), (m[2, 1] - m[1, 2]) / (4 * x)])
    pos = np.array([[0.0, 0, 100], [10.0, 0, 100]])
    truth = np.array([[x, y, 0.0] for x in range(0, 11, 2) for y in range(-4, 5, 2)])
    rows = []
    for k in range(2):
        v = (truth - pos[k]) @ rot[k]
        p = v[:, :2] / v[:, 2:] * 800 + [800, 600] + rng.normal(0, max(px, 1e-15), (len(truth), 2))
        for i, (x, y) in enumerate(p):
            bits = np.random.default_rng(500 + i).integers(0, 2, 486)
            for b in rng.integers(0, 486, flips):
                bits[b] ^= 1
            words = [int(np.int64(np.uint64(sum(int(v) << n for n, v in enumerate(bits[64 * w : 64 * w + 64]))))) for w in range(8)]
            if 0 <= x < 1600 and 0 <= y < 1200:
                rows.append((k, i, float(x), float(y), words))
    cams = [(k, *map(float, pos[k]), *map(float, quat[k]), 1600, 1200, 800.0, 800.0, 600.0, 0.0, 0.0, 0.0, 0.0, 0.0) for k in range(2)]
    cameras = spark.createDataFrame(cams, "node_id bigint, x double, y double, z double, qx double, qy double, qz double, qw double, w_px int, h_px int, focal double, ppx double, ppy double, k1 double, k2 double, k3 double, t1 double, t2 double")
    features = spark.createDataFrame(rows, "node_id bigint, idx int, fx double, fy double, descriptor array<bigint>")
    edges = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in FLAT_EDGES.astype(object).itertuples(index=False)], "edge_id bigint, src bigint, dst bigint, border boolean, opp0 bigint, opp1 bigint")
    found = np.array([(r.x, r.y, r.z) for r in dense.densify(cameras, features, spark.createDataFrame(FLAT_NODES), edges).collect()]).reshape(-1, 3)
    if not len(found):
        return 0, 0.0, 0.0
    e = np.linalg.norm(found[:, None, :2] - truth[None, :, :2], axis=2).min(1)
    return len(found), e.max(), e.mean()


@pytest.mark.parametrize("noise, most, mean", [({}, 1e-6, 1e-6), ({"px": 1.0}, 0.5, 0.25), ({"degrees": 0.1}, 0.5, 0.3), ({"flips": 20}, 0.01, 0.01), ({"px": 0.5, "degrees": 0.05, "flips": 10}, 0.5, 0.5)])
def test_dense_points_within_the_floors(spark, noise, most, mean):
    n, worst, middle = scene(spark, **noise)
    assert 0 < n <= 30 and worst < most and middle < mean


def test_random_descriptors_give_no_points(spark):
    assert scene(spark, flips=2000)[0] == 0


def test_walk_agrees_with_all_triangles():
    rng = np.random.default_rng(1)
    m = mesh.Mesh(np.array([[-50.0, -50, 0], [50, -50, 3], [-50, 50, 1], [50, 50, -2]]), np.array([[0, 1, 3], [0, 3, 2]]))
    m.refine_where(lambda x, y, z: x * x + y * y < 3000, passes=6)
    nodes, edges = m.tables()
    d = np.column_stack([rng.normal(0, 0.2, (300, 2)), np.full(300, -1.0)])
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    o = np.column_stack([rng.uniform(-70, 70, (300, 2)), np.full(300, 40.0)])
    w = mesh.Walker(nodes, edges)
    code, _, where, steps = w.walk(d, o)
    hit, point = mesh.ray_hits(d, o, w.xyz, w.corners)
    inside = code == mesh.HIT
    assert (inside == (hit >= 0)).all() and set(code) == {mesh.HIT, mesh.OUTSIDE} and steps.max() > 3
    assert where[inside] == pytest.approx(point[inside])


def test_walk_codes():
    w = mesh.Walker(FLAT_NODES, FLAT_EDGES)
    down, flat = np.array([[0.0, 0, -1]]), np.array([[1.0, 0, 0]])
    at = lambda x, y: np.array([[x, y, 10.0]])
    assert w.walk(down, at(1.0, 2.0))[0][0] == mesh.HIT and w.walk(down, at(80.0, 0.0))[0][0] == mesh.OUTSIDE and w.walk(flat, at(0.0, 0.0))[0][0] == mesh.PARALLEL
    broken = FLAT_EDGES[FLAT_EDGES["edge_id"] != 1]
    assert mesh.Walker(FLAT_NODES, broken).walk(down, at(80.0, 0.0))[0][0] == mesh.INCONSISTENT
    assert mesh.Walker(FLAT_NODES.head(0), FLAT_EDGES.head(0)).walk(down, at(0.0, 0.0))[0][0] == mesh.UNINITIALIZED


def links(n_good, n_bad, seed=0):
    rng = np.random.default_rng(seed)
    r = solve.rotation(np.array([[0.0, 0, 0.1]]))[0]
    h = r + np.outer([0.05, -0.03, 0.0], [0, 0, 1.0])
    p = rng.uniform(-1, 1, (n_good, 2))
    a = np.column_stack([p, np.ones(n_good)])
    b = a @ h.T
    a = np.vstack([a, np.column_stack([rng.uniform(-2, 2, (n_bad, 2)), np.ones(n_bad)])])
    b = np.vstack([b, np.column_stack([rng.uniform(-2, 2, (n_bad, 2)), np.ones(n_bad)])])
    return [(i, i, (u / np.linalg.norm(u)).tolist(), (v / np.linalg.norm(v)).tolist(), 0.1) for i, (u, v) in enumerate(zip(a, b))]


def test_links_hold_with_enough_inliers(spark):
    schema = "edge_id bigint, idx1 int, idx2 int, a array<double>, b array<double>, quality double"
    rows = [(1, *r) for r in links(40, 20)] + [(2, *r) for r in links(5, 0)] + [(3, *r) for r in links(2, 0)] + [(4, 0, 0, [float("nan")] * 3, [0.0, 0.0, 1.0], 0.1)]
    df = spark.createDataFrame(rows, schema)
    got = {r.edge_id: r for r in robust.accept_links(df, "edge_id").collect()}
    assert set(got) == {1, 2, 3, 4} and [got[k].accepted for k in (1, 2, 3, 4)] == [True, False, False, False]
    assert {m.idx1 for m in got[1].matches} >= set(range(40)) and got[2].matches == [] and got[2].inliers == 5
    was = [(k, *r, r[0] < 30) for k, n in ((1, 40),) for r in links(40, 20)] + [(2, *r, True) for r in links(5, 0)] + [(3, *r, False) for r in links(9, 0)]
    new = {r.edge_id: r for r in robust.refresh_links(spark.createDataFrame(was, schema + ", inlier boolean"), "edge_id").collect()}
    assert new[1].accepted and {m.idx1 for m in new[1].matches} >= set(range(40)) and not new[2].accepted and not new[3].accepted and new[3].matches == []
