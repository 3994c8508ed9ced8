import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import camera, geo, geom, radiometry, spatial
from terraloom.operators import clusters, graph, lookup, matching, mesh, neighbours, ordering, raster, tables


def values(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def lit(*v):
    return tuple(F.lit(float(x)) for x in v)


def brute_knn(p, q, k):
    out = set()
    for i, a in enumerate(p):
        d = ((q - a) ** 2).sum(1)
        out |= {(i, int(j), r + 1) for r, j in enumerate(np.lexsort((np.arange(len(q)), d))[:k])}
    return out


@pytest.mark.parametrize("seed, n, k", [(0, 300, 4), (1, 50, 60), (2, 1, 1), (3, 400, 1)])
def test_knn_matches_brute_force(spark, seed, n, k):
    rng = np.random.default_rng(seed)
    q = np.round(np.concatenate([rng.normal(0, 1, (n // 2, 2)), rng.normal(50, 20, (n - n // 2, 2))]), 1)
    p = rng.uniform(-100, 150, (40, 2))
    probes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(99, None, 1.0)], "p bigint, px double, py double")
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)] + [(9999, float("nan"), 1.0)], "q bigint, qx double, qy double")
    got = {(r.p, r.q, r["rank"]) for r in neighbours.knn_join(probes, points, k).collect()}
    assert got == brute_knn(p, q, k)


def test_knn_at_a_crowded_place(spark):
    points = spark.range(3000).select(F.col("id").alias("q"), F.lit(1.0).alias("qx"), F.lit(1.0).alias("qy"), (F.col("id") % 2).alias("g"))
    probes = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 1.0, 1.0, 1)], "p bigint, px double, py double, g bigint")
    got = sorted((r.p, r.q) for r in neighbours.knn_join(probes, points, 3, on=("g",)).collect())
    assert got == [(1, 0), (1, 2), (1, 4), (2, 1), (2, 3), (2, 5)]


def test_knn_of_nothing(spark):
    probes, points = spark.createDataFrame([], "p bigint, px double, py double"), spark.createDataFrame([], "q bigint, qx double, qy double")
    assert neighbours.knn_join(probes, points, 3).count() == 0


def test_radius_join_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    a = rng.uniform(0, 20, (150, 2))
    df = lambda k, x, y: spark.createDataFrame([(i, float(u), float(v)) for i, (u, v) in enumerate(a)], f"{k} bigint, {x} double, {y} double")
    got = {(r.a, r.b) for r in neighbours.radius_join(df("a", "px", "py"), df("b", "qx", "qy"), 1.5).collect()}
    assert got == {(i, j) for i in range(150) for j in range(150) if ((a[i] - a[j]) ** 2).sum() <= 2.25}


def test_components_of_long_paths_and_cliques(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + j) for i in range(6) for j in range(i)] + [(5, 5), (None, 3), (7, None), (1000, 1001)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(6)}}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_subsample_literals(spark):
    pts = [(100, 100, 0.5), (110, 105, 0.9), (200, 200, 0.3), (205, 202, 0.7), (300, 300, 0.4)]
    df = spark.createDataFrame([(1, i, float(x), float(y), s) for i, (x, y, s) in enumerate(pts)], "node_id bigint, idx int, x double, y double, strength double")
    kept = matching.suppress(df, "node_id", "idx", "x", "y", "strength", 20.0).filter("kept").orderBy(F.desc("strength"))
    assert [r.idx for r in kept.collect()] == [1, 3, 4]


def test_ratio_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**62), 2**62, (30, 8))
    near = base.copy()
    near[:, 0] ^= 3
    f = [(1, i, [int(x) for x in d]) for i, d in enumerate(base)] + [(2, i, [int(x) for x in d]) for i, d in enumerate(near[::-1])] + [(2, 99, None)]
    links = spark.createDataFrame([(7, 1, 2), (8, 1, 3), (7, 1, 2)], "edge_id bigint, src bigint, dst bigint")
    got = matching.ratio_match(links, spark.createDataFrame(f, "node_id bigint, idx int, descriptor array<bigint>")).collect()
    assert sorted((r.edge_id, r.idx1, r.idx2) for r in got) == [(7, i, 29 - i) for i in range(30)]
    assert all(r.distance == pytest.approx(2 / 486) for r in got)


@pytest.mark.parametrize("leaf, block", [(16, 9), (64, 1000)])
def test_knn_with_order_and_depth_matches_brute_force(spark, monkeypatch, leaf, block):
    """Points in the order of their batch, a third at one place; slices small enough that several are used."""
    monkeypatch.setattr(neighbours, "FIRST_SLICE", 40)
    rng = np.random.default_rng(2)
    xyz = rng.normal(0, 20, (300, 3)).round(1)
    xyz[::3] = 1.5
    batch = np.sort(rng.integers(0, 30, 300))
    rows = [(i, *map(float, p), int(b)) for i, (p, b) in enumerate(zip(xyz, batch))]
    probes = spark.createDataFrame([*rows, (900, None, 0.0, 0.0, 3), (901, float("nan"), 0.0, 0.0, 3), (902, 0.0, 0.0, 0.0, -1), (903, 0.0, 1e6, 0.0, 29)], "p bigint, px double, py double, pz double, pb int")
    points = spark.createDataFrame([*rows, (None, 0.0, 0.0, 0.0, 0)], "q bigint, qx double, qy double, qz double, qb int")
    for axes, n in (("xy", 2), ("xyz", 3)):
        want = set()
        for p, x, y, z, b in [*rows, (903, 0.0, 1e6, 0.0, 29)]:
            d = sorted((float(sum((u - v) ** 2 for u, v in zip((x, y, z)[:n], r[1 : 1 + n]))), r[0]) for r in rows if r[4] <= b)[:7]
            want |= {(p, q, k + 1) for k, (_, q) in enumerate(d)}
        got = neighbours.knn_join(probes, points, 7, ("pb", "qb"), axes=axes, leaf_rows=leaf, block_rows=block).collect()
        assert len(got) == len(want) and {(r.p, r.q, r["rank"]) for r in got} == want


def test_crowded_cells_of_a_radius_join_are_cut(spark):
    a = spark.range(300).selectExpr("id as a", "0.5D as px", "case when id < 200 then 0.5D else cast(id as double) end as py")
    b = spark.range(300).selectExpr("id as b", "0.5D as qx", "case when id < 200 then 0.5D else cast(id as double) end as qy")
    got = {(r.a, r.b) for r in neighbours.radius_join(a, b, 1.0, block_rows=16).collect()}
    at = lambda k: 0.5 if k < 200 else float(k)
    assert got == {(i, j) for i in range(300) for j in range(300) if abs(at(i) - at(j)) <= 1.0}


def test_tiered_lookup_prefers_tier_then_order(spark):
    db = spark.createDataFrame([(1, "Parrot", "Anafi", "", 5344), (2, "parrot", "ANAFI", "", 4608), (3, "Parrot", "Anafi", "x", 4608)], "ord int, make string, model string, lens string, w int")
    q = spark.createDataFrame([(1, "PARROT", "anafi", "", 4608), (2, "Parrot", "Anafi", "y", 4608), (3, "Parrot", "Anafi", None, 1), (4, "Nobody", "Anafi", "", 1), (5, None, None, None, None)], "id bigint, make string, model string, lens string, w int")
    out = lookup.tiered_lookup(q, "id", db.withColumn("entry", F.col("ord")), "ord", [["make", "model", "lens", "w"], ["make", "model", "w"], ["make", "model"]], ["entry"])
    assert {r.id: (r.tier, r.entry) for r in out.collect()} == {1: (1, 2), 2: (2, 2), 3: (3, 1), 4: (None, None), 5: (None, None)}


def test_calibration_scales_with_the_image(spark):
    x = values(spark, *lookup.calibrated(*lit(5344, 4016, 5344, 4016, 5, -3), F.lit(None).cast("double"), F.lit(4573.0)))
    assert x == pytest.approx((2677, 2005, 4573))
    assert values(spark, *lookup.calibrated(*lit(2672, 2008, 5344, 4016, 10, 10, 1000, 4573))) == pytest.approx((1341, 1009, 1000))
    assert values(spark, *lookup.calibrated(*lit(2672, 2008, 5344, 4016, 10, 10, 0, 4573))) == pytest.approx((1341, 1009, 4573))  # as listed, at any size


def test_upsert_overwrites_even_with_null(spark):
    old = spark.createDataFrame([("a", None, 1.0, "x"), ("b", 2, 2.0, "x")], "make string, w int, focal double, extra string")
    new = spark.createDataFrame([("a", None, None), ("c", 3, 3.0)], "make string, w int, focal double")
    got = sorted((r.make, r.w, r.focal) for r in lookup.upsert(old, new, ["make", "w"], ["focal"]).collect())
    assert got == [("a", None, None), ("b", 2, 2.0), ("c", 3, 3.0)]


def test_camera_round_trip(spark):
    m = dict(zip(("focal", "ppx", "ppy", "k1", "k2", "k3", "t1", "t2"), lit(600, 400, 300, -0.1, 0.01, 0.001, 0.001, -0.001)))
    grid = spark.range(400).select((F.col("id") % 20 * 40).cast("double").alias("x"), (F.floor(F.col("id") / 20) * 30).cast("double").alias("y"))
    def residual(model, rounds=10):
        rays = grid.select("x", "y", F.array(*camera.unproject_forward((F.col("x"), F.col("y")), model, rounds)).alias("r")).persist()
        px = camera.project(tuple(F.col("r")[k] for k in range(3)), model)
        return rays.select(F.max(F.hypot(px[0] - F.col("x"), px[1] - F.col("y")))).first()[0]

    assert residual(m, 15) < 1e-2
    plain = {k: (v if k in ("focal", "ppx", "ppy") else F.lit(0.0)) for k, v in m.items()}
    assert residual(plain) < 1e-9


def test_seen_equals_project(spark):
    m = dict(zip(("focal", "ppx", "ppy", "k1", "k2", "k3", "t1", "t2"), lit(600, 400, 300, -0.1, 0.01, 0, 0.001, 0)))
    point, pos, q = lit(3, 4, 0), lit(1, 2, 50), lit(0.99, 0.05, 0.02, 0.03)
    a = values(spark, *camera.project(camera.to_camera(point, pos, q), m))
    s = spark.range(1).select(camera.seen(point, pos, q, m).alias("s")).select("s.*").first()
    assert a == pytest.approx((s.px, s.py))


def test_rays_and_planes(spark):
    mid, gap = geom.ray_midpoint(lit(1, 0, 0), lit(0, 0, 0), lit(0, 1, 0), lit(5, -5, 2))
    assert values(spark, *mid, gap) == pytest.approx((5, 0, 1, 4))
    _, behind = geom.ray_midpoint(lit(-1, 0, 0), lit(0, 0, 0), lit(0, 1, 0), lit(5, -5, 2))
    assert values(spark, behind)[0] == pytest.approx(-4)
    assert values(spark, geom.ray_midpoint(lit(1, 0, 0), lit(0, 0, 0), lit(1, 0, 0), lit(0, 1, 0))[1]) == (None,)
    t = lit(0, 0, 0), lit(4, 0, 0), lit(0, 4, 0)
    assert values(spark, *geom.ray_triangle(lit(0, 0, -1), lit(1, 1, 5), *t)) == pytest.approx((1, 1, 0))
    assert values(spark, *geom.ray_triangle(lit(0, 0, -1), lit(3, 3, 5), *t)) == (None, None, None)
    assert values(spark, geom.clockwise(lit(0, 0), lit(0, 1), lit(1, 0)), geom.in_triangle(lit(2, 0), lit(0, 0), lit(4, 0), lit(0, 4))) == (True, True)
    assert values(spark, geom.angle(lit(1, 0, 0), lit(0, 1, 0)))[0] == pytest.approx(np.pi / 2)


def test_local_frame(spark):
    o = lit(-34, 18.23)
    assert values(spark, *geo.to_local(*o, *o)) == pytest.approx((0, 0), abs=1e-9)
    x, y = geo.to_local(*lit(-33.9, 18.4), *o)
    assert values(spark, *geo.to_wgs84(x, y, *o)) == pytest.approx((-33.9, 18.4), abs=1e-9)
    assert values(spark, y)[0] == pytest.approx(11_092, rel=1e-2)
    assert values(spark, geo.to_local(*lit(1, 1), F.lit(None).cast("double"), F.lit(0.0))[0]) == (None,)
    assert 'PARAMETER["latitude_of_origin",-34.0]' in values(spark, geo.wkt(*o))[0]


@pytest.mark.parametrize("bgr", [(0, 0, 0), (255, 255, 255), (10, 200, 30), (255, 0, 0)])
def test_colour_round_trip(spark, bgr):
    assert values(spark, *radiometry.lab_to_bgr(*radiometry.bgr_to_lab(*lit(*bgr)))) == bgr


def test_white_is_neutral(spark):
    assert values(spark, *radiometry.bgr_to_lab(*lit(255, 255, 255))) == pytest.approx((100, 0, 0), abs=0.01)


def test_hilbert_visits_neighbours(spark):
    cells = spark.range(256).select(F.floor(F.col("id") / 16).alias("x"), (F.col("id") % 16).alias("y"))
    rows = cells.select("x", "y", spatial.hilbert(F.col("x"), F.col("y"), 4).alias("d")).orderBy("d").collect()
    assert [r.d for r in rows] == list(range(256))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))
    assert [ordering.hilbert(r.x, r.y, 16) for r in rows] == list(range(256))


def test_weights(spark):
    centre, corner = (spatial.blend_weight(lit(*p), *lit(100, 80, 0)) for p in ((50, 40), (0, 0)))
    a, b = values(spark, centre, corner)
    assert a == pytest.approx(0.8) and b == pytest.approx(5e-4)
    assert values(spark, spatial.boundary_falloff(F.lit(0.0)), spatial.boundary_falloff(F.lit(64.0))) == pytest.approx((1, 0.02))


def test_kmeans_outliers_and_balance(spark):
    rows = [(i, 0.0, 0.0) for i in range(100)] + [(100, 1000.0, 1000.0), (101, -1000.0, 1000.0), (102, 1000.0, -1000.0)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    sizes = sorted(r["count"] for r in clusters.kmeans(df, "id", ["x", "y"], 4).groupBy("cluster").count().collect())
    assert sizes == [1, 1, 1, 100]


def test_two_cliques():
    edges = np.array([(b + i, b + j) for b in (0, 8) for i in range(8) for j in range(i)])
    places = np.random.default_rng(0).normal(0, 1, (16, 2))
    g = clusters.spectral_groups(16, edges, np.ones(len(edges)), 2, places)
    assert len(set(g[:8])) == 1 and len(set(g[8:])) == 1 and g[0] != g[8]


def test_components_are_clustered_by_themselves(monkeypatch):
    """Two cliques hung together by one link, a small clique and two nodes without links; places tell nothing of the cliques."""
    edges = np.array([(b + i, b + j) for b, n in ((0, 8), (8, 8), (16, 4)) for i in range(n) for j in range(i)] + [(0, 8)])
    places = np.random.default_rng(0).normal(0, 1, (22, 2))
    want = [set(range(8)), set(range(8, 16)), set(range(16, 20)), {20, 21}]
    for most in (4096, 4):
        monkeypatch.setattr(clusters, "MOST_DENSE", most)
        g = clusters.spectral_groups(22, edges, np.ones(len(edges)), 4, places)
        assert sorted(map(sorted, ({int(i) for i in np.flatnonzero(g == c)} for c in set(g)))) == sorted(map(sorted, want))


def test_lanczos_finds_the_dense_eigenvectors(monkeypatch):
    edges = np.column_stack([np.arange(299), np.arange(1, 300)])
    dense = clusters._eigenvectors(300, edges, np.ones(299), 3, 0.1)
    monkeypatch.setattr(clusters, "MOST_DENSE", 10)
    sparse = clusters._eigenvectors(300, edges, np.ones(299), 3, 0.1)
    assert np.abs(np.abs((dense * sparse).sum(0)) - 1).max() < 1e-6


def flat():
    return mesh.Mesh(np.array([[-50, -50, 0], [50, -50, 0], [-50, 50, 0], [50, 50, 0.0]]), np.array([[0, 1, 3], [0, 3, 2]]))


def test_refinement_conforms():
    m = flat()
    m.refine(0)
    assert len(m.triangles) == 4 and m.conforming()
    cuts = m.refine_where(lambda x, y, z: x * x + y * y < 1500, 6)
    assert cuts and m.conforming()
    turn = lambda u, v: u[0] * v[1] - u[1] * v[0]
    area = sum(abs(turn(*(np.array(m.xyz[v][:2]) - m.xyz[t[0]][:2] for v in t[1:]))) / 2 for t in m.triangles.values())
    assert area == pytest.approx(10_000)
    edges = [e for e in m.at if len(m.at[e]) == 1]
    ends = [v for e in edges for v in e]
    assert all(ends.count(v) == 2 for v in set(ends))


def test_grid_mesh_and_counts(spark):
    cams = spark.createDataFrame([(i, float(i % 5 * 10), float(i // 5 * 10), 50.0 + i) for i in range(25)], "node_id bigint, x double, y double, z double")
    nodes, edges = mesh.grid_mesh(cams, 10.0, 10.0)
    v, e = nodes.count(), edges.count()
    inner = edges.filter("opp0 is not null and opp1 is not null").count()
    border = edges.filter("border").count()
    f = (2 * inner + border) // 3
    assert (v, v - e + f) == (49, 1) and edges.filter("border <> (opp0 is null or opp1 is null)").count() == 0
    corners = spark.createDataFrame([(0, -50.0, -50.0, 0.0, 50.0, -50.0, 0.0, 50.0, 50.0, 0.0), (1, -50.0, -50.0, 0.0, 50.0, 50.0, 0.0, -50.0, 50.0, 0.0)], "t int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    pts = spark.createDataFrame([(1.0, 0.0, 3.0), (2.0, 0.0, 5.0), (0.0, 0.0, 1.0), (0.0, 2.0, 7.0)], "x double, y double, z double")
    got = {r.t: (r.n, r["mean"], r.variance) for r in mesh.triangle_counts(pts, corners, 25.0).collect()}
    assert got[0] == pytest.approx((3, 3.0, 8 / 3)) and got[1] == pytest.approx((1, 7.0, 0.0))
    assert mesh.minimal_mesh(cams, 5.0)[0].count() == 4


def test_merge_surfaces(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 1.0), (1, 1, 0.0, 0.0, 20.0, 3.0), (0, 2, 0.0, 0.0, 5.0, 0.0), (1, 2, 0.0, 0.0, 9.0, 0.0)], "surface_id int, node_id bigint, x double, y double, z double, weight double")
    assert {r.node_id: r.z for r in mesh.merge_surfaces(df).collect()} == {1: 17.5, 2: 5.0}


def test_blend():
    layers = np.stack([np.full((32, 32, 3), 50.0), np.full((32, 32, 3), 80.0)])
    w = np.stack([np.ones((32, 32)), np.zeros((32, 32))])
    assert np.allclose(raster.laplacian_blend(layers, w), 50)
    w[1] = 1
    assert np.allclose(raster.laplacian_blend(layers, w), 65)
    w[:, 3, 4] = 0
    out = raster.laplacian_blend(layers, w)
    assert np.isnan(out[3, 4]).all() and np.isfinite(out).sum() == 3 * (32 * 32 - 1)


def test_distance_transform():
    d = raster.distance_transform(np.pad(np.ones((5, 5), bool), 1))
    assert d[3, 3] == pytest.approx(3 * 0.955) and d[0, 0] == 0


def test_tile_orders():
    cams = {x + 16 * y: {x + y, max(x + y - 1, 0), x + y + 1} for x in range(16) for y in range(16)}
    o, h = ordering.cache_order(16, 16, cams, 8), ordering.hilbert_order(16, 16)
    assert sorted(o) == list(range(256)) and o != h and ordering.misses(o, cams, 8) <= ordering.misses(h, cams, 8)


def test_interleave():
    out = ordering.interleave([list("aaaa"), list("bb"), []])
    assert sorted(out) == sorted("aaaabb") and out[:3] in (list("aba"), list("baa"))


def test_histogram_bounds_by_hand(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1000)] + [(None,)], "v double")
    r = tables.histogram_bounds(df, "v").first()
    lo, hi = 25, 974
    assert (r.low, r.high) == (lo - (hi - lo), lo + 3 * (hi - lo))
