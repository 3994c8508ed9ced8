import numpy as np
import pytest

from terraloom.operators import regions as g


def inside(p, ring):
    x, y = p
    hit = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


STAR = [(np.cos(k * np.pi / 5) * (1 if k % 2 else 0.4), np.sin(k * np.pi / 5) * (1 if k % 2 else 0.4)) for k in range(10)]
COMB = [(0, 0), (5, 0), (5, 3), (4, 3), (4, 1), (3, 1), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)]


@pytest.mark.parametrize("ring", [STAR, STAR[::-1], COMB, [(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)]])
def test_ear_clipping_covers_the_area(ring):
    t = g.ear_clip(np.array(ring, float))
    area = lambda r: 0.5 * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]])))
    assert sum(area([tuple(p) for p in x]) for x in t) == pytest.approx(area(ring))


@pytest.mark.parametrize("ring", [[], [(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2)], [(0, 0), (np.nan, 1), (1, 0)]])
def test_degenerate_polygons_are_empty(ring):
    assert len(g.ear_clip(np.array(ring, float).reshape(-1, 2))) == 0


def test_regions_match_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = rng.uniform(-2, 6, (600, 2))
    shift = [np.array(STAR) + [0, 0], np.array(COMB), np.array(STAR) * 2 + [3, 3]]
    want = {(i, k) for i, p in enumerate(pts) for k, r in enumerate(shift) if inside(p, [tuple(x) for x in r])}
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] * 2 + [(None, 1.0, 1.0), (900, None, 0.0), (901, float("nan"), 0.0)], "id bigint, x double, y double")
    polygons = spark.createDataFrame([(k, [[float(x), float(y)] for x, y in r]) for k, r in enumerate(shift)] + [(7, None), (8, [])], "r bigint, ring array<array<double>>")
    got = g.regions_of_points(points, "id", "x", "y", polygons, "r", "ring", leaf_rows=50, block_rows=40)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_shared_boundary_counts_once(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5)], "id bigint, x double, y double")
    square = lambda a: [[a, 0.0], [a + 1, 0.0], [a + 1, 1.0], [a, 1.0]]
    polygons = spark.createDataFrame([(1, square(0.0)), (2, square(1.0))], "r bigint, ring array<array<double>>")
    assert sorted(map(tuple, g.regions_of_points(points, "id", "x", "y", polygons, "r", "ring").collect())) == [(1, 1), (2, 1), (2, 2)]


def brute(rows, metres, climb):
    out = set()
    ok = [r for r in rows if r[0] is not None and all(v is not None and v == v for v in r[1:4]) and abs(r[1]) <= 90 and (r[1], r[2]) != (0, 0)]
    for i, a in enumerate(ok):
        for b in ok[i + 1 :]:
            d = g.haversine_m(*(np.array([v]) for v in (a[1], a[2], b[1], b[2])))[0]
            if a[0] != b[0] and d <= metres and abs(a[3] - b[3]) <= climb:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


@pytest.mark.parametrize("centre", [(48.0, 11.0), (0.00002, 179.99999), (89.99999, 30.0), (-90.0, 0.0), (10.0, -180.0)])
def test_nearby_matches_brute_force(spark, centre):
    rng = np.random.default_rng(1)
    lat = np.clip(centre[0] + rng.normal(0, 6e-5, 120), -90, 90)
    lon = (centre[1] + rng.normal(0, 6e-5 if abs(centre[0]) < 80 else 90, 120) + 180) % 360 - 180
    rows = [(i, float(a), float(o), float(z)) for i, (a, o, z) in enumerate(zip(lat, lon, rng.uniform(0, 25, 120)))]
    rows += [(500, None, 1.0, 1.0), (501, float("nan"), 1.0, 1.0), (502, 0.0, 0.0, 5.0), (503, 0.0, 0.0, 5.0), (504, 91.0, 1.0, 1.0), (505, 91.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0), rows[3]]
    df = spark.createDataFrame(rows, "id bigint, la double, lo double, z double")
    got = sorted(map(tuple, g.points_nearby(df, "id", "la", "lo", "z", 5.0, 10.0, leaf_rows=20, block_rows=16).collect()))
    assert got == sorted(brute(rows, 5.0, 10.0)) and len(set(got)) == len(got)


def test_crowded_place_and_empty(spark):
    df = spark.createDataFrame([(i, 10.0, 20.0, 1.0) for i in range(60)], "id bigint, la double, lo double, z double")
    assert g.points_nearby(df, "id", "la", "lo", "z", 5.0, 10.0, leaf_rows=10, block_rows=8).count() == 60 * 59 // 2
    assert g.points_nearby(df.limit(0), "id", "la", "lo", "z", 5.0, 10.0).count() == 0


def test_a_third_at_one_place_is_cut_on_both_sides(spark):
    """300,000 points, a third at one place at different heights and a group of exact copies: the pairs of brute force along the height, and no block above its bound."""
    n, copies = 300_000, 40
    hot = spark.range(n // 3).selectExpr("id", "48.0D as la", "11.0D as lo", "cast(id as double) * 7 as z")
    rest = spark.range(n // 3, n - copies).selectExpr("id", "-60.05D + (id % 1201) * 0.1D as la", "-170 + floor(id / 1201) * 1.0D as lo", "0.0D as z")
    same = spark.range(n - copies, n).selectExpr("id", "50.0D as la", "12.0D as lo", "5.0D as z")
    df = hot.unionByName(rest).unionByName(same)
    seen = spark.sparkContext.accumulator(0)
    bound = 4096
    kept = g._pairs

    def counted(p, t):
        assert len(p) <= 2 * bound and len(t) <= 2 * bound, (len(p), len(t))  # hashing fills blocks unevenly
        seen.add(1)
        return kept(p, t)

    g._pairs = counted
    try:
        out = g.points_nearby(df, "id", "la", "lo", "z", 5.0, 10.0, leaf_rows=4096, block_rows=bound)
        got = out.groupBy((out["node_a"] < n // 3).alias("hot")).count().collect()
    finally:
        g._pairs = kept
    assert {r.hot: r["count"] for r in got} == {True: n // 3 - 1, False: copies * (copies - 1) // 2}
