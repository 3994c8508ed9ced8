import base64
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import ortho
from terraloom.operators import mesh, raster, solve, tracks
from terraloom.sources import images, rasters


@pytest.mark.parametrize("kind, nodata", [("uint8", None), ("uint16", 7), ("float32", float("nan")), ("int32", -1)])
def test_tiff_round_trip(kind, nodata):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 200, (4, 70, 90)).astype(kind)
    a[:, :32, :32] = 0 if nodata is None else nodata
    data = rasters.tiff(a, (10.0, 20.0, 0.5), nodata, tile=32)
    b, tags = rasters.read_tiff(data)
    assert raster.equal_rasters(a, b.astype(a.dtype)) and tags[33550] == (0.5, 0.5, 0.0) and 0 in tags[325]


def test_png_holds_the_pixels():
    a = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5, 4, 3)
    data = rasters.png(a)
    at = data.index(b"IDAT")
    raw = np.frombuffer(zlib.decompressobj().decompress(data[at + 4 :]), np.uint8)
    assert (raw.reshape(5, 13)[:, 1:].reshape(5, 4, 3) == a).all()


def test_preview_and_tiles(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, r, c, r, c, 9, float(r == 1), 0) for r in range(4) for c in range(4)] + [(1, 0, 0, 0, 5, 5, 5, 1.0, 0)], "tx int, ty int, row int, col int, r int, g int, b int, weight double, layer int")
    assert base64.b64decode(rasters.preview(df.filter("tx = 0"), 4, 2))[:4] == b"\x89PNG"
    rasters.write_tiles(df, str(tmp_path / "t"))
    assert rasters.read_tiles(spark, str(tmp_path / "t"), 1, 0).count() == 1 and rasters.read_tiles(spark, str(tmp_path / "t")).count() == 17


def test_image_folder_and_decoder(spark, tmp_path):
    for name, body in (("b.raw", b"\x01" * 12), ("a.raw", b"\x02" * 12), ("c.raw", b"bad")):
        (tmp_path / name).write_bytes(body)
    assert [r.path[-5:] for r in images.list_images(spark, str(tmp_path)).collect()] == ["a.raw", "b.raw", "c.raw"]
    decode = lambda b: np.frombuffer(b, np.uint8).reshape(2, 2, 3) if len(b) == 12 else None
    assert sorted((r.path[-5:], r.width_px) for r in images.decoded(spark, str(tmp_path), decode).collect()) == [("a.raw", 2), ("b.raw", 2)]


def test_cache_loads_once_and_drops_the_oldest():
    c = images.ImageCache(lambda k: k.upper(), 2)
    ts = [threading.Thread(target=c.get, args=("a",)) for _ in range(8)]
    [t.start() for t in ts], [t.join() for t in ts]
    assert c.loads == 1
    [c.get(k) for k in ("b", "a", "c", "a")]
    assert c.loads == 3
    c.get("b")
    assert c.loads == 4


def test_ground_resolution(spark):
    one = spark.createDataFrame([(9.0, 600.0)], "z double, focal double")
    assert ortho.ground_resolution(one, 0.0, F.lit(100 / 600)).first().gsd == pytest.approx(0.09)
    two = spark.createDataFrame([(9.0, 600.0), (19.0, 600.0), (None, 600.0)], "z double, focal double")
    assert ortho.ground_resolution(two, 0.0, F.lit(100 / 600)).first().gsd == pytest.approx(0.14)
    assert ortho.clamped_resolution(0.1, 100, 100, 250_000) == pytest.approx(0.2)
    assert ortho.clamped_resolution(0.1, 100, 100, 1e9, 0.01) == pytest.approx(1.0)


def test_track_gates(spark):
    rays = spark.createDataFrame([(1, k, e) for k, e in enumerate([0.1, 0.1, 0.2, 9.0, 0.15, 0.1, 0.12])] + [(2, 0, 0.1), (2, 1, 0.1), (3, 0, None)], "track int, ray int, error double")
    got = tracks.gate_rays(rays).collect()
    assert {r.track for r in got} == {1} and len(got) == 5 and max(r.error for r in got) <= 0.2
    t = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (1, 3, 7.0), (2, 1, 5.0), (2, 2, 0.9), (3, 1, 2.0), (3, 2, 2.0)], "track int, image int, error double")
    assert {r.track for r in tracks.gate_tracks(t).collect()} == {1, 2}
    o = spark.createDataFrame([(1, 1.0), (1, 9.0), (2, 1.0), (2, 8.0)], "track int, residual_px double")
    assert {r.track for r in tracks.reproject_gate(o).collect()} == {2}


def test_tracks_keep_one_feature_an_image(spark):
    m = spark.createDataFrame([("1:0", "2:0"), ("2:0", "3:0"), ("3:0", "1:9"), ("5:0", "5:0")], "a string, b string")
    got = tracks.build_tracks(m, "a", "b", F.split("node", ":")[0]).collect()
    assert sorted((r.track, r.image, r.node) for r in got) == [("1:0", "1", "1:0"), ("1:0", "2", "2:0"), ("1:0", "3", "3:0")]


def test_guided_matches(spark):
    p = spark.createDataFrame([(1, 1, 100.0, 100.0), (1, 2, 900.0, 900.0), (1, 3, 500.0, 500.0)], "image int, p int, px double, py double")
    f = spark.createDataFrame([(1, 1, 110.0, 100.0, 0.1), (1, 2, 120.0, 100.0, 0.4), (1, 3, 900.0, 910.0, 0.3), (1, 4, 505.0, 500.0, 0.39), (1, 5, 500.0, 505.0, 0.4), (2, 6, 100.0, 100.0, 0.0)], "image int, q int, qx double, qy double, d double")
    assert sorted((r.p, r.q) for r in tracks.guided_matches(p, f, F.col("d")).collect()) == [(1, 1), (2, 3)]


def test_uncovered_and_colour_pairs(spark):
    i = spark.createDataFrame([(1, "a", "A", "b", "B"), (2, "c", "C", "d", "D"), (3, "e", "C", "f", "X")], "i int, f1 string, c1 string, f2 string, c2 string")
    left = tracks.uncovered(i, spark.createDataFrame([("b",)], "node string"), spark.createDataFrame([("C",), ("D",)], "cell string"))
    assert [r.i for r in left.collect()] == [3]
    layers = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (1, 2, 12), (2, 0, 10)], "p int, layer int, cam_id int")
    assert tracks.colour_pairs(layers).count() == 3


CAM = solve.Camera(600.0, np.array([400.0, 300.0]), np.array([-0.1, 0.02, 0.0]), np.array([0.001, -0.001]))


def test_model_conversion_undoes_distortion():
    back = solve.convert_model(CAM, 800, 600)
    p = np.random.default_rng(0).uniform(-0.5, 0.5, (50, 2))
    one = lambda x: np.column_stack([x, np.ones(len(x))])
    plain = lambda c: solve.Camera(1.0, np.zeros(2), c.radial, c.tangential)
    d = plain(CAM).project(one(p))
    assert np.abs(plain(back).project(one(d)) - p).max() * 600 < 0.5


def test_refined_point():
    pos = np.array([[0.0, 0, 50], [10, 0, 50]])
    rot = np.stack([np.diag([1.0, -1, -1])] * 2)
    p = np.array([3.0, 2.0, 1.0])
    px = CAM.project(np.einsum("nji,nj->ni", rot, p - pos))
    assert solve.refine_point(CAM, pos, rot, px) == pytest.approx(p, abs=1e-6)


def test_ground_mesh_heights():
    cam = solve.Camera(600.0, np.array([400.0, 300.0]), np.zeros(3), np.zeros(2))
    pos = np.array([[0.0, 0, 50], [10, 0, 50], [0, 10, 50], [10, 10, 50]])
    rot = np.stack([np.diag([1.0, -1, -1])] * 4)
    v = np.array([[-20.0, -20, 0], [30, -20, 0], [-20, 30, 0], [30, 30, 0]])
    z = np.array([1.0, 2, 3, 4])
    rng = np.random.default_rng(0)
    w = rng.dirichlet(np.ones(3), 40)
    cells = np.array([[0, 1, 3] if k % 2 else [0, 3, 2] for k in range(40)])
    pts = np.column_stack([np.einsum("tk,tkc->tc", w, v[cells][:, :, :2]), (w * z[cells]).sum(1)])
    obs = np.array([(i, t) for i in range(4) for t in range(40)])
    px = cam.project(np.einsum("nji,nj->ni", rot[obs[:, 0]], pts[obs[:, 1]] - pos[obs[:, 0]]))
    r, got = solve.ground_mesh(cam, pos, rot, obs, px, v, cells, w, np.array([(0, 1), (0, 3), (0, 2)]), smooth=1e-4)
    assert got == pytest.approx(z, abs=0.05)


@pytest.mark.parametrize("o, want", [(solve.Options.GROUND_MESH | solve.Options.POINTS_3D, "ground_mesh"), (solve.Options.POINTS_3D, "bundle"), (solve.Options.GROUND_PLANE, "ground_plane"), (solve.Options.ORIENTATION, "relative_orientations")])
def test_dispatch(o, want):
    assert solve.solver_for(o) == want


def test_ray_hits():
    xyz = np.array([[0.0, 0, 0], [4, 0, 0], [0, 4, 0], [4, 4, 2]])
    t, p = mesh.ray_hits(np.array([[0, 0, -1.0]] * 3), np.array([[1.0, 1, 5], [3, 3, 5], [9, 9, 5]]), xyz, np.array([[0, 1, 2], [1, 3, 2]]))
    assert t.tolist() == [0, 1, -1] and p[1] == pytest.approx([3, 3, 1])
    g = mesh.ground_triangle(np.array([[0.0, 0, 9], [10, 10, 9]]), 2.0)
    assert mesh.ray_hits(np.array([[0, 0, -1.0]] * 2), np.array([[0.0, 0, 9], [10, 10, 9]]), g, np.array([[0, 1, 2]]))[0].tolist() == [0, 0]


def test_footprints_and_casts():
    image = np.zeros((20, 20, 1))
    image[:, 10:] = 100
    flat = np.eye(2)[None]
    assert raster.footprint_mean(image, np.array([[3.5, 3.5]]), flat, 0.1)[0, 0] == 0
    assert raster.footprint_mean(image, np.array([[10.0, 10.0]]), flat, 8.0)[0, 0] == pytest.approx(50, abs=8)
    assert np.isnan(raster.footprint_mean(image, np.array([[30.0, 3.0]]), flat, 1.0)).all()
    assert raster.cast_raster(np.array([[-5.0, 300.0, np.nan]]), "uint8").tolist() == [[0, 255, 0]]
    assert raster.reorder_bands(np.arange(3)[:, None, None], list("bgr"), list("rgb"))[:, 0, 0].tolist() == [2, 1, 0]
