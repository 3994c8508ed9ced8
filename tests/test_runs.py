import json

import numpy as np
import pandas as pd
import pytest

from terraloom.plans import checkpoint, pipeline
from terraloom.sources import camera_list, graph_json, mesh_files, points
from terraloom.streaming import ingest


def test_checkpoint(spark, tmp_path):
    df = spark.range(5)
    path = checkpoint.save(str(tmp_path), {"t": df}, "relax", {"level": 3})
    s = checkpoint.load(spark, path)
    assert (s.stage, s.extra, s.tables["t"].count()) == ("relax", {"level": 3}, 5)
    with pytest.raises(checkpoint.InvalidCheckpoint):
        checkpoint.load(spark, str(tmp_path / "nowhere"))
    for bad in ("{", json.dumps({"version": 2, "tables": [], "stage": "x"}), json.dumps({"version": 1}), "[]"):
        p = tmp_path / f"bad{abs(hash(bad))}"
        (p / "metadata").mkdir(parents=True)
        (p / "metadata" / "part.txt").write_text(bad)
        with pytest.raises(checkpoint.InvalidCheckpoint):
            checkpoint.load(spark, str(p))
    (tmp_path / "gap" / "metadata").mkdir(parents=True)
    (tmp_path / "gap" / "metadata" / "part.txt").write_text(json.dumps({"version": 1, "tables": ["gone"], "stage": "x"}))
    with pytest.raises(checkpoint.InvalidCheckpoint):
        checkpoint.load(spark, str(tmp_path / "gap"))


def test_pipeline_order_repeats_and_resume(spark, tmp_path):
    seen = []

    def step(name, times):
        def run(p, n):
            seen.append((name, n))
            p.state.tables["t"] = spark.range(n + 1)
            return pipeline.REPEAT if n + 1 < times else pipeline.NEXT

        return run

    events = []
    p = pipeline.Pipeline(spark, {"initial_processing": step("i", 3), "mesh_refinement": step("m", 1), "final_global_relax": step("f", 99)}, skip={"mesh_refinement"}, listener=events.append, folder=str(tmp_path))
    assert p.run_all().stage == "complete"
    assert seen == [("i", 0), ("i", 1), ("i", 2), *(("f", k) for k in range(4))] and len(events) == len(p.history)
    assert checkpoint.load(spark, p.saved).stage == "complete"
    q = pipeline.Pipeline(spark, {})
    q.resume(p.saved, "Mesh Refinement")
    assert q.state.stage == "mesh_refinement"
    early = checkpoint.save(str(tmp_path), {"t": spark.range(1)}, "mesh_refinement")
    with pytest.raises(ValueError):
        q.resume(early, "final_global_relax")
    assert p.timings().count() >= 2


def test_pipeline_error_completes(spark):
    p = pipeline.Pipeline(spark, {"initial_processing": lambda p, n: 1 / 0})
    assert p.run_all().stage == "complete" and isinstance(p.failure, ZeroDivisionError)


@pytest.mark.parametrize("text, want", [("GENERATE_GEOTIFF", "generate_layers"), ("generate-dsm", "generate_layers"), ("Complete", "complete")])
def test_stage_names(text, want):
    assert pipeline.parse_stage(text) == want


def test_unknown_stage():
    with pytest.raises(ValueError):
        pipeline.parse_stage("nonsense")


def test_xyz(spark, tmp_path):
    pts = spark.createDataFrame([(0.1, 2.0, 3.0), (5.0, 5.0, 5.0)], "x double, y double, z double")
    points.write_xyz(pts, str(tmp_path / "p"))
    assert sorted(map(tuple, points.read_xyz(spark, str(tmp_path / "p")).collect())) == [(0.1, 2.0, 3.0), (5.0, 5.0, 5.0)]
    assert points.within(pts, {"x": (0.0, 5.0)}).count() == 1 and points.within(pts, {"x": (0.0, 0.0)}).count() == 2
    (tmp_path / "q.txt").write_text("\n1,2\n1,2,3,4\n")
    assert [tuple(r) for r in points.read_xyz(spark, str(tmp_path / "q.txt")).collect()] == [(1.0, 2.0, 3.0)]
    (tmp_path / "r.txt").write_text("1,b,3\n")
    with pytest.raises(Exception, match="no number"):
        points.read_xyz(spark, str(tmp_path / "r.txt")).collect()


def test_ply_and_obj(spark, tmp_path):
    n = spark.createDataFrame([(0, -50.0, -50.0, 0.1234567890123), (1, 50.0, -50.0, 0.0), (2, -50.0, 50.0, 0.0), (3, 50.0, 50.0, 0.0)], "node_id bigint, x double, y double, z double")
    e = spark.createDataFrame([(0, 0, 1, True, 3, None), (1, 1, 3, True, 0, None), (2, 2, 3, True, 0, None), (3, 0, 2, True, 3, None), (4, 0, 3, False, 1, 2)], "edge_id bigint, src bigint, dst bigint, border boolean, opp0 bigint, opp1 bigint")
    mesh_files.write_ply(n, e, str(tmp_path / "m"))
    n2, e2 = mesh_files.read_ply(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, n2.drop("file").collect())) == sorted(map(tuple, n.collect()))
    assert {tuple(r)[1:] for r in e2.drop("file").collect()} == {tuple(r)[1:] for r in e.collect()}
    assert mesh_files.faces(e).count() == 2
    text = open(next((tmp_path / "m").glob("*.txt"))).read()
    for bad in (text + "0 0 0\n", text.replace("ply", "plx", 1), text.rsplit("\n", 2)[0]):
        with pytest.raises(ValueError):
            mesh_files.parse_ply(bad)
    from pyspark.sql import functions as F

    obj = mesh_files.obj_lines(n.withColumn("surface_id", F.lit(0)), mesh_files.wound(n, mesh_files.faces(e)).withColumn("surface_id", F.lit(0)), (-50.0, 50.0, -50.0, 50.0)).orderBy("part", "at").collect()
    lines = [r.value for r in obj]
    assert lines[0] == "mtllib ortho.mtl" and "vt 0.0 0.0" in lines and sum(x.startswith("f ") for x in lines) == 2


def test_camera_list(spark, tmp_path):
    doc = {"version": 1, "cameras": [{"make": "Parrot", "model": "Anafi", "sensor_width_px": 5344, "sensor_height_px": 4016, "focal_length_pixels": 4573.0, "notes": "n"}, {"make": "X"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = camera_list.read_camera_list(spark, str(tmp_path / "a.json"))
    first, second = rows.orderBy("ord").collect()
    assert (first.ord, first.make, first.radial, first.focal) == (1, "Parrot", [0.0, 0.0, 0.0], 4573.0) and (second.model, second.focal) == ("", None)
    (tmp_path / "b.json").write_text(camera_list.camera_list_text(rows).first().value)
    assert camera_list.read_camera_list(spark, str(tmp_path / "b.json")).orderBy("ord").collect() == [first, second]
    for k, bad in enumerate(("{}", json.dumps({**doc, "version": 2}), "nonsense")):
        (tmp_path / f"x{k}.json").write_text(bad)
        assert camera_list.read_camera_list(spark, str(tmp_path / f"x{k}.json")).count() == 0


def test_graph_text(spark, tmp_path):
    nodes = spark.createDataFrame([(20, "/b", [1.0, 2.0, 3.0]), (3, "/a", None)], "node_id bigint, path string, position array<double>")
    edges = spark.createDataFrame([(5, "3", "20")], "edge_id bigint, source string, dest string")
    text = graph_json.graph_text(nodes, edges).first().value
    assert list(json.loads(text)["nodes"]) == ["3", "20"]
    (tmp_path / "g.json").write_text(text)
    g = graph_json.read_graphs(spark, str(tmp_path / "g.json"))
    assert {(r.node_id, r.path) for r in graph_json.node_rows(g).collect()} == {("20", "/b"), ("3", "/a")}


def test_feature_collection_of_a_part(spark, tmp_path):
    nodes = spark.createDataFrame([(k, f"/{k}", float(k), 2.0 * k) for k in range(9)], "node_id bigint, path string, x double, y double")
    edges = spark.createDataFrame([(k, k, k + 1, 10 * k) for k in range(8)], "edge_id bigint, src bigint, dst bigint, inliers int")
    rows = graph_json.feature_rows(nodes, edges, node_ids=nodes.filter("node_id < 3"), edge_ids=edges.filter("edge_id = 5"))
    graph_json.write_collection(rows, str(tmp_path / "c"))
    text = "".join(open(f).read() for f in sorted(str(p) for p in (tmp_path / "c").glob("part-*")))
    got = json.loads(text)
    assert got["type"] == "FeatureCollection" and len(got["features"]) == 4
    line = next(f for f in got["features"] if f["geometry"]["type"] == "LineString")
    assert line["properties"] == {"id": "5", "source": "5", "dest": "6", "inliers": 50} and line["geometry"]["coordinates"] == [[5.0, 10.0], [6.0, 12.0]]


def test_geojson(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "/a", 1.0, 2.0), (2, "/b", 3.0, 4.0)], "node_id bigint, path string, x double, y double")
    edges = spark.createDataFrame([(9, 1, 2), (10, 1, 77)], "edge_id bigint, src bigint, dst bigint")
    rows = graph_json.feature_rows(nodes, edges)
    graph_json.write_geojson(rows, str(tmp_path / "g"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert sorted(f["geometry"]["type"] for f in got) == ["LineString", "Point", "Point"]


def test_micro_batches(spark, tmp_path):
    schema = "node_id bigint, position array<double>"
    batches = [[(i, [float(i), 0.0]) for i in range(4)], [(i, [float(i), 0.5]) for i in range(4, 8)] + [(0, [0.0, 0.0]), (9, None)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    src = tmp_path / "in"
    src.mkdir()
    import os
    import shutil

    for k in range(2):
        f = next((tmp_path / f"part{k}").glob("*.parquet"))
        shutil.copy(f, src / f"{k}.parquet")
        os.utime(src / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    q = ingest.ingest(spark, str(src), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert q.exception() is None
    images = spark.read.parquet(str(tmp_path / "out" / "images"))
    assert images.count() == 9 and images.filter("node_id = 0").count() == 1
    links = spark.read.parquet(str(tmp_path / "out" / "links"))
    assert links.filter("batch = 0 and dst >= 4").count() == 0 and links.filter("batch = 1 and dst < 4").count() > 0
    assert links.filter("src = dst").count() == 0


def test_rasters_hold_all_images(spark, tmp_path):
    """Images far from the origin: nothing of them lies within 300 m."""
    from pyspark.sql import functions as F

    from terraloom.plans import scenes
    from terraloom.plans.reference import positions
    from terraloom.runtime import read
    from tests.conftest import DATA

    p = F.col("position")
    read(spark, DATA, "images").withColumn("position", F.when(p.isNotNull(), F.array(p[0] + 1000, p[1] - 700, p[2]))).write.parquet(f"{tmp_path}/images.parquet")
    read(spark, DATA, "camera_models").write.parquet(f"{tmp_path}/camera_models.parquet")
    there = {(int(r.x // 5), int(r.y // 5)) for r in positions(spark, str(tmp_path)).collect()}
    tile = scenes.dsm_tile(spark, str(tmp_path)).collect()
    assert there <= {(r.col, r.row) for r in tile} and all(r.z is not None for r in tile)
    here, moved = (scenes.ortho_layers(spark, d).select("gx", "gy", "layer", "cam_id").collect() for d in (DATA, str(tmp_path)))
    assert len(here) > 0 and {(r.gx + 1000, r.gy - 700, r.layer, r.cam_id) for r in here} == {(r.gx, r.gy, r.layer, r.cam_id) for r in moved}


@pytest.mark.parametrize("n", [2, 13, 14, 25])
def test_every_image_of_a_batch_is_solved(n):
    from terraloom.plans import estimation

    k = np.arange(n)
    model = {"projection": "PLANAR", "model_id": 1, "focal": 1000.0, "ppx": 500.0, "ppy": 400.0, "k1": -0.05, "k2": 0.01, "k3": 0.006, "t1": -0.0002, "t2": -0.001}
    g = pd.DataFrame({"node_id": k, "batch": 0, "x": 10.0 * k, "y": 7.0 * (k % 3), "z": 100.0, "qx": 1.0, "qy": 0.0, "qz": 0.0, "qw": 0.0, **model})
    out = estimation.turned_and_solved(g, np.array([[0, n - 1]]))
    assert list(out["node_id"]) == list(k) and (out["error_before"] > 1e-3).all() and (out["error_after"] < 1e-5).all()
    alone = estimation.turned_and_solved(g.head(1), np.zeros((0, 2), int))
    assert len(alone) == 1 and alone["error_after"].isna().all()
    far = estimation.turned_and_solved(g.assign(projection=["UNKNOWN", *["PLANAR"] * (n - 1)]), np.zeros((0, 2), int))
    assert len(far) == n and far["error_after"].isna().tolist() == [True] + [False] * (n - 1)


def test_links_keep_groups_together():
    from terraloom.operators import clusters

    groups = clusters.link_groups(26, np.array([[0, 25], [11, 12]]), 12, 3)
    at = {int(i): k for k, g in enumerate(groups) for i in g}
    assert sorted(at) == list(range(26)) and at[0] == at[25] and at[11] == at[12] and min(map(len, groups)) >= 3


def test_crowded_batch_is_refined_to_the_end(spark, tmp_path):
    from terraloom.operators import mesh
    from terraloom.plans import estimation

    rng = np.random.default_rng(0)
    xyz = np.concatenate([rng.uniform(-300, 300, (3000, 3)), rng.normal(0, 5, (2000, 3)), [[9.0, 9.0, z] for z in range(50)]])
    pdf = pd.DataFrame({"node_id": range(len(xyz)), "batch": 1, "path": [f"{k:05}" for k in range(len(xyz))], "position": xyz.tolist()})
    spark.createDataFrame(pdf, "node_id bigint, batch int, path string, position array<double>").write.parquet(f"{tmp_path}/images.parquet")
    row = estimation.refine_mesh(spark, str(tmp_path)).first()
    assert row.conforming and row.triangles >= len(xyz) / mesh.MOST_POINTS
    m = mesh.PointMesh(np.array([[-400, -400, 0], [400, -400, 0], [-400, 400, 0], [400, 400, 0.0]]), np.array([[0, 1, 3], [0, 3, 2]]), xyz)
    m.refine_crowded()
    sizes = {i: max(np.linalg.norm(m.xyz[t[k]][:2] - m.xyz[t[k - 1]][:2]) for k in range(3)) for i, t in m.triangles.items()}
    left = [i for i in m.triangles if len(m.held[i]) > mesh.MOST_POINTS]
    assert left and all(sizes[i] < mesh.LEAST_SIZE for i in left)  # the fifty at one place
    assert sorted(np.concatenate(list(m.held.values()))) == list(range(len(xyz))) and set(m.held) == set(m.triangles)
    corners = [(i, *(float(v) for k in t for v in m.xyz[k])) for i, t in m.triangles.items()]
    corners = spark.createDataFrame(corners, "t int, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    counts = {r.t: r for r in mesh.triangle_counts(spark.createDataFrame([tuple(map(float, p)) for p in xyz[:5000]], "x double, y double, z double"), corners, 20.0).collect()}
    for i in list(m.triangles)[:40]:
        own = m.held[i][m.held[i] < 5000]
        assert len(own) == (counts[i].n if i in counts else 0)
        if len(own) == len(m.held[i]) > 1:
            assert m.variance(i) == pytest.approx(counts[i].variance, rel=1e-9)


def test_a_run_from_tables_to_mosaic(spark, tmp_path):
    """All stages over the test tables, with colours of the ground that every camera sees a little differently."""
    from pyspark.sql import functions as F

    from terraloom.plans import stages
    from tests.conftest import DATA

    def sample(layers):
        tone = F.pmod(F.xxhash64("cam_id"), F.lit(9)).cast("double")
        return layers.withColumns({"l": 40 + F.pmod(F.col("row") + F.col("col"), F.lit(10)) + tone, "a": F.lit(3.0), "b": F.lit(-2.0)})

    p = pipeline.Pipeline(spark, stages.default_steps(stages.Settings(pixel=20.0, sample=sample)), folder=str(tmp_path))
    p.state.tables.update(stages.start(spark, DATA))
    p.run_all()
    assert p.failure is None, f"{p.history[-1].stage}: {str(p.failure)[:600]}"
    assert [h.stage for h in p.history if h.run == 0] == pipeline.STAGES[:-1]
    t = p.state.tables
    assert {"links", "nodes", "edges", "preview", "points", "layers", "colours", "mosaic"} <= set(t)
    assert t["mosaic"].count() > 0 and t["mosaic"].filter("isnan(l) or l < 30 or l > 70").count() == 0
    again = pipeline.Pipeline(spark, stages.default_steps(), folder=str(tmp_path))
    again.resume(p.saved, "blend_layers")
    assert again.run_all().tables["mosaic"].count() == t["mosaic"].count()


def test_matched_images_are_turned_onto_the_plane():
    from terraloom.operators import solve
    from terraloom.plans import stages

    rng = np.random.default_rng(0)
    n = 6
    pos = np.column_stack([10.0 * np.arange(n), 4.0 * (np.arange(n) % 2), np.full(n, 60.0)])
    true = solve.matrix(np.tile([1.0, 0, 0, 0], (n, 1)))
    start = true @ solve.rotation(rng.normal(0, 0.02, (n, 3)))
    q = solve.quaternion(start)
    assert np.abs(solve.matrix(q) - start).max() < 1e-9
    model = {"model_id": 1, "focal": 800.0, "ppx": 500.0, "ppy": 400.0, "k1": 0.0, "k2": 0.0, "k3": 0.0, "t1": 0.0, "t2": 0.0}
    g = pd.DataFrame({"node_id": np.arange(n), "batch": 0, "path": [f"{k}" for k in range(n)], "x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2], **{c: q[:, k] for k, c in enumerate(("qx", "qy", "qz", "qw"))}, **model})
    rows = []
    for i in range(n):
        for j in range(i + 1, min(i + 3, n)):
            for w in np.column_stack([rng.uniform(pos[i, 0] - 10, pos[j, 0] + 10, 12), rng.uniform(-15, 15, 12), np.zeros(12)]):
                px = [((w - pos[k]) @ true[k])[:2] / ((w - pos[k]) @ true[k])[2] * 800 + [500, 400] for k in (i, j)]
                rows.append((0, i, j, *px[0], *px[1]))
    out = stages.turned(g, pd.DataFrame(rows, columns=["batch", "src", "dst", "x1", "y1", "x2", "y2"]), 50)
    angle = lambda m: np.arccos(np.clip((np.einsum("nij,nij->n", m, true) - 1) / 2, -1, 1))
    after = angle(solve.matrix(out[["qx", "qy", "qz", "qw"]].to_numpy()))
    assert after.max() < 0.3 * angle(start).max() and (out["moved"] > 0).all()
