"""What the iterative operators spend, and that spending less changes nothing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraloom.functions import camera
from terraloom.operators import colour, robust


DATA = "/root/testdata/sf0.001"


def newton_steps(df):
    """How often the plan of ``df`` undistorts a pixel."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")


class Counted(robust.Homography):
    def __init__(self):
        self.fits = 0

    def fit(self, a, b):
        self.fits += 1
        return super().fit(a, b)


class Unbounded:
    """The homography without bounds: every sample is fitted."""

    points, threshold = robust.Homography.points, robust.Homography.threshold

    def __init__(self):
        m = robust.Homography()
        self.fit, self.refit, self.error = m.fit, m.refit, m.error


def flat(n, good, seed, shared=0):
    """Bearings of which ``good`` follow a homography, and ``shared`` of the others go to one point."""
    rng = np.random.default_rng(seed)
    a, b = (np.column_stack([rng.uniform(-0.6, 0.6, (n, 2)), np.ones(n)]) for _ in range(2))
    h = np.eye(3) + rng.normal(0, 0.05, (3, 3))
    to = a[:good] @ h.T
    b[:good] = to / to[:, 2:] + np.column_stack([rng.normal(0, 0.002, (good, 2)), np.zeros(good)])
    b[good : good + shared] = b[-1]
    return a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True), rng.integers(50, 200, n) / 486.0


@pytest.mark.parametrize("n, good, shared", [(24, 0, 0), (22, 0, 9), (30, 6, 4), (60, 20, 10), (8, 0, 0), (4, 4, 0)])
def test_bounded_samples_give_the_same_model(n, good, shared):
    a, b, quality = flat(n, good, n + good, shared)
    counted, plain = Counted(), Unbounded()
    got, want = robust.consensus(counted, a, b, quality), robust.consensus(plain, a, b, quality)
    assert got[0] == want[0] and np.array_equal(got[1], want[1]) and np.array_equal(got[2], want[2])


def test_matches_of_chance_are_hardly_fitted():
    a, b, quality = flat(24, 0, 1)
    counted = Counted()
    assert robust.consensus(counted, a, b, quality)[2].sum() >= 4 and counted.fits < 100  # of up to 10,000


@pytest.mark.parametrize("squeeze", [1.0, 1e-2, 1e-4, 1e-6])
def test_bounds_hold(squeeze):
    """No sample scores more than its bound, also where its points are nearly on a line."""
    a, b, _ = flat(20, 8, 3)
    a = a / a[:, 2:] * [1, squeeze, 1]
    rng, h = np.random.default_rng(5), robust.Homography()
    picks = np.array([rng.choice(20, 4, replace=False) for _ in range(1500)])
    for pick, bound in zip(picks, h.bounds(a, b, picks)):
        m = h.fit(a[pick], b[pick])
        assert bound == -np.inf if m is None else np.maximum(0, 1 - (h.error(m, a, b) / h.threshold) ** 2).sum() <= bound


def test_generator_after_samples():
    d = robust._Draws(30, 8, True, 42)
    rng = np.random.default_rng(42)
    rng.permutation(30)
    for r in range(1203):
        assert (rng.choice(min(30, 8 + r // robust.POOL_EVERY), 8, replace=False) == d.block(r // robust.BLOCK)[r % robust.BLOCK]).all()
    assert d.after(1203).random() == rng.random() and d.after(0).random() != d.after(500).random()


MODEL = {"focal": 900.0, "ppx": 500.0, "ppy": 400.0, "k1": -0.1, "k2": 0.02, "k3": 0.0, "t1": 1e-3, "t2": -2e-3}


def test_forward_rays_are_the_same(spark):
    px = spark.createDataFrame([(0.0, 0.0), (500.0, 400.0), (931.7, 12.5), (float("nan"), 1.0), (None, 1.0)], "x double, y double")
    m = {k: F.lit(v) for k, v in MODEL.items()}
    at = F.col("x"), F.col("y")
    for r in px.select(camera.forward_ray(at, m).alias("one"), F.array(*camera.unproject_forward(at, m)).alias("three")).collect():
        assert np.array_equal(np.array(r.one, float), np.array(r.three, float), equal_nan=True)


def test_ransac_links_undistorts_a_feature_once(spark):
    from terraloom.plans import estimation

    df = estimation._bearings(spark, DATA)
    assert newton_steps(df) == 2  # at either end of a match
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2  # and of no other feature


def test_refreshed_links_undistort_a_feature_once(spark):
    from terraloom.plans import scenes

    df = scenes._correspondences(spark, DATA)
    assert newton_steps(df) == 2 and df._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2


def tones(sizes, seed=0, first=1):
    """Rows of groups of so many images each, with their group; every image is linked, two rows have no colour and one image meets itself."""
    rng = np.random.default_rng(seed)
    parts = []
    for g, n in enumerate(sizes):
        a = np.concatenate([np.arange(n - 1), rng.integers(0, n, 8 * n)]) + first
        b = np.concatenate([np.arange(1, n), rng.integers(0, n, 8 * n)]) + first
        rows = pd.DataFrame({"group": g, "cam_a": a, "cam_b": b, "model_a": g % 3, "model_b": 1, "d_l": rng.normal(0, 8, len(a)), "d_a": rng.normal(0, 2, len(a)), "d_b": 0.0})
        for s in "ab":
            rows = rows.assign(**{f"r_{s}": rng.uniform(0, 1, len(a)), f"theta_{s}": rng.uniform(0, 0.5, len(a)), f"nx_{s}": rng.uniform(-0.7, 0.7, len(a)), f"ny_{s}": rng.uniform(-0.7, 0.7, len(a))})
        parts.append(rows)
        first += n
    return pd.concat(parts, ignore_index=True).sample(frac=1, random_state=1)


def lasting_gradient(rows, ids, x, vignetting):
    """The largest gradient of the robust sum of L and its priors where the solution is."""
    at = {n: k for k, n in enumerate(ids)}
    a, b = (rows[c].map(at).to_numpy() for c in ("cam_a", "cam_b"))
    d = rows["d_l"].to_numpy(float).copy()
    for s, sign in (("a", 1.0), ("b", -1.0)):
        d -= sign * (colour._vignette(rows, s) * np.stack([vignetting[m] for m in rows[f"model_{s}"]])).sum(1)
    (u, v), y = colour._parts(rows), x[:, [0, 3, 4, 5]]
    e = d - (u * y[a]).sum(1) + (v * y[b]).sum(1)
    e = (e * colour._robust(e))[:, None]
    g = colour._prior(colour.PRIOR**2 * np.maximum(1, np.bincount(np.concatenate([a, b]), minlength=len(ids))), 4) * y
    np.add.at(g, a, -u * e)
    np.add.at(g, b, v * e)
    return np.abs(g).max()


def test_colour_groups_are_solved_together(monkeypatch):
    rows = tones([2, 5, 5, 9, 30, 5, colour.DENSE + 6, 2])
    vignetting = {0: np.array([3.0, -1.0, 0.5]), 1: np.array([-2.0, 1.0, 0.0]), 2: np.zeros(3)}
    ids, home, x, res, w = colour.solve_groups(rows, rows["group"].to_numpy(), vignetting)
    for g, own in rows.groupby("group"):
        of = home == g
        assert set(ids[of]) == set(own["cam_a"]) | set(own["cam_b"])
        assert lasting_gradient(own, ids[of], x[of], vignetting) < (2e-2 if of.sum() > colour.DENSE else 1e-3)
        alone = colour.solve_groups(own, np.zeros(len(own), int), vignetting)
        assert x[of] == pytest.approx(alone[2], abs=1e-6) and np.sort(res[(rows["group"] == g).to_numpy()]) == pytest.approx(np.sort(alone[3]), abs=1e-6)
    monkeypatch.setattr(colour, "CHUNK_ROWS", 60)
    assert colour.solve_groups(rows, rows["group"].to_numpy(), vignetting)[2] == pytest.approx(x, abs=1e-6)


def test_matrix_and_gradients_agree(monkeypatch):
    rows = tones([12])
    got = colour.solve_groups(rows, rows["group"].to_numpy(), {})[2]
    monkeypatch.setattr(colour, "DENSE", 1)
    want = colour.solve_groups(rows, rows["group"].to_numpy(), {})[2]
    assert got[:, 1:] == pytest.approx(want[:, 1:], abs=1e-2) and got[:, 0] - got[0, 0] == pytest.approx(want[:, 0] - want[0, 0], abs=1e-2)


def test_model_sums():
    rows = tones([6, 4])
    vignetting = {0: np.array([3.0, -1.0, 0.5]), 1: np.array([-2.0, 1.0, 0.0])}
    _, _, _, res, w = colour.solve_groups(rows, rows["group"].to_numpy(), vignetting)
    res[3] = np.nan
    w[3] = np.nan
    got = {(r.m1, r.m2, r.k): r.v for r in colour._model_sums(rows, res, w, vignetting).itertuples()}
    models = [0, 1]
    f = np.zeros((len(rows), 2, 3))
    for s, sign in (("a", 1.0), ("b", -1.0)):
        for m in models:
            f[:, m] += sign * colour._vignette(rows, s) * (rows[f"model_{s}"] == m).to_numpy()[:, None]
    total = res + sum((f[:, m] @ vignetting[m]) for m in models)
    ok = ~np.isnan(w)
    for m in models:
        assert [got[m, m, 9 + k] for k in range(3)] == pytest.approx((f[ok, m] * (w * total)[ok, None]).sum(0))
        for n in models:
            assert [got.get((m, n, k), 0.0) for k in range(9)] == pytest.approx((f[ok, m].T @ (w[ok, None] * f[ok, n])).ravel())


def test_color_balance_ends_at_its_minimum(spark):
    """What all images of a group have in common is seen by the priors only, so that their weighted offsets sum to nothing; ids keep all digits."""
    rows = tones([4, 7, 7], first=2**62 + 1)
    rows["d_l"] += rows["cam_a"] % 7 * 2.0
    lab = rows.assign(lab_a=[[x, y, 0.0] for x, y in zip(rows["d_l"], rows["d_a"])], lab_b=[[0.0, 0.0, 0.0]] * len(rows)).drop(columns=["d_l", "d_a", "d_b"])
    images, _ = colour.balance_groups(spark.createDataFrame(lab), "group")
    found = images.toPandas().set_index("cam_id")
    n = pd.concat([rows["cam_a"], rows["cam_b"]]).value_counts()
    assert set(found.index) == set(n.index) and found["group"].value_counts().to_dict() == {0: 4, 1: 7, 2: 7}
    for _, own in found.groupby("group"):
        assert abs((own["offset_l"] * n[own.index]).sum() / n[own.index].sum()) < 1e-4


def test_colours_of_two_images_with_many_rows_take_little_memory():
    import tracemalloc

    rows = tones([2])
    rows = rows.loc[rows.index.repeat(200_000 // len(rows))].reset_index(drop=True)
    tracemalloc.start()
    colour.solve_groups(rows, np.zeros(len(rows), int), {})
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1000 * len(rows)  # bytes; the cells of all rows at once would be more
