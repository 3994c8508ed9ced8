"""Colour balance between overlapping images: a linear model with robust weights.

Images are solved in groups (batches, or components of the overlap graph) that share no image: one task holds the rows of many groups and
solves those of one size at once by their normal equations; a group of more than DENSE images is solved by conjugate gradients without
ever building a matrix. What groups share, the vignetting of the models, is a system of three unknowns a
model, summed up over all groups; groups and models take turns until nothing moves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.operators.graph import components
from terraloom.runtime import materialise, spread

HUBER, ROUNDS, PRIOR = 5.0, 20, 0.1
TURNS = 12  # of groups and models
MOVED = 1e-4  # of a parameter, below which a solve has ended
DENSE = 64  # images of a group that is solved by its normal equations
BUCKET_ROWS, CHUNK_ROWS, CHUNK_CELLS = 20_000, 8_192, 1 << 21  # rows a bucket of groups has on average; rows and matrix cells solved at once
_PER_IMAGE = 6  # offsets of L, a, b; reflectance; slope in x and y
#: Weights of the priors that pull to zero: offsets, reflectance and slopes of an image (by the root of its rows), vignetting of a model.
_LOOSE, _TIGHT, _MODEL_PRIOR = 1e-3, 100.0, 100.0
PARAMETERS = ["offset_l", "offset_a", "offset_b", "reflectance", "slope_x", "slope_y"]
_CHANNELS = ((0, [0, 3, 4, 5]), (1, [1]), (2, [2]))
_NEEDED = ["cam_a", "cam_b", "model_a", "model_b", "lab_a", "lab_b"]


def _robust(residual: np.ndarray) -> np.ndarray:
    return np.where(np.abs(residual) <= HUBER, 1.0, HUBER / np.maximum(np.abs(residual), 1e-12))


def _gradients(apply, b: np.ndarray, x: np.ndarray, rounds: int) -> np.ndarray:
    """Conjugate gradients for the system ``apply(x) = b``."""
    r = b - apply(x)
    p, rr = r.copy(), r @ r
    for _ in range(rounds):
        if rr < 1e-14 * max(1.0, b @ b):
            break
        q = apply(p)
        a = rr / max(p @ q, 1e-300)
        x, r = x + a * p, r - a * q
        rr, old = r @ r, rr
        p = r + rr / old * p
    return x


def _vignette(rows: pd.DataFrame, side: str) -> np.ndarray:
    r2 = rows[f"r_{side}"].to_numpy(float) ** 2
    return np.stack([r2, r2**2, r2**3], 1)


def _parts(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.stack([np.ones(len(rows)), rows[f"theta_{s}"].to_numpy(float) ** 2, rows[f"nx_{s}"].to_numpy(float), rows[f"ny_{s}"].to_numpy(float)], 1) for s in "ab"]


def _prior(weight: np.ndarray, columns: int) -> np.ndarray:
    return weight[:, None] * np.array([_LOOSE] + [_TIGHT] * (columns - 1)) + 1e-9


def _by_gradients(at: np.ndarray, n: int, d: np.ndarray, parts: list[np.ndarray], rounds: int) -> np.ndarray:
    """Parameters (n, 6) of a group's images, of which ``at`` are those of its rows' first and then second sides."""
    a, b = at[: len(d)], at[len(d) :]
    weight = (PRIOR**2) * np.maximum(1, np.bincount(at, minlength=n))
    x = np.zeros((n, _PER_IMAGE))
    for ch, cols in _CHANNELS:
        u, v = (p[:, : len(cols)] for p in parts)
        prior = _prior(weight, len(cols))

        def difference(y: np.ndarray) -> np.ndarray:
            return (u * y[a]).sum(1) - (v * y[b]).sum(1)

        y = np.zeros((n, len(cols)))
        for _ in range(rounds):
            w = _robust(d[:, ch] - difference(y))

            def back(e: np.ndarray) -> np.ndarray:
                sums = [np.bincount(at, np.concatenate([u[:, k] * e, -v[:, k] * e]), n) for k in range(len(cols))]
                return np.stack(sums, 1)

            new = _gradients(lambda z: (back(w * difference(z.reshape(y.shape))) + prior * z.reshape(y.shape)).ravel(), back(w * d[:, ch]).ravel(), y.ravel(), 20 * len(cols) + 4 * int(np.sqrt(n)) + 40).reshape(y.shape)
            moved, y = np.abs(new - y).max(), new
            if moved < MOVED / 10:
                break
        x[:, cols] = y
    return x


def _by_matrix(k: np.ndarray, a: np.ndarray, b: np.ndarray, groups: int, n: int, d: np.ndarray, parts: list[np.ndarray], rounds: int) -> np.ndarray:
    """Parameters (groups, n, 6) of groups of ``n`` images; a row is of group ``k`` and its images are the group's ``a``-th and ``b``-th. Each group
    ends by itself."""
    weight = (PRIOR**2) * np.maximum(1, np.bincount(np.concatenate([k * n + a, k * n + b]), minlength=groups * n))
    x = np.zeros((groups, n, _PER_IMAGE))
    for ch, cols in _CHANNELS:
        c, size = len(cols), n * len(cols)
        prior = _prior(weight, c).reshape(groups, size)
        y, live = np.zeros((groups, size)), np.arange(groups)
        z = np.concatenate([parts[0][:, :c], -parts[1][:, :c]], 1)
        place = np.concatenate([a[:, None] * c + np.arange(c), b[:, None] * c + np.arange(c)], 1)
        of, e = k, d[:, ch]
        row = None
        for _ in range(rounds):
            if row is None:
                row = of[:, None] * size + place
            w = _robust(e - (z * y[live].ravel()[row]).sum(1))
            wz = w[:, None] * z
            m = np.zeros(len(live) * size * size)
            for s in range(0, len(of), CHUNK_ROWS):  # one group may have more rows than that
                part = slice(s, s + CHUNK_ROWS)
                m += np.bincount((row[part, :, None] * size + place[part, None, :]).ravel(), (wz[part, :, None] * z[part, None, :]).ravel(), len(m))
            m = m.reshape(len(live), size, size)
            m[:, np.arange(size), np.arange(size)] += prior[live]
            g = np.bincount(row.ravel(), (wz * e[:, None]).ravel(), len(live) * size).reshape(len(live), size)
            new = np.linalg.solve(m, g[:, :, None])[:, :, 0]
            go = ~(np.abs(new - y[live]).max(1) < MOVED / 10)
            y[live] = new
            if not go.any():
                break
            if not go.all():
                keep = go[of]
                of, z, place, e, live, row = (np.cumsum(go) - 1)[of[keep]], z[keep], place[keep], e[keep], live[go], None
        x[:, :, cols] = y.reshape(groups, n, c)
    return x


def solve_groups(rows: pd.DataFrame, group: np.ndarray, vignetting: dict, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(images, the group of each, their parameters (n, 6), remaining differences of L, robust weights) of the rows of groups, with the
    models' vignetting given. Groups are numbers and share no image."""
    ids, at = np.unique(np.concatenate([rows["cam_a"], rows["cam_b"]]), return_inverse=True)
    d, none = rows[["d_l", "d_a", "d_b"]].to_numpy(float), np.zeros(3)
    for s, sign in (("a", 1.0), ("b", -1.0)):
        models, of = np.unique(rows[f"model_{s}"].to_numpy(), return_inverse=True)
        d[:, 0] -= sign * (_vignette(rows, s) * np.stack([vignetting.get(m, none) for m in models])[of]).sum(1)
    parts = _parts(rows)
    home = np.zeros(len(ids), np.int64)
    home[at] = np.concatenate([group, group])
    images = np.bincount(home)
    local = np.empty(len(ids), np.int64)
    order = np.argsort(home, kind="stable")
    local[order] = np.arange(len(ids)) - (np.cumsum(images) - images)[home[order]]
    a, b = at[: len(rows)], at[len(rows) :]
    x = np.zeros((len(ids), _PER_IMAGE))
    by_size = np.argsort(images[group], kind="stable")
    starts = np.flatnonzero(np.diff(images[group][by_size], prepend=-1))
    for mine in np.split(by_size, starts[1:]):
        n = int(images[group[mine[0]]])
        mine = mine[np.argsort(group[mine], kind="stable")]
        _, k = np.unique(group[mine], return_inverse=True)
        most = max(1, CHUNK_CELLS // (4 * n) ** 2) if n <= DENSE else 1
        first = np.flatnonzero(np.diff(k, prepend=-1))  # the row where each group begins
        s = 0
        while s < len(first):
            e = min(s + most, max(s + 1, int(np.searchsorted(first, first[s] + CHUNK_ROWS))))
            r = mine[first[s] : first[e] if e < len(first) else None]
            here = [p[r] for p in parts]
            if n <= DENSE:
                at_group = k[first[s] : first[s] + len(r)] - k[first[s]]
                found = _by_matrix(at_group, local[a[r]], local[b[r]], e - s, n, d[r], here, rounds)
                x[a[r]], x[b[r]] = found[at_group, local[a[r]]], found[at_group, local[b[r]]]
            else:
                found = _by_gradients(np.concatenate([local[a[r]], local[b[r]]]), n, d[r], here, rounds)
                x[a[r]], x[b[r]] = found[local[a[r]]], found[local[b[r]]]
            s = e
    tone = [0, 3, 4, 5]
    res = d[:, 0] - (parts[0] * x[a][:, tone]).sum(1) + (parts[1] * x[b][:, tone]).sum(1)
    return ids, home, x, res, _robust(res)


def _model_sums(rows: pd.DataFrame, res: np.ndarray, w: np.ndarray, vignetting: dict) -> pd.DataFrame:
    """(m1, m2, k, v): the rows' part in the models' normal equations; rows whose differences aren't known add nothing."""
    models, of = np.unique(np.concatenate([rows["model_a"], rows["model_b"]]), return_inverse=True)
    known = np.stack([vignetting.get(m, np.zeros(3)) for m in models])
    sides = [(of[: len(rows)], _vignette(rows, "a")), (of[len(rows) :], -_vignette(rows, "b"))]
    total = res + sum((f * known[m]).sum(1) for m, f in sides)
    out = []
    for m, f in sides:
        wf = w[:, None] * f
        for n, h in sides:
            pairs, at = np.unique(m * len(models) + n, return_inverse=True)
            for k in range(3):
                out += [(pairs // len(models), pairs % len(models), 3 * k + j, np.bincount(at, np.nan_to_num(wf[:, k] * h[:, j]), len(pairs))) for j in range(3)]
        out += [(range(len(models)), range(len(models)), 9 + k, np.bincount(m, np.nan_to_num(wf[:, k] * total), len(models))) for k in range(3)]
    sums = pd.concat([pd.DataFrame({"m1": m, "m2": n, "k": k, "v": v}) for m, n, k, v in out]).groupby(["m1", "m2", "k"], as_index=False)["v"].sum()
    return sums.assign(m1=models[sums["m1"]], m2=models[sums["m2"]])


def balance_groups(pairs: DataFrame, group: str, rounds: int = ROUNDS, turns: int = TURNS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """((group, cam_id, PARAMETERS), model -> vignetting of r2, r4, r6), so that corrected colours agree.

    ``pairs``: ``group``, cam_a, cam_b, model_a, model_b, lab_a, lab_b (arrays), r_a, r_b, theta_a, theta_b, nx_a, ny_a, nx_b, ny_b; groups share no
    image. A turn brings the models' normal equations, summed over all groups, to the driver: nine numbers for each pair of models that
    meet. Rows with a null among what is needed count for nothing."""
    spark = pairs.sparkSession
    kind, cam = dict(pairs.dtypes)[group], dict(pairs.dtypes)["cam_a"]
    apart = {f"d_{c}": F.get("lab_a", F.lit(k)).cast("double") - F.get("lab_b", F.lit(k)).cast("double") for k, c in enumerate("lab")}
    rows = materialise(pairs.dropna(subset=[*_NEEDED, group]).withColumns(apart).select(F.col(group).alias("_g"), *_NEEDED[:4], *apart, *(f"{c}_{s}" for c in ("r", "theta", "nx", "ny") for s in "ab")))
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_g"), F.lit(buckets)))
    model = dict(rows.dtypes)["model_a"]
    vignetting: dict[int, np.ndarray] = {}
    ddl = f"g {kind}, cam_id {cam}, x array<double>, m1 {model}, m2 {model}, k int, v double"
    solved = None
    for turn in range(turns):
        shared = spark.sparkContext.broadcast(dict(vignetting))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            names, of = np.unique(pdf["_g"].to_numpy(), return_inverse=True)
            ids, home, x, res, w = solve_groups(pdf, of, shared.value, rounds)
            images = pd.DataFrame({"g": names[home], "cam_id": ids, "x": list(x), "m1": None, "m2": None, "k": -1, "v": 0.0})
            sums = _model_sums(pdf, res, w, shared.value).assign(g=None, cam_id=None, x=None)
            return pd.concat([images, sums])[["g", "cam_id", "x", "m1", "m2", "k", "v"]]

        solved = materialise(spread(rows, "_bucket").groupBy("_bucket").applyInPandas(run, ddl))
        sums = solved.filter("k >= 0").groupBy("m1", "m2", "k").agg(F.sum("v").alias("v")).collect()
        models = sorted({r.m1 for r in sums})
        if not models:
            break
        at = {m: 3 * i for i, m in enumerate(models)}
        a, g = _MODEL_PRIOR * np.eye(3 * len(models)), np.zeros(3 * len(models))
        for r in sums:
            if r.k >= 9:
                g[at[r.m1] + r.k - 9] += r.v
            else:
                a[at[r.m1] + r.k // 3, at[r.m2] + r.k % 3] += r.v
        new = np.linalg.solve(a, g)
        moved = max(np.abs(new[k : k + 3] - vignetting.get(m, np.zeros(3))).max() for m, k in at.items())
        if moved < MOVED or turn == turns - 1:
            break
        vignetting = {m: new[k : k + 3] for m, k in at.items()}
    images = solved.filter("k < 0").select(F.col("g").alias(group), "cam_id", *(F.col("x")[i].alias(n) for i, n in enumerate(PARAMETERS)))
    return images, vignetting


def balance(pairs: DataFrame, rounds: int = ROUNDS) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(image -> PARAMETERS, model -> vignetting) of few images: groups are the components of the overlaps, and the result is fetched."""
    whole = pairs.dropna(subset=_NEEDED)
    groups = components(whole, "cam_a", "cam_b").select(F.col("node").alias("cam_a"), F.col("component").alias("_group"))
    images, models = balance_groups(whole.join(groups, "cam_a"), "_group", rounds)
    return {r.cam_id: np.array([r[n] for n in PARAMETERS]) for r in images.collect()}, models
