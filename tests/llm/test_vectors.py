import numpy as np
import pytest

from terraloom.llm import vectors as v

SCHEMA = "node_id bigint, idx int, descriptor array<bigint>, bits int, node int"


def pack(bits):
    out = np.zeros((len(bits), 512), np.uint8)
    out[:, : v.BITS] = bits
    return np.packbits(out, axis=1, bitorder="little").view(np.int64)


def collection(tracks, noise, singles, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(tracks):
        t = rng.integers(0, 2, v.BITS)
        for _ in range(rng.integers(2, 7)):
            rows.append(t ^ (rng.random(v.BITS) < rng.uniform(0, noise)))
    rows += list(rng.integers(0, 2, (singles, v.BITS)))
    words = pack(np.array(rows))
    return [(1000 + i // 7, i % 7, w.tolist()) for i, w in enumerate(words)]


def brute(rows, k=5, most=96):
    rows = sorted({(n, i): d for n, i, d in rows if n is not None and i is not None and d is not None and len(d) == 8 and any(d)}.items())
    w = np.array([d for _, d in rows], np.int64).view(np.uint64)
    out = set()
    for i in range(len(rows)):
        d = np.bitwise_count(w ^ w[i]).sum(1)
        near = [j for j in np.lexsort((np.arange(len(w)), d)) if j != i and d[j] <= most][:k]
        out |= {(*rows[min(i, j)][0], *rows[max(i, j)][0]) for j in near}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)
    return {tuple(r)[:4] for r in v.nearest_pairs(df, "node_id", "idx", "descriptor", **kw).collect()}


def test_recall_against_brute_force(spark):
    rows = collection(300, 0.1, 600)
    want = brute(rows)
    got = run(spark, rows)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_copies_ties_and_dirt(spark):
    base = collection(0, 0, 3)
    rows = base + [(1, i, base[0][2]) for i in range(12)] + [(9, 9, None), (9, 8, [0] * 8), (9, 7, [1] * 7), (9, 6, [None] * 8), (None, 1, base[1][2]), (1, 3, base[0][2])]
    assert run(spark, rows) == brute(rows)


def test_crowded_cell_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(v, "DB_BLOCK", 40)
    monkeypatch.setattr(v, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(1)
    t = rng.integers(0, 2, v.BITS)
    rows = [(1, i, w.tolist()) for i, w in enumerate(pack(np.array([t ^ (rng.random(v.BITS) < 0.05) for _ in range(150)])))]
    want, got = brute(rows), run(spark, rows)
    assert len(got & want) >= 0.9 * len(want)


def test_exact_search_is_brute_force(spark):
    rows = collection(40, 0.1, 40)
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)
    from pyspark.sql import functions as F

    got = v.exact_neighbours(df, "node_id", "idx", "descriptor", F.lit(True)).collect()
    pairs = {tuple(sorted([(r.qnode, r.qidx), (r.node, r.idx)])) for r in got}
    assert {(*a, *b) for a, b in pairs} == brute(rows)


def test_anisotropic_loss_is_lower_with_its_own_codes():
    rng = np.random.default_rng(0)
    x = v.unpack(pack(rng.integers(0, 2, (800, v.BITS))))
    books = v.fit_books(x, rounds=2)
    weight = v.parallel_weight()

    def loss(codes):
        r = x - books[np.arange(v.SUBSPACES)[None], codes].reshape(len(x), -1)
        return ((r**2).sum(1) + weight * (r * x).sum(1) ** 2).mean()

    assert loss(v.encode(x, books, weight)) < loss(v.encode(x, books, 0.0))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny(spark, n):
    rows = collection(0, 0, 2)[:n]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5_000, 8_192, 16_385, 23_067, 65_000, 65_536])
def test_codebook_rows_cover_the_whole_sample(n):
    part, others = v.codebook_rows(n)
    assert part[0] == 0 and max(part[-1], others[-1]) == n - 1 and len(part) <= v.CODEBOOK_ROWS
    assert n == 1 or not set(part) & set(others)
    assert max(np.diff(part), default=0) <= 2 * -(-n // min(n, 2 * v.CODEBOOK_ROWS)) + 1
