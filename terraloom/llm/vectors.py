"""Most similar vectors for every vector of a large collection: anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are packed bits; with bits as signs, the fewest differing bits are the greatest inner product. A bounded sample fits
(a) centroids that split the collection into cells and (b) product codebooks of 16 words for each subspace, whose loss weighs the
residual parallel to the vector more than the rest of it (score-aware). Every vector is indexed in its best ``SPILL`` cells and asks
its best ``PROBES`` cells; in a cell the asker's look-up tables, 8 bits wide, are summed over the four-bit codes, and all whose sum
could belong to a vector within the wanted bits are compared bit by bit. The bound of that sum is fitted, too: all but ``MISSED`` of the
sample's vectors with as many bits flipped stay above it. Only descriptors that differ enter the index; equal ones are one row with their smallest keys.

Defined results: null vectors, vectors of another length, with null words or all zero take no part; repeated rows of a key count once;
ties go to the smaller key; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.runtime import materialise

WORDS, BITS = 8, 486
SAMPLE_ROWS = 65_536  # bound of the sample that fits centroids and codebooks
CODEBOOK_ROWS = 8_192  # of which the codebooks use so many
MAX_CELLS = 4_096
SPILL, PROBES = 4, 12
SUBSPACES, CODES = 18, 16
ALIGNMENT = 0.2  # inner products above this share of the greatest count in the score-aware loss
MISSED = 0.001
RERANK_PAIRS = 1 << 20  # compared at a time
DB_BLOCK, QUERY_BLOCK = 32_768, 16_384
PART_ROWS = 16_384  # of the exact search
_W = [f"w{k}" for k in range(WORDS)]


def unpack(words: np.ndarray) -> np.ndarray:
    """Unit vectors of signs from packed words (n, WORDS)."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, :BITS]
    v = bits.astype(np.float32)
    v *= np.float32(2 / np.sqrt(BITS))
    v -= np.float32(1 / np.sqrt(BITS))
    return v


def fit_cells(v: np.ndarray, cells: int, rounds: int = 5, seed: int = 0) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), cells, replace=len(v) < cells)]
    for _ in range(rounds):
        sums, counts = np.zeros_like(c), np.zeros(cells, np.int64)
        for s in range(0, len(v), 8192):
            part = v[s : s + 8192]
            at = (part @ c.T).argmax(1)
            order = np.argsort(at, kind="stable")
            found, start = np.unique(at[order], return_index=True)
            sums[found] += np.add.reduceat(part[order], start)
            counts += np.bincount(at, minlength=cells)
        empty = counts == 0
        sums[empty] = v[rng.choice(len(v), int(empty.sum()))]
        c = sums
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def _blocks(v: np.ndarray) -> np.ndarray:
    return v.reshape(len(v), SUBSPACES, -1)


def encode(v: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n, SUBSPACES) by coordinate descent on |r|^2 + weight * (r . x)^2, r the residual of the unit vector x."""
    x = _blocks(v)
    dots = np.einsum("nmd,mkd->nmk", x, books, optimize=True)
    error = (books**2).sum(2)[None] - 2 * dots
    codes = error.argmin(2)
    parallel = (x**2).sum(2)[:, :, None] - dots
    rows = np.arange(len(v))
    total = np.take_along_axis(parallel, codes[:, :, None], 2).sum((1, 2))
    for _ in range(sweeps):
        for m in range(SUBSPACES):
            rest = total - parallel[rows, m, codes[:, m]]
            codes[:, m] = (error[:, m] + weight * (rest[:, None] + parallel[:, m]) ** 2).argmin(1)
            total = rest + parallel[rows, m, codes[:, m]]
    return codes.astype(np.uint8)


def parallel_weight(t: float = ALIGNMENT, d: int = BITS) -> float:
    return (d - 1) * t * t / (1 - t * t) - 1


def fit_books(v: np.ndarray, rounds: int = 4, seed: int = 0) -> np.ndarray:
    """Codebooks (SUBSPACES, CODES, BITS / SUBSPACES) that minimise the score-aware loss."""
    rng, x = np.random.default_rng(seed), _blocks(v)
    weight, d = parallel_weight(), BITS // SUBSPACES
    books = np.stack([x[rng.choice(len(v), CODES, replace=len(v) < CODES), m] * 0.5 for m in range(SUBSPACES)])
    rows = np.arange(len(v))
    for r in range(rounds):
        codes = encode(v, books, weight if r else 0.0)
        chosen = books[np.arange(SUBSPACES)[None], codes]
        gaps = ((x - chosen) * x).sum(2)
        for m in range(SUBSPACES):
            rest, own = gaps.sum(1) - gaps[:, m], (x[:, m] ** 2).sum(1)
            for k in range(CODES):
                of = rows[codes[:, m] == k]
                if len(of):
                    a = x[of, m]
                    left = len(of) * np.eye(d) + weight * (a.T @ a)
                    books[m, k] = np.linalg.solve(left, a.sum(0) + weight * ((rest[of] + own[of])[:, None] * a).sum(0))
            gaps[:, m] = ((x[:, m] - books[m, codes[:, m]]) * x[:, m]).sum(1)
    return books.astype(np.float32)


def scan(q: np.ndarray, codes: np.ndarray, books: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(asker, place) of all codes whose summed 8-bit look-up tables reach ``bound``, in the order of askers; ``q`` is (n, WORDS)."""
    tables = np.einsum("nmd,mkd->mkn", _blocks(unpack(q)), books, optimize=True)
    low = tables.min((0, 1))
    scale = 255 / np.maximum((tables - low).max((0, 1)), 1e-9)
    tables = np.rint((tables - low) * scale).astype(np.uint8)
    total = np.zeros((len(codes), len(q)), np.uint16)
    for m in range(SUBSPACES):
        total += tables[m][codes[:, m]]
    least = np.clip((bound - SUBSPACES * low) * scale - SUBSPACES / 2, 0, 65_535).astype(np.uint16)
    place, asker = np.nonzero(total >= least)
    order = np.argsort(asker, kind="stable")
    return asker[order], place[order]


def fit_bound(v: np.ndarray, books: np.ndarray, max_bits: int, seed: int = 1) -> float:
    """The sum that all but MISSED of the pairs at ``max_bits`` reach."""
    rng = np.random.default_rng(seed)
    flipped = v.copy()
    for row in flipped:
        row[rng.choice(BITS, min(max_bits, BITS), replace=False)] *= -1
    codes = encode(v, books, parallel_weight())
    decoded = books[np.arange(SUBSPACES)[None], codes].reshape(len(v), -1)
    return float(np.quantile((flipped * decoded).sum(1), MISSED))


@dataclass
class Index:
    centroids: np.ndarray
    books: np.ndarray
    bound: float


def codebook_rows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a sorted sample of ``n`` that fit the codebooks, and as many others that fit the bound, each even over the whole order. A
    sample too small for both is halved between them; a single row fits both."""
    both = np.unique(np.linspace(0, n - 1, min(n, 2 * CODEBOOK_ROWS)).round().astype(np.int64))
    return both[::2], both[1::2] if n > 1 else both


def _fit(groups: DataFrame, max_bits: int) -> Index:
    n = groups.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    sample = groups.select(*_W)
    w = (sample.sample(share, seed=11) if share < 1 else sample).toPandas().to_numpy(np.int64)
    w = w[np.lexsort(w.T)] if len(w) else np.ones((1, WORDS), np.int64)  # in an order that doesn't hang on partitions
    v = unpack(w)
    cells = 1
    while cells * cells < 4 * n and cells < MAX_CELLS:
        cells *= 2
    part, others = codebook_rows(len(v))
    books = fit_books(v[part])
    return Index(fit_cells(v, min(cells, max(1, len(v) // 8))), books, fit_bound(v[others], books, max_bits))


def valid_vectors(df: DataFrame, node: str, idx: str, vector: str) -> DataFrame:
    """(node, idx, w0 … w7), one row for each key with a usable vector."""
    v = F.col(vector)
    out = df.filter(F.col(node).isNotNull() & F.col(idx).isNotNull() & (F.size(v) == WORDS) & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0))
    out = out.select(F.col(node).cast("bigint").alias("node"), F.col(idx).cast("int").alias("idx"), *(v[k].alias(n) for k, n in enumerate(_W)))
    return out.groupBy("node", "idx").agg(F.min(F.struct(*_W)).alias("v")).select("node", "idx", *(F.col(f"v.{n}").alias(n) for n in _W))


def distinct_vectors(features: DataFrame, k: int) -> DataFrame:
    """Each different vector once, with its ``k + 1`` smallest keys: no more can be among anyone's nearest k."""
    w = Window.partitionBy(*_W).orderBy("node", "idx")
    first = features.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    return first.groupBy(*_W).agg(F.sort_array(F.collect_list(F.struct("node", "idx"))).alias("keys"))


def candidates(groups: DataFrame, k: int, max_bits: int) -> DataFrame:
    """(qnode, qidx, node, idx, bits): near vectors of every different vector, both named by their smallest key."""
    spark = groups.sparkSession
    index = spark.sparkContext.broadcast(_fit(groups, max_bits))

    def assign(batches):
        x = index.value
        spill, probes = min(SPILL, len(x.centroids)), min(PROBES, len(x.centroids))
        for b in batches:
            v = unpack(b[_W].to_numpy(np.int64))
            score = v @ x.centroids.T
            best = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), 1, kind="stable"), 1)
            codes = encode(v, x.books, parallel_weight())
            yield b.assign(codes=[c.tobytes() for c in codes], homes=[r.tolist() for r in best[:, :spill]], cells=[r.tolist() for r in best])

    rows = groups.select(F.col("keys")[0]["node"].alias("node"), F.col("keys")[0]["idx"].alias("idx"), *_W)
    ddl = "node bigint, idx int, " + ", ".join(f"{w} bigint" for w in _W) + ", codes binary, homes array<int>, cells array<int>"
    rows = materialise(rows.mapInPandas(assign, ddl))
    # At most MAX_CELLS counts reach the driver; they decide how crowded cells are cut into blocks.
    count = lambda c: {r.c: r.n for r in rows.select(F.explode(c).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    indexed, asked = count("homes"), count("cells")
    cuts = {c: (-(-indexed.get(c, 1) // DB_BLOCK), -(-n // QUERY_BLOCK)) for c, n in asked.items()}
    crowded = [(c, *x) for c, x in cuts.items() if x != (1, 1)]
    table = F.broadcast(spark.createDataFrame(crowded, "cell int, db_cuts int, q_cuts int"))
    spread = rows.select("*", F.posexplode("cells").alias("rank", "cell")).drop("cells")
    spread = spread.withColumn("db", F.array_contains("homes", F.col("cell"))).drop("homes", "rank").join(table, "cell", "left").fillna(1, ["db_cuts", "q_cuts"])
    h = F.xxhash64("node", "idx")
    own_db, own_q = F.pmod(h, F.col("db_cuts")).cast("int"), F.pmod(h, F.col("q_cuts")).cast("int")
    asks = F.transform(F.sequence(F.lit(0), F.col("db_cuts") - 1), lambda d: F.struct(d.alias("d"), own_q.alias("q"), F.lit(True).alias("asks"), (F.col("db") & (d == own_db)).alias("told")))
    told = F.filter(
        F.transform(F.sequence(F.lit(0), F.col("q_cuts") - 1), lambda q: F.struct(own_db.alias("d"), q.alias("q"), F.lit(False).alias("asks"), F.col("db").alias("told"))),
        lambda s: s["told"] & (s["q"] != own_q),
    )
    spread = spread.withColumn("s", F.explode(F.concat(asks, told)))
    spread = spread.select("cell", F.col("s.d").alias("d"), F.col("s.q").alias("q"), F.col("s.asks").alias("asks"), F.when(F.col("s.told"), F.col("codes")).alias("codes"), "node", "idx", *_W)

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        told = pdf["codes"].notna().to_numpy()
        asks = pdf["asks"].to_numpy(bool)
        words = pdf[_W].to_numpy(np.int64).view(np.uint64)
        node, idx = pdf["node"].to_numpy(), pdf["idx"].to_numpy()
        out = {"qnode": [], "qidx": [], "node": [], "idx": [], "bits": []}
        if told.any():
            dw, dn, di = words[told], node[told], idx[told]
            codes = np.frombuffer(b"".join(pdf["codes"].to_numpy()[told]), np.uint8).reshape(-1, SUBSPACES)
            for at in np.array_split(np.flatnonzero(asks), -(-int(asks.sum()) // 1024) or 1):
                if not len(at):
                    continue
                r, j = scan(words[at].view(np.int64), codes, index.value.books, index.value.bound)
                b = np.concatenate([np.bitwise_count(words[at[r[s : s + RERANK_PAIRS]]] ^ dw[j[s : s + RERANK_PAIRS]]).sum(1, dtype=np.int32) for s in range(0, max(1, len(r)), RERANK_PAIRS)])
                near_by = (b <= max_bits) & ((dn[j] != node[at][r]) | (di[j] != idx[at][r]))
                r, j, b = r[near_by], j[near_by], b[near_by]
                order = np.lexsort((di[j], dn[j], b, r))
                r, j, b = r[order], j[order], b[order]
                start = np.searchsorted(r, r)
                keep = np.arange(len(r)) - start < k
                r, j, b = r[keep], j[keep], b[keep]
                for name, x in (("qnode", node[at][r]), ("qidx", idx[at][r]), ("node", dn[j]), ("idx", di[j]), ("bits", b)):
                    out[name].append(x)
        return pd.DataFrame({n: np.concatenate(x) if x else np.empty(0, np.int64) for n, x in out.items()})

    return spread.groupBy("cell", "d", "q").applyInPandas(near, "qnode bigint, qidx int, node bigint, idx int, bits int")


def nearest_pairs(df: DataFrame, node: str, idx: str, vector: str, k: int = 5, max_bits: int = 96) -> DataFrame:
    """Pairs (node_a, idx_a, node_b, idx_b, bits), smaller key first, where one is among the k nearest of the other within ``max_bits``."""
    features = materialise(valid_vectors(df, node, idx, vector))
    groups = materialise(distinct_vectors(features, k))
    key = lambda n, i: F.struct(F.col(n).alias("node"), F.col(i).alias("idx"))
    found = candidates(groups, k, max_bits).select(key("qnode", "qidx").alias("q"), key("node", "idx").alias("n"), "bits").distinct()
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("bits", "n"))).filter(F.col("r") <= k)
    keyed = groups.select(F.col("keys")[0].alias("n"), "keys")
    own = groups.select(F.col("keys")[0].alias("q"), F.lit(0).alias("bits"), "keys")
    others = best.join(keyed, "n").select("q", "bits", "keys")
    item = F.struct("bits", F.col("x").alias("key"))
    near = own.unionByName(others).select("q", "bits", F.explode("keys").alias("x")).groupBy("q").agg(F.slice(F.sort_array(F.collect_list(item)), 1, k + 1).alias("near")).filter(F.size("near") > 1)
    near = groups.select(F.col("keys")[0].alias("q"), *_W).join(near, "q").drop("q")
    me = key("node", "idx")
    pairs = features.join(near, _W).select(me.alias("me"), F.explode(F.slice(F.filter("near", lambda c: c["key"] != me), 1, k)).alias("c"))
    pairs = pairs.select(F.least("me", "c.key").alias("a"), F.greatest("me", "c.key").alias("b"), "c.bits").distinct()
    return pairs.select(F.col("a.node").alias("node_a"), F.col("a.idx").alias("idx_a"), F.col("b.node").alias("node_b"), F.col("b.idx").alias("idx_b"), "bits")


def exact_neighbours(df: DataFrame, node: str, idx: str, vector: str, queries, k: int = 5, max_bits: int = 96, block: int = 2048) -> DataFrame:
    """(qnode, qidx, node, idx, bits) by brute force for the stated query set ``queries`` (a filter on node and idx), in blocks against all rows."""
    features = materialise(valid_vectors(df, node, idx, vector))
    asked = features.filter(queries)
    blocks = F.pmod(F.xxhash64("node", "idx"), F.lit(max(1, -(-asked.count() // block))))
    asked = asked.withColumn("block", blocks).groupBy("block").agg(F.collect_list(F.struct("node", "idx", *_W)).alias("qs"))
    parts = max(1, -(-features.count() // PART_ROWS))
    spread = features.withColumn("part", F.pmod(F.xxhash64("node", "idx"), F.lit(parts))).groupBy("part").agg(F.collect_list(F.struct("node", "idx", *_W)).alias("rows"))
    both = spread.join(asked)

    def compare(batches):
        for b in batches:
            for qs, rows in zip(b["qs"], b["rows"]):
                get = lambda xs, n: np.array([x[n] for x in xs], np.int64)
                qw = np.array([[x[n] for n in _W] for x in qs], np.int64).view(np.uint64)
                rw = np.array([[x[n] for n in _W] for x in rows], np.int64).view(np.uint64)
                qn, qi, rn, ri = get(qs, "node"), get(qs, "idx"), get(rows, "node"), get(rows, "idx")
                for s in range(0, len(qw), 16):
                    d = np.bitwise_count(qw[s : s + 16, None] ^ rw[None]).sum(2, dtype=np.int32)
                    i, j = np.nonzero(d <= max_bits)
                    other = (qn[s + i] != rn[j]) | (qi[s + i] != ri[j])
                    i, j = i[other], j[other]
                    yield pd.DataFrame({"qnode": qn[s + i], "qidx": qi[s + i], "node": rn[j], "idx": ri[j], "bits": d[i, j]})

    near = both.mapInPandas(compare, "qnode bigint, qidx int, node bigint, idx int, bits int")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("qnode", "qidx").orderBy("bits", "node", "idx"))).filter(F.col("r") <= k).drop("r")
