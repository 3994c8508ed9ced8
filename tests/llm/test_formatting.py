import random

import pytest

from terraloom.llm import formatting as f

SCHEMA = "ord int, make string, model string, lens string, w int, focal double, first int, key string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    return f.collapse(df, "ord", ["make", "model", "lens"], ["w", "focal"])


def brute(rows):
    groups = {}
    for o, *texts, w, focal in rows:
        if o is None:
            continue
        k = tuple(sorted("".join(c for c in (t or "") if c.isalnum()).casefold() for t in texts)), w, None if focal is None or focal != focal else focal
        groups.setdefault(k, set()).add(o)
    return sorted((o, min(g)) for g in groups.values() for o in g)


def test_rules(spark):
    rows = [(1, "Ab c", "X-1", None, 5, 1.0), (2, "x1", "ABC", " ", 5, 1.0), (3, "ABC", "X1", "", 6, 1.0), (4, "ABC", "X1", "", 5, None), (5, "abc", "x 1", "-", 5, float("nan")), (6, "Straße", "É", "", 1, 1.0), (7, "STRASSE", "é", None, 1, 1.0), (None, "a", "b", "c", 1, 1.0), (8, None, None, None, None, None), (9, "", " ", "!", None, None)]
    got = sorted((r.id, r.first) for r in run(spark, rows).distinct().collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 8)]


def test_hot_group_over_many_ranges_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "Hot", "one", "", 1, 1.0) for i in range(4000)] + [(4000 + i, rng.choice("abc") * 3, rng.choice("xyz"), None, rng.choice([1, 2]), None) for i in range(4000)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.id, r.first) for r in run(spark, rows).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)


def test_counts_repeats_and_long_texts(spark):
    rows = [(1, "a" * 200_000, "m", "", 1, 1.0), (2, ("A" * 1000 + " ") * 200, "M", "", 1, 1.0), (2, ("A" * 1000 + " ") * 200, "M", "", 1, 1.0)]
    assert [tuple(r) for r in f.copies(run(spark, rows)).collect()] == [(1, 2)]


@pytest.mark.parametrize("n", [0, 1])
def test_small(spark, n):
    assert run(spark, [(1, None, None, None, None, None)][:n]).count() == n
