import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import readings as r

FIELDS = [r.Reading("alt", -500.0, 12_000.0), r.Reading("yaw", -360.0, 360.0, period=180.0)]


def flags(spark, series, yaw=None, chunk_rows=64):
    rows = [(i, "s", f"p{i:05d}", None if a is None else float(a), None if yaw is None else float(yaw[i])) for i, a in enumerate(series)]
    df = spark.createDataFrame(rows, "id bigint, src string, path string, alt double, yaw double")
    out = r.implausible(df, "id", "src", "path", FIELDS, {"alt": F.col("alt"), "yaw": F.col("yaw")}, chunk_rows)
    return {(x.key, x.field): x.reason for x in out.collect()}


def noise(n, seed=0):
    return 100 + np.random.default_rng(seed).normal(0, 0.1, n)


def test_spikes_and_limits_and_nulls(spark):
    a = list(noise(200))
    a[50] += 20
    a[80:83] = [x + 20 for x in a[80:83]]
    a[63] += 15  # next to a chunk's edge
    a[100] = 99_999
    a[120] = None
    a[130] = float("nan")
    assert flags(spark, a) == {(50, "alt"): "spike", (63, "alt"): "spike", **{(k, "alt"): "spike" for k in (80, 81, 82)}, (100, "alt"): "impossible"}


def test_lasting_change_and_four_in_a_row_are_none(spark):
    a = noise(200)
    a[100:] += 30
    a[40:44] += 20
    assert flags(spark, list(a)) == {}


def test_reading_between_spikes_stays(spark):
    a = noise(100)
    a[[40, 41, 43]] += 20
    assert {k for k, _ in flags(spark, list(a))} == {40, 41, 43}


def test_stuck_values_over_chunks(spark):
    a = noise(200)
    a[60:70] = a[60]
    a[20:25] = a[20]  # five: none
    got = flags(spark, list(a))
    assert {k for k, _ in got} == set(range(60, 70)) and set(got.values()) == {"stuck"}


def test_constant_source_has_no_stuck_values_but_spikes(spark):
    a = np.full(60, 5.0)
    a[30] = 50.0
    assert flags(spark, list(a)) == {(30, "alt"): "spike"}


def test_half_turn_is_normal(spark):
    yaw = np.where(np.arange(60) // 10 % 2 == 0, 30.0, -150.0) + np.random.default_rng(1).normal(0, 0.5, 60)
    yaw[25] += 90
    assert flags(spark, [None] * 60, yaw) == {(25, "yaw"): "spike"}


def test_matches_one_window_over_the_source(spark):
    rng = np.random.default_rng(5)
    a = noise(700, 3)
    for k in rng.choice(700, 25, replace=False):
        a[k] += rng.choice([-1, 1]) * 30
    a[300:309] = a[300]
    assert flags(spark, list(a), chunk_rows=50) == flags(spark, list(a), chunk_rows=100_000)


def test_empty_and_repeated(spark):
    schema = "id bigint, src string, path string, alt double, yaw double, key int, field int"
    df = spark.createDataFrame([], schema)
    values = {"alt": F.col("alt"), "yaw": F.col("yaw")}
    assert r.implausible(df, "id", "src", "path", FIELDS, values).count() == 0
    df = spark.createDataFrame([(1, None, "a", 1e9, None, 1, 1)] * 3, schema)
    assert [tuple(x) for x in r.implausible(df, "id", "src", "path", FIELDS, values).collect()] == [(1, "alt", "impossible")]


@pytest.mark.parametrize("spread, n", [(3.0, 1), (1e9, 0)])
def test_fences(spark, spread, n):
    rows = [(i, "s", float(i % 5)) for i in range(50)] + [(99, "s", 500.0)]
    df = spark.createDataFrame(rows, "id bigint, src string, alt double")
    assert r.hourly_fences(df, "id", "src", F.lit(3), FIELDS[:1], {"alt": F.col("alt")}, spread).count() == n


def test_fences_go_by_the_hour_of_capture(spark, tmp_path):
    """Low flights in the morning, high ones in the evening, all delivered in the same hour; two readings are of the other flight's height."""
    from terraloom.plans import training_core

    rows = []
    for k in range(80):
        high = k >= 40
        altitude = 100.0 + k % 3 + (400 if high != (k in (10, 50)) else 0)
        text = f"2024-05-01 {20 if high else 8}:{k % 40:02d}:00".replace(" 8", " 08")
        rows.append((k, 1, f"{k:03d}", 1, dt.datetime(2024, 5, 2, 3), (altitude, float(k % 7), 1.0 + k % 5 / 10, text, None)))
    info = "capture_info struct<altitude: double, yaw: double, accuracy_xy: double, timestamp: string, datestamp: string>"
    spark.createDataFrame(rows, f"node_id bigint, batch int, path string, site_id int, ingested_at timestamp, {info}").write.parquet(f"{tmp_path}/images.parquet")
    spark.createDataFrame([(1, "x", "UTC", 0.0)], "site_id int, name string, tz string, ground_m double").write.parquet(f"{tmp_path}/sites.parquet")
    fences = {(r.node_id, r.hour, r.field) for r in training_core.p5_fences(spark, str(tmp_path)).collect()}
    assert fences == {(10, 8, "altitude"), (50, 20, "altitude")}
    method = {(r.node_id, r.field) for r in training_core.p5_method(spark, str(tmp_path)).collect()}
    assert {(10, "altitude"), (50, "altitude")} <= method
