from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from terraloom.operators import timestamps as t


def micros(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


def one(text, date=None, zone="Europe/Berlin"):
    v = int(t.to_utc_micros([text], [date], [zone])[0])
    return None if v == t.INVALID else v


@pytest.mark.parametrize(
    "text, date, zone, want",
    [
        ("2019:01:03 13:55:10", None, "Asia/Kolkata", micros(2019, 1, 3, 8, 25, 10)),
        ("2019:01:11 10:14:25489", None, "UTC", micros(2019, 1, 11, 10, 14, 25) + 489_000),
        ("30.01.2019 09:14:10", "", "Europe/Oslo", micros(2019, 1, 30, 8, 14, 10)),
        ("Jan 25, 2019 4:16:22 PM", None, "Europe/Oslo", micros(2019, 1, 25, 15, 16, 22)),
        ("January 25, 2019 12:00:00 AM", None, "Europe/Oslo", micros(2019, 1, 24, 23, 0, 0)),
        ("2019-01-15 20:41:30 UTC", None, "America/New_York", micros(2019, 1, 15, 20, 41, 30)),
        ("2019:01:11 10:17:32 AEDT", None, "Australia/Sydney", micros(2019, 1, 10, 23, 17, 32)),
        ("Thu, 07 Feb 2019 05:26:38 GMT", None, "Africa/Johannesburg", micros(2019, 2, 7, 5, 26, 38)),
        ("Wed, 27 Feb 2019 13:54:31 +0530", None, "Europe/London", micros(2019, 2, 27, 8, 24, 31)),
        ("2019-01-07T10:01:47+05:30", None, "Europe/London", micros(2019, 1, 7, 4, 31, 47)),
        ("2019-03-17T08:37:34-06", None, "America/Denver", micros(2019, 3, 17, 14, 37, 34)),
        ("20190203T233744Z", None, "Australia/Lord_Howe", micros(2019, 2, 3, 23, 37, 44)),
        ("20190125161719", None, "Europe/Oslo", micros(2019, 1, 25, 15, 17, 19)),
        ("2019-029T10:34:57Z", None, "Europe/Oslo", micros(2019, 1, 29, 10, 34, 57)),
        ("2019:02:24 14 54 18.32", None, "America/New_York", micros(2019, 2, 24, 14, 54, 18) + 320_000),
        ("1546476924.841", None, "UTC", 1_546_476_924_841_000),
        ("1546476924", None, "UTC", 1_546_476_924_000_000),
        ("1546476830673", None, "UTC", 1_546_476_830_673_000),
        ("1546476837234254", None, "UTC", 1_546_476_837_234_254),
        ("2019-02-14 11:57:01[Australia/Sydney]", None, "Europe/Oslo", micros(2019, 2, 14, 0, 57, 1)),
        ("9 05 7.5", "2019/02/03", "Asia/Tokyo", micros(2019, 2, 3, 9, 5, 7) + 500_000),
        ("09:34:46", "3 Feb 2019", "Europe/Berlin", micros(2019, 2, 3, 8, 34, 46)),
        ("7:50:11 pm", "20190306", "UTC", micros(2019, 3, 6, 19, 50, 11)),
        ("14:03:57+02:00", "27.02.2019", "Asia/Tokyo", micros(2019, 2, 27, 12, 3, 57)),
        ("2024-10-27 02:30:00", None, "Europe/Berlin", micros(2024, 10, 27, 0, 30, 0)),  # twice: the earlier
        ("2024-03-31 02:30:00", None, "Europe/Berlin", micros(2024, 3, 31, 1, 30, 0)),  # skipped: offset before
        ("2024-04-07 01:45:00", None, "Australia/Lord_Howe", micros(2024, 4, 6, 14, 45, 0)),
    ],
)
def test_formats(text, date, zone, want):
    assert one(text, date, zone) == want


@pytest.mark.parametrize("text, date", [(None, None), ("", ""), ("0000:00:00 00:00:00", None), ("    :  :     :  :  ", None), ("2021-13-04T08:00:00Z", None), ("2021-02-29 08:00:00", None), ("11:42:07", None), ("unknown", "2020-01-01"), ("2019-01-01 24:00:00", None), ("2019-01-01 13:00:00 PM", None), ("2019-01-01", None), ("x" * 100_000, None), ("2 14 9.5", "")])
def test_no_instant(text, date):
    assert one(text, date) is None


def test_unknown_zone_gives_none_unless_the_text_has_its_own():
    assert one("2019-01-01 10:00:00", None, None) is None
    assert one("2019-01-01T10:00:00Z", None, None) == micros(2019, 1, 1, 10)


def test_masks_compile_once():
    a, b = (t.compile_mask("9999:99:99 99:99:99") for _ in range(2))
    assert a is b


def test_table(spark):
    rows = [(1, "2019-01-01T10:00:00Z", None, "UTC", 7), (1, "2019-01-01T10:00:00Z", None, "UTC", 8), (2, None, None, None, 1), (None, "2019-01-01T10:00:00Z", None, "UTC", 1)]
    df = spark.createDataFrame(rows, "id bigint, text string, date string, zone string, utc_micros int")
    out = t.normalise_timestamps(df, "id", F.col("text"), F.col("date"), F.col("zone"))
    assert [tuple(r) for r in out.collect()] == [(1, micros(2019, 1, 1, 10))]
    assert t.normalise_timestamps(df.limit(0), "id", F.col("text"), F.col("date"), F.col("zone")).count() == 0


def test_versions_are_known():
    assert t.zone_table("Europe/Berlin").version == t.tz_version()
    assert t.zone_table("No/Where") is None
