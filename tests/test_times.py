"""Instants: every writing, every refusal, the clock changes, and dirty rows."""

from pyspark.sql import functions as F

from strandloom.functions.instants import EpochRange, days_of, instant, observed_ms
from strandloom.functions.rfc3339 import strict_ms
from strandloom.operators.times import event_times

CASES = [
    ("2025-03-06T17:20:43", "Europe/Berlin", "DMY", 1741278043000), ("2025-03-06 12:14:32 America/New_York", "UTC", None, 1741281272000),
    ("2025-03-06 12:14:32 UTC", "Europe/Berlin", None, 1741263272000), ("16/3/2025 6:21:27 AM", "UTC", "DMY", 1742106087000), ("3/16/2025 12:21:27 AM", "UTC", "MDY", 1742084487000),
    ("09.03.2025 18:13", "UTC", "MDY", 1741543980000), ("20250303T180021+0545", None, None, 1741004121000), ("2025-068T22:36:01Z", None, None, 1741559761000), ("1742153094.1655", None, None, 1742153094166),
    ("1741850543047549143", None, None, 1741850543048), ("2025-03-04T07:35:34.9995Z", None, None, 1741073735000), ("Thu, 07 Aug 2025 06:41:10 +0900", None, None, 1754516470000),
    ("Aug 20, 2025 7:44:38 PM -0800", None, None, 1755747878000), ("2025-04-25 00:59:26 CEST", "UTC", None, 1745535566000), ("2025-03-30 02:30:42 Europe/Berlin", None, None, 1743298242000),
    ("2025-10-26 02:30:00 Europe/Berlin", None, None, 1761438600000), ("2025-03-06T17:20:43", None, None, None), ("2025-02-30T00:00:00Z", None, None, None), ("2025-01-01T24:00:00Z", None, None, None),
    ("2025-01-01T00:00:60Z", None, None, None), ("2025-01-01", "UTC", None, None), ("last Sun", "UTC", None, None), ("", "UTC", None, None), (None, "UTC", None, None), ("2025-01-01 10:00 Foo/Bar", "UTC", None, None),
    ("12345", None, None, None), ("9" * 40, None, None, None), ("x" * 5000, "UTC", None, None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, v string, z string, o string, want bigint")
    got = df.select("v", "want", instant(F.col("v"), zone=F.col("z"), date_order=F.col("o"), numbers=EpochRange(2025, 2025)).alias("got")).collect()
    assert [(r["v"], r["got"]) for r in got] == [(r["v"], r["want"]) for r in got]


def test_units_and_days(spark):
    df = spark.createDataFrame([(1739285687,), (1739978679382,), (1739978679382500,), (1742220646800499999,), (None,)], "observed_at bigint")
    assert [r[0] for r in df.select(observed_ms()).collect()] == [1739285687000, 1739978679382, 1739978679383, 1742220646800, None]
    assert days_of(1970, 1, 1) == 0 and days_of(2000, 3, 1) == 11017


def test_strict_rfc3339(spark):
    cases = [("2026-07-01T09:30:00+10:00", 1782862200000), ("2000-02-29T00:00:00Z", 951782400000), ("2100-02-29T00:00:00Z", None), ("2026-07-01T00:00:60Z", None), ("2026-07-01T09:30:00", None), ("2026-07-01T09:30:00Z\n", None), ("0099-01-01T00:00:00Z", 915148800000)]
    df = spark.createDataFrame(cases, "v string, want bigint")
    assert all(r["got"] == r["want"] for r in df.select("want", strict_ms(F.col("v")).alias("got")).collect())


def test_event_times_of_dirty_rows(spark):
    raws = [None, "", "{", '{"a":1} x', "[1]", "{}", '{"occurredAt":null}', '{"occurredAt":1742153094}', '{"occurredAt":"2025-03-06T17:20:43.000Z","source":{"system":7}}', '{"occurredAt":"2025-03-06 17:20:43","source":{"system":"s"}}']
    raw = spark.createDataFrame([(i, r, "extra") for i, r in enumerate(raws)], "arrival bigint, raw string, utc_ms string")
    systems = spark.createDataFrame([("s", "Asia/Tokyo", "DMY"), (None, "UTC", "DMY")], "system_name string, zone_id string, date_order string")
    got = {r["arrival"]: (r["state"], r["utc_ms"]) for r in event_times(raw, systems, EpochRange(2025, 2025)).collect()}
    assert got == {5: ("unresolved", None), 6: ("unresolved", None), 7: ("normalised", 1742153094000), 8: ("canonical", 1741281643000), 9: ("normalised", 1741249243000)}
    assert event_times(raw.limit(0), systems, EpochRange(2025, 2025)).count() == 0
