from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from knowgrid.operators import timestamps as T

SITES = [("CHI", "America/Chicago", False), ("LON", "Europe/London", True), ("KTM", "Asia/Kathmandu", True), ("OPS", "UTC", False)]


def us(y, mo, d, h=0, mi=0, s=0, micro=0, zone="UTC", hours=None):
    t = datetime(y, mo, d, h, mi, s, micro, tzinfo=timezone(timedelta(hours=hours)) if hours is not None else ZoneInfo(zone))
    return int(t.timestamp() * 1_000_000) // 1 if micro == 0 else int(t.replace(microsecond=0).timestamp()) * 1_000_000 + micro


CASES = [
    ("2024-02-18T04:32:08Z", "CHI", us(2024, 2, 18, 4, 32, 8)),
    ("2024-02-18T04:32:08.123456789Z", "CHI", us(2024, 2, 18, 4, 32, 8, 123456)),
    ("20241014T143404Z", "CHI", us(2024, 10, 14, 14, 34, 4)),
    ("2024-02-18 04:32:08", "CHI", us(2024, 2, 18, 4, 32, 8, zone="America/Chicago")),
    ("2023-04-22T06:25:12+09", "CHI", us(2023, 4, 22, 6, 25, 12, hours=9)),
    ("2023-04-22T06:25:12.500-0330", "CHI", us(2023, 4, 22, 6, 25, 12, 500000, hours=-3.5)),
    ("2024-11-10 13:29 -05:00", "KTM", us(2024, 11, 10, 13, 29, hours=-5)),
    ("Thu, 25 Jun 2026 20:02:14 -0400", "CHI", us(2026, 6, 25, 20, 2, 14, hours=-4)),
    ("2025-09-21 20:33:28 CEST", "LON", us(2025, 9, 21, 20, 33, 28, hours=2)),
    ("Jan 27, 2025 3:16 AM PST", "CHI", us(2025, 1, 27, 3, 16, hours=-8)),
    ("December 17, 2024 at 2:00 p.m.", "LON", us(2024, 12, 17, 14, 0, zone="Europe/London")),
    ("June 3, 2023 at 12:15am", "KTM", us(2023, 6, 3, 0, 15, zone="Asia/Kathmandu")),
    ("4. December 2023", "LON", us(2023, 12, 4, zone="Europe/London")),
    ("Sun Mar 12 2023", "CHI", us(2023, 3, 12, zone="America/Chicago")),
    ("27-Oct-2025 07:39", "OPS", us(2025, 10, 27, 7, 39)),
    ("8/10/2025 12:17 AM", "OPS", us(2025, 8, 10, 0, 17)),
    ("03/09/2025 15:58", "LON", us(2025, 9, 3, 15, 58, zone="Europe/London")),
    ("03/09/2025", "CHI", us(2025, 3, 9, zone="America/Chicago")),
    ("12.04.2024 00:18", "KTM", us(2024, 4, 12, 0, 18, zone="Asia/Kathmandu")),
    ("20260526", "KTM", us(2026, 5, 26, zone="Asia/Kathmandu")),
    ("1716889514", "CHI", 1716889514000000),
    ("1673657851.006431", "CHI", 1673657851006431),
    ("1715879812101", "CHI", 1715879812101000),
    ("1772860368406970", "CHI", 1772860368406970),
    # A skipped wall time moves on by the gap, a repeated one is the first of the two.
    ("2024-03-10 02:30:00", "CHI", us(2024, 3, 10, 8, 30)),
    ("2024-11-03 01:30:00", "CHI", us(2024, 11, 3, 6, 30)),
    ("2024-02-29", "OPS", us(2024, 2, 29)),
    ("2023-02-29", "OPS", None),
    ("2024-13-05 10:00:00", "CHI", None),
    ("31/31/2024", "LON", None),
    ("2024-05-05 25:00", "CHI", None),
    ("TBD", "CHI", None),
    ("yesterday", "CHI", None),
    ("-", "CHI", None),
    ("", "CHI", None),
    (None, "CHI", None),
    ("x" * 100_000, "CHI", None),
]


@pytest.fixture(scope="module")
def result(spark):
    rows = [(i, v, s, 0) for i, (v, s, _) in enumerate(CASES)]
    values = spark.createDataFrame(rows, "row_id long, value string, site string, ingested_us long").withColumn("_p", F.lit("clash")).withColumn("zone", F.lit("clash"))
    sites = spark.createDataFrame(SITES, "site string, time_zone string, day_first boolean")
    return {r.row_id: r.utc_us for r in T.normalise(values, sites, ("row_id",)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_formats(result, i):
    assert result[i] == CASES[i][2], CASES[i]


def test_unknown_site_gets_the_history_that_fits(spark):
    zone = ZoneInfo("Asia/Kathmandu")
    rows = []
    for k in range(60):
        t = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=5 * k, hours=k % 24)
        rows.append((k, t.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S"), None if k % 2 else "LAB", int(t.timestamp() * 1e6) + 600_000_000, int(t.timestamp() * 1e6)))
    values = spark.createDataFrame(rows, "row_id long, value string, site string, ingested_us long, want long")
    sites = spark.createDataFrame(SITES, "site string, time_zone string, day_first boolean")
    got = T.normalise(values, sites, ("row_id", "want")).collect()
    assert len(got) == 60 and all(r.utc_us == r.want for r in got)


def test_empty_tables(spark):
    values = spark.createDataFrame([], "row_id long, value string, site string, ingested_us long")
    sites = spark.createDataFrame([], "site string, time_zone string, day_first boolean")
    assert T.normalise(values, sites, ("row_id",)).count() == 0
