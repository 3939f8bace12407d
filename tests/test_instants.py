"""Texts to instants: spellings, zones, clock changes, nonsense."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions.instants import with_instant, with_session_date
from tidemark.operators.normalise_times import instants, spelled_otherwise

FEEDS = [("utc", "UTC", "YMD"), ("ny", "America/New_York", "MDY"), ("ldn", "Europe/London", "DMY"), ("tyo", "Asia/Tokyo", "YMD"), ("dmy", "UTC", "DMY"), ("tor", "America/Toronto", "MDY"), ("waw", "Europe/Warsaw", "DMY"), ("bad", "Mars/Olympus", "YMD")]


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


AT = us(2025, 9, 26, 12, 17, 8)
CASES = [
    ("2025-09-26T12:17:08.256789+00:00", "utc", AT + 256_789),
    ("2025-09-26T12:17:08Z", "ny", AT),
    ("2025-09-26T12:17Z", "ny", AT - 8_000_000),
    ("2025-09-26T12:17:08.256789999Z", "ny", AT + 256_789),
    ("  \t2025-09-26T12:17:08Z\n", "ny", AT),
    (" 2025-09-26T12:17:08Z﻿", "ny", AT),
    ("2025-09-26 08:17:08", "ny", AT),
    ("2025-09-26 08:17:08,5", "ny", AT + 500_000),
    ("2025-09-26 13:17:08", "ldn", AT),
    ("2025-09-26 21:17:08.000", "tyo", AT),
    ("2025-09-26T08:17:08-04:00[America/New_York]", "tyo", AT),
    ("2025-09-26T08:17:08[America/New_York]", "tyo", AT),
    ("2025-09-26 08:17:08.000-0400", "tyo", AT),
    ("2025-09-26 08:17:08 EDT", "ny", AT),
    ("2025-09-26 07:17:08 EST", "ny", AT),
    ("2025-09-26 13:17:08 BST", "ldn", AT),
    ("2025-09-26 21:17:08 JST", "tyo", AT),
    ("2025-09-26 12:17:08 UTC", "ny", AT),
    ("2025-09-26 08:17:08 EDT", "tyo", None),  # not an abbreviation of this zone
    ("09/26/2025 08:17:08", "ny", AT),
    ("26/09/2025 13:17:08.000", "ldn", AT),
    ("2025/09/26 12:17:08", "dmy", AT),
    ("2025/09/26 12:17:08 PM", "utc", AT),
    ("26/09/2025 12:17:08 PM", "dmy", AT),
    ("26/09/2025 12:17:08 AM", "dmy", AT - 12 * 3_600_000_000),
    ("26-Sep-2025 12:17:08", "utc", AT),
    ("Fri, 26 Sep 2025 08:17:08 -0400", "ldn", AT),
    ("September 26, 2025 12:17:08", "utc", AT),
    ("20250926T121708Z", "ny", AT),
    ("20250926T121708.5Z", "ny", AT + 500_000),
    ("1758889028", "ny", AT),
    ("1758889028.25", "ny", AT + 250_000),
    ("1758889028256", "ny", AT + 256_000),
    ("1758889028256789", "ny", AT + 256_789),
    ("1758889028256789123", "ny", AT + 256_789),
    ("2025-09-26 08:17:08 EDT", "tor", AT),  # abbreviations come from the zone's own rules
    ("2025-09-26 14:17:08 CEST", "waw", AT),
    ("2025-09-26T12:17:08+18:00", "utc", AT - 18 * 3_600_000_000),
    # zones and offsets that don't exist name no instant, and end no job
    ("2025-09-26T12:17:08[Foo/Bar]", "utc", None),
    ("2025-09-26T12:17:08[GMT+99]", "utc", None),
    ("2025-09-26T12:17:08+99:99", "utc", None),
    ("2025-09-26T12:17:08+18:30", "utc", None),
    ("2025-09-26T12:17:08+05:60", "utc", None),
    ("2025-09-26 12:17:08", "bad", None),
    ("2025-09-26 12:17:08 XYZ", "bad", None),
    ("2025-09-26 12:17:08Z", "bad", AT),
    # repeated and skipped hours
    ("2025-11-02 01:30:00 EDT", "ny", us(2025, 11, 2, 5, 30)),
    ("2025-11-02 01:30:00 EST", "ny", us(2025, 11, 2, 6, 30)),
    ("2025-11-02 01:30:00", "ny", us(2025, 11, 2, 5, 30)),
    ("2025-03-09 02:30:00", "ny", us(2025, 3, 9, 7, 30)),
    # nonsense
    *[(t, "utc", None) for t in (None, "", "  ", "N/A", "pending", "--", "2025-02-30 10:00:00", "2025-13-41T99:00:00Z", "2025-09-26 25:00:00", "2025-09-26", "13/13/2025 10:00:00", "2025/09/26 13:00:00 PM", "12345", "x" * 100_000)],
    ("2025-09-26 08:17:08", "unknown", None),
    ("2025-09-26T12:17:08Z", None, AT),
]


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame(FEEDS + FEEDS[:1], "feed string, clock_zone string, date_order string")


def test_spellings(spark, feeds):
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(CASES)], "i int, ts string, feed string")
    got = {r["i"]: r["us"] for r in instants(df, feeds, "ts", "us").collect()}
    assert {i: w for i, (_, _, w) in enumerate(CASES)} == got


def test_policies(spark):
    df = spark.createDataFrame([("2025-11-02 01:30:00",), ("2025-03-09 02:30:00",)], "ts string").withColumns({"z": F.lit("America/New_York"), "o": F.lit("MDY")})
    one = lambda **p: [r["us"] for r in with_instant(df, "ts", "us", "z", "o", **p).collect()]
    assert one(ambiguous="later")[0] == us(2025, 11, 2, 6, 30)
    assert one(ambiguous="null", nonexistent="null") == [None, None]
    with pytest.raises(ValueError):
        one(ambiguous="guess")


def test_session_dates(spark, feeds):
    cases = [
        ("2023-07-19", "utc", "2023-07-19"), ("2023/07/19", "dmy", "2023-07-19"), ("23/07/19", "utc", "2023-07-19"), ("07/19/23", "ny", "2023-07-19"),
        ("19/07/2023", "ldn", "2023-07-19"), ("20230719", "ny", "2023-07-19"), ("19-Jul-2023", "utc", "2023-07-19"), ("Jul 4, 2024", "utc", "2024-07-04"),
        ("2023-07-19 00:00:00", "tyo", "2023-07-19"), ("1689739200", "tyo", "2023-07-19"), ("1689739200000", "ldn", "2023-07-19"),
        ("2023-07-20T05:00:00+09:00", "utc", "2023-07-19"), ("2023-07-19T00:00:00-04:00", "utc", "2023-07-19"), ("2023-07-19T03:59:59Z", "utc", "2023-07-18"),
        ("2023-02-29", "utc", None), ("unknown", "utc", None), (None, "utc", None), ("", "utc", None),
    ]
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(cases)], "i int, ts string, feed string")
    from tidemark.operators.normalise_times import session_dates

    got = {r["i"]: r["d"] and str(r["d"]) for r in session_dates(df, feeds, "ts", "d").collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}


def test_independent_of_session_zone(spark, feeds):
    df = spark.createDataFrame([("2025-09-26 08:17:08", "ny"), ("2025-09-26T12:17:08.000000+00:00", "ny")], "ts string, feed string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert [r["us"] for r in instants(df, feeds, "ts", "us").collect()] == [AT, AT]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_only_other_spellings_and_clashing_columns(spark, feeds):
    df = spark.createDataFrame(
        [(1, "2025-09-26T12:17:08.000000+00:00", "utc", "x", 1), (2, " 2025-09-26T12:17:08.000000+00:00", "utc", "x", 1), (2, " 2025-09-26T12:17:08.000000+00:00", "utc", "x", 1), (3, None, None, None, None)],
        "tick_id bigint, ts string, feed string, clock_zone string, utc_us int",
    )
    got = spelled_otherwise([("ticks", df, "tick_id", "ts", "instant"), ("none", df.limit(0), "tick_id", "ts", "instant")], feeds).collect()
    assert [tuple(r) for r in got] == [("ticks", 2, AT)] * 2
    assert instants(df, feeds, "ts", "utc_us").columns.count("utc_us") == 1
