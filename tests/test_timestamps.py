"""Moments and windows, with the policies for clocks that change."""

import datetime as dt

from pyspark.sql import functions as F

from claimloom.operators.timestamps import fact_windows, with_moments

FACTS = "id string, doc_id long, extracted_at timestamp, period struct<raw:string,kind:string>, period_start string, period_end string"
MOMENTS = [
    ("2024-03-31", "DMY", "Asia/Kolkata", "2024-03-30 18:30:00"),
    ("03/04/2020", "DMY", "UTC", "2020-04-03 00:00:00"),
    ("03/04/2020", "MDY", "UTC", "2020-03-04 00:00:00"),
    ("2020/04/03", "MDY", "UTC", "2020-04-03 00:00:00"),
    ("20240331", "DMY", "UTC", "2024-03-31 00:00:00"),
    ("44926", "DMY", "UTC", "2022-12-31 00:00:00"),
    ("1719680400", "DMY", "Asia/Tokyo", "2024-06-29 17:00:00"),
    ("1585775426340", "DMY", "Asia/Tokyo", "2020-04-01 21:10:26.340000"),
    ("1551333316.176", "DMY", "UTC", "2019-02-28 05:55:16.176000"),
    ("2020-W53-4", "DMY", "UTC", "2020-12-31 00:00:00"),
    ("2021-W53-1", "DMY", "UTC", None),
    ("2024-366", "DMY", "UTC", "2024-12-31 00:00:00"),
    ("2023-366", "DMY", "UTC", None),
    ("20200308T070500Z", "DMY", "Asia/Tokyo", "2020-03-08 07:05:00"),
    ("Sun, 30 Jun 2024 11:51:10 +0530", "DMY", "UTC", "2024-06-30 06:21:10"),
    ("2024-04-01 05:00 IST", "DMY", "UTC", "2024-03-31 23:30:00"),
    ("2024-01-01 08:00:05 CST", "DMY", "Asia/Shanghai", "2024-01-01 14:00:05"),
    ("2022-07-01 12:00 BST", "DMY", "UTC", "2022-07-01 11:00:00"),
    ("2021-10-01 11:00 +07", "DMY", "UTC", "2021-10-01 04:00:00"),
    ("2023-06-30T00:00[Asia/Kolkata]", "DMY", "UTC", "2023-06-29 18:30:00"),
    ("30-JUN-24", "DMY", "UTC", "2024-06-30 00:00:00"),
    ("1st Jan. 2021", "DMY", "UTC", "2021-01-01 00:00:00"),
    ("March 31, 2023 3:46 AM", "DMY", "UTC", "2023-03-31 03:46:00"),
    ("12-Mar-2021 12:00 AM", "DMY", "UTC", "2021-03-12 00:00:00"),
    ("31 de diciembre de 2025", "DMY", "UTC", "2025-12-31 00:00:00"),
    ("३१ मार्च २०१८", "DMY", "UTC", "2018-03-31 00:00:00"),
    ("２０１９年４月１日", "DMY", "UTC", "2019-04-01 00:00:00"),
    ("31 декабря 2025", "DMY", "UTC", "2025-12-31 00:00:00"),
    # Twice on the clock: the first. Skipped: moved on by the gap.
    ("2023-11-05 01:30", "MDY", "America/New_York", "2023-11-05 05:30:00"),
    ("2023-03-12 02:30", "MDY", "America/New_York", "2023-03-12 07:30:00"),
    ("2023-02-30", "DMY", "UTC", None),
    ("25:00", "DMY", "UTC", None),
    ("2023-01-01 24:30", "DMY", "UTC", None),
    ("soon", "DMY", "UTC", None),
    ("", "DMY", "UTC", None),
    (None, "DMY", "UTC", None),
    ("2024-01-01", "DMY", None, None),
    ("2024-01-01 00:00Z", "DMY", None, "2024-01-01 00:00:00"),
    ("x" * 5000, "DMY", "UTC", None),
]


def test_moments(spark):
    df = with_moments(spark.createDataFrame([m[:3] for m in MOMENTS], "t string, o string, z string"), ["t"], "o", "z")
    got = df.select("t", F.timestamp_millis("t_ms").cast("string").alias("at")).collect()
    for m, r in zip(MOMENTS, got, strict=True):
        want = m[3] and dt.datetime.fromisoformat(m[3])
        assert (r["at"] and dt.datetime.fromisoformat(r["at"])) == want, m[0]


def window(spark, raw, fy=3, start=None, end=None, rows=None):
    at = dt.datetime(2024, 1, 1)
    facts = spark.createDataFrame(rows if rows is not None else [("f", 1, at, (raw, None), start, end)], FACTS)
    docs = spark.createDataFrame([(1, "s", "extra")], "doc_id long, source string, home_tz string")
    sources = spark.createDataFrame([("s", "UTC", "DMY", fy)], "source string, home_tz string, date_order string, fy_end_month int")
    got = fact_windows(facts, docs, sources).select("id", F.timestamp_millis("start_utc_ms").cast("date").alias("a"), F.timestamp_millis("end_utc_ms").cast("date").alias("b")).collect()
    return [(r.id, str(r.a), str(r.b)) for r in got]


def test_windows(spark):
    cases = {
        "FY24": ("2023-04-01", "2024-03-31"), "2021–22": ("2021-04-01", "2022-03-31"), "2022-02": ("2022-02-01", "2022-02-28"), "Q1 2017": ("2017-01-01", "2017-03-31"), "Q4 2019-20": ("2020-01-01", "2020-03-31"), "3QFY18": ("2017-10-01", "2017-12-31"),
        "H2:2016-17": ("2016-10-01", "2017-03-31"), "year ended 30 June 2025": ("2024-07-01", "2025-06-30"), "twelve months to 29 Feb 2024": ("2023-03-01", "2024-02-29"), "as on 2020-05-31": ("2020-05-31", "2020-05-31"), "4. Quartal 2020": ("2020-10-01", "2020-12-31"), "2019年第4季度": ("2019-10-01", "2019-12-31"), "मई 2024": ("2024-05-01", "2024-05-31"),
    }
    at = dt.datetime(2024, 1, 1)
    rows = [(raw, 1, at, (raw, None), "-", " ") for raw in cases] + [(v, 1, at, (v, None), "n/a", None) for v in ("last year", "various", "n.a.", "")]
    assert {r[0]: r[1:] for r in window(spark, None, rows=rows)} == cases


def test_stated_windows_win_and_late_rows_count(spark):
    assert window(spark, "FY24", start="2020-01-01", end="2020-01-31") == [("f", "2020-01-01", "2020-01-31")]
    assert window(spark, "FY24", start="2020-01-01", end=None) == []
    t = dt.datetime
    rows = [("f", 1, t(2024, 1, 1), None, "2020-01-01", "2020-01-31"), ("f", 1, t(2024, 2, 1), None, "2021-01-01", "2021-01-31"), (None, 1, t(2024, 1, 1), None, "2020-01-01", "2020-01-31"), ("g", None, None, None, "2020-01-01", "2020-01-31")]
    assert window(spark, None, rows=rows) == [("f", "2021-01-01", "2021-01-31")]
    assert window(spark, None, rows=[]) == []
