import datetime as dt

import pytest

from mentia.operators.instants import mixtures, normalize_instants

ZONES = [("ny", "America/New_York", "mdy"), ("de", "Europe/Berlin", "dmy"), ("none", None, None), (None, "UTC", "dmy")]
CASES = [
    ("2024-03-28T04:13:22.693Z", None, "own", "2024-03-28T04:13:22.693"),
    (" 2024-03-28T04:13:22.693Z", None, "resolved", "2024-03-28T04:13:22.693"),
    ("2024-10-11T02:37:59.068359397z", None, "resolved", "2024-10-11T02:37:59.068359"),
    ("Thu, 18 Dec 2025 14:09:55 EDT", "de", "resolved", "2025-12-18T18:09:55"),
    ("January 28, 2025 at 6:56 pm MST", None, "resolved", "2025-01-29T01:56:00"),
    ("26. Oktober 2025, 03:41 Uhr", "de", "resolved", "2025-10-26T02:41:00"),
    ("26.10.2025 02:30", "de", "resolved", "2025-10-26T00:30:00"),  # twice: the earlier
    ("30.03.2025 02:30", "de", "resolved", "2025-03-30T01:30:00"),  # skipped: the offset before
    ("08/27/2024 12:47 AM", "ny", "resolved", "2024-08-27T04:47:00"),
    ("27/08/2024 00:47", "ny", "invalid", None),
    ("ngày 15 tháng 7 năm 2025, 01:47", "de", "resolved", "2025-07-14T23:47:00"),
    ("15 de septiembre de 2024, 16:49", "de", "resolved", "2024-09-15T14:49:00"),
    ("26 février 2024 à 12h04", "de", "resolved", "2024-02-26T11:04:00"),
    ("20240330181217", "ny", "resolved", "2024-03-30T22:12:17"),
    ("20240215T013000+0545", None, "resolved", "2024-02-14T19:45:00"),
    ("2024-02-26T00:48−05:00", None, "resolved", "2024-02-26T05:48:00"),
    ("2025-08-28T16:18:16+02:00[Europe/Berlin]", None, "resolved", "2025-08-28T14:18:16"),
    ("1705731575402184", None, "resolved", "2024-01-20T06:19:35.402184"),
    ("1709470765.354", None, "resolved", "2024-03-03T12:59:25.354"),
    ("2024-10-24", "ny", "resolved", "2024-10-24T04:00:00"),
    ("2024-10-24", "none", "no_zone", None),
    ("2024-10-24", None, "no_zone", None),
    ("2025-06-31 12:00:00+02:00", None, "invalid", None),
    ("2025-13-04T08:00:00Z", None, "invalid", None),
    ("2024-11-05T27:10:00Z", None, "invalid", None),
    ("0000-00-00 00:00:00", "de", "invalid", None),
    ("soon", "de", "invalid", None),
    ("  ", "de", "missing", None),
    ("", "de", "missing", None),
    (None, "de", "missing", None),
    ("x" * 100_000, "de", "invalid", None),
]


def test_cases(spark):
    rows = [(i, t, h, "clash") for i, (t, h, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, published_at string, feed_host string, status string")
    zones = spark.createDataFrame(ZONES, "feed_host string, zone_name string, numeric_order string")
    got = {r.id: r for r in normalize_instants(df, zones).collect()}
    assert len(got) == len(CASES)
    for i, (text, host, status, expected) in enumerate(CASES):
        us = None if expected is None else int(dt.datetime.fromisoformat(expected + "+00:00").timestamp() * 1e6 + 0.5)
        assert (got[i].status, got[i].utc_us) == (status, us), (text, host)


def test_mixture_decides_or_leaves_ambiguous(spark):
    zones = spark.createDataFrame([("mix", "UTC", None), ("few", "UTC", None)], "feed_host string, zone_name string, numeric_order string")
    texts = [("mix", f"{d:02}/{m:02}/2024 10:00") for d in range(13, 29) for m in range(1, 8)] + [("mix", "03/04/2024 10:00"), ("few", "03/04/2024 10:00"), ("few", "03/04/2024 10:00")]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(texts)], "id int, feed_host string, published_at string")
    got = {r.id: r for r in normalize_instants(df, zones).collect()}
    n = len(texts)
    assert (got[n - 3].status, got[n - 3].interpretation) == ("inferred", "dmy")
    assert (got[n - 2].status, got[n - 2].utc_us, got[n - 1].status) == ("ambiguous", None, "ambiguous")


def test_empty(spark):
    df = spark.createDataFrame([], "id int, feed_host string, published_at string")
    zones = spark.createDataFrame([], "feed_host string, zone_name string, numeric_order string")
    assert normalize_instants(df, zones).count() == 0
    assert mixtures(spark.createDataFrame([], "source string, like_dmy double, like_mdy double")).count() == 0


@pytest.mark.parametrize("like", [(1.0, 0.0), (0.0, 1.0)])
def test_mixture_of_one_kind(spark, like):
    votes = spark.createDataFrame([("s", *like)] * 50, "source string, like_dmy double, like_mdy double")
    assert abs(mixtures(votes).first().p_dmy - like[0]) < 0.02
