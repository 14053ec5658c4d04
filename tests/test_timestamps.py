from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from lexmill.operators import timestamps as T


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2025-12-31T05:30:00+05:30", None, False, us(2025, 12, 31)),
    ("20231116T041448Z", None, False, us(2023, 11, 16, 4, 14, 48)),
    ("1671945566", None, False, 1671945566000000),
    ("1761503945859", None, False, 1761503945859000),
    ("2023-05-19 16:00:20.099438748", "UTC", False, us(2023, 5, 19, 16, 0, 20) + 99438),
    ("31-02-2024", None, False, None),
    ("2024-13-05T10:00:00Z", None, False, None),
    ("29-02-2024", "UTC", False, us(2024, 2, 29)),
    ("01/02/2024", "UTC", True, us(2024, 1, 2)),
    ("01/02/2024", "UTC", False, us(2024, 2, 1)),
    ("01.02.2024", "UTC", True, us(2024, 2, 1)),
    (" \t9 May, 2020 ", "UTC", False, us(2020, 5, 9)),
    ("09/04/2025 12:05 AM", "UTC", False, us(2025, 4, 9, 0, 5)),
    ("09/04/2025 12:05 PM", "UTC", False, us(2025, 4, 9, 12, 5)),
    ("Mon, 15 Oct 2018 17:24:08 -0400", None, False, us(2018, 10, 15, 21, 24, 8)),
    ("2021-07-10T04:50:58+05:30[Asia/Kolkata]", None, False, us(2021, 7, 9, 23, 20, 58)),
    ("2021-07-10T04:50:58[America/New_York]", None, False, us(2021, 7, 10, 8, 50, 58)),
    ("01-11-2020 01:30:00", "America/New_York", False, us(2020, 11, 1, 5, 30)),  # twice: the earlier
    ("01-11-2020 01:30:00 EST", "America/New_York", False, us(2020, 11, 1, 6, 30)),
    ("14-03-2021 02:30:00", "America/New_York", False, us(2021, 3, 14, 7, 30)),  # skipped: offset before the change
    ("28-04-2023 18:55:51 IST", None, False, us(2023, 4, 28, 13, 25, 51)),
    ("19-05-2020", "Mars/Base", False, us(2020, 5, 18, 18, 30)),  # unknown zone: none
    ("1:00", None, False, None),
    ("24-05-2020 24:00:00", "UTC", False, None),
    ("to be notified", None, False, None),
    ("", None, False, None),
    ("-", None, False, None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [("f", str(i), "x", v, z, m) for i, (v, z, m, _) in enumerate(CASES)]
    rows += [("f", "n", "x", None, None, False), ("f", None, "x", "2020-01-01", None, False), *rows[:3]]
    df = spark.createDataFrame(rows, "feed string, row_key string, field string, value string, zone string, month_first boolean")
    out = T.normalise_timestamps(df).collect()
    assert len(out) == len(set(out))
    return {r["row_key"]: r["epoch_us"] for r in out}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(i, found):
    assert found.get(str(i)) == CASES[i][3]


def test_zone_is_estimated_from_stated_instants(spark):
    rows = []
    for d in range(1, 20):
        rows.append(("f", str(d), "x", f"2021-07-{d:02d}T10:00:00+10:00", None, False))
        rows.append(("f", str(d), "x", f"2021-07-{d:02d} 10:00:00", None, False))
    df = spark.createDataFrame(rows, "feed string, row_key string, field string, value string, zone string, month_first boolean")
    chosen = T.estimate_zones(T._with_instants(df)).collect()
    assert [(r["zone"], r["violations"]) for r in chosen] == [("Australia/Sydney", 0)]
    assert T.normalise_timestamps(df).count() == 19


def test_empty(spark):
    df = spark.createDataFrame([], "feed string, row_key string, field string, value string, zone string, month_first boolean, extra int")
    assert T.normalise_timestamps(df).count() == 0


def feed(rows):
    """(row_key, value, zone, seq, seen) as rows of one feed."""
    return [("f", str(k), "x", v, z, False, s, seen) for k, v, z, s, seen in rows]


FEED = "feed string, row_key string, field string, value string, zone string, month_first boolean, seq bigint, seen_us bigint"


def history(spark, rows):
    parsed = T._with_instants(spark.createDataFrame(rows, FEED))
    return [(r["zone"], r["from_seq"], r["violations"], r["next_violations"]) for r in T.estimate_zones(parsed).orderBy("from_seq").collect()]


def stamps(zone, numbers, restated):
    """Records that write a local time, every ``restated``-th of them again with its offset."""
    rows = []
    for k in numbers:
        at = datetime(2021, 1, 1, tzinfo=timezone.utc) + timedelta(hours=37 * k)
        rows.append((k, at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), None, k, None))
        if k % restated == 0:
            rows.append((k, at.strftime("%Y-%m-%dT%H:%M:%SZ"), None, k, None))
    return rows


def test_a_feed_in_another_zone(spark):
    rows = feed(stamps("America/New_York", range(200), 5))
    ((zone, _, violations, following),) = history(spark, rows)
    assert zone == "America/New_York" and violations == 0 < following
    got = {(r["row_key"], r["epoch_us"]) for r in T.normalise_timestamps(spark.createDataFrame(rows, FEED)).collect()}
    assert got == {(str(k), 1609459200_000_000 + 37 * 3600_000_000 * k) for k in range(200)}


def test_a_feed_that_moves_half_way(spark):
    rows = feed(stamps("Asia/Kolkata", range(300), 3) + stamps("Europe/London", range(300, 600), 3))
    found = history(spark, rows)
    assert [z for z, *_ in found] == ["Asia/Kolkata", "Europe/London"] and abs(found[1][1] - 300) <= 6
    got = {(r["row_key"], r["epoch_us"]) for r in T.normalise_timestamps(spark.createDataFrame(rows, FEED)).collect()}
    true = {(str(k), 1609459200_000_000 + 37 * 3600_000_000 * k) for k in range(600)}
    assert len(got & true) >= 590


def test_ingestion_times_tell_the_zone(spark):
    """No value has a zone, but none can lie after the time it was taken in, and all were taken in within the hour."""
    rows = []
    for k in range(120):
        at = datetime(2021, 1, 1, tzinfo=timezone.utc) + timedelta(hours=37 * k)
        rows.append((k, at.astimezone(ZoneInfo("Australia/Sydney")).strftime("%Y-%m-%d %H:%M:%S"), None, k, int(at.timestamp() + 1800) * 1_000_000))
    assert history(spark, feed(rows))[0][0] == "Australia/Sydney"


def test_without_evidence_the_default_holds(spark):
    rows = feed([(1, "2020-01-01 10:00:00", None, None, None), (2, "2020-01-01", None, 5, None)])
    assert history(spark, rows) == []
    got = {(r["row_key"], r["epoch_us"]) for r in T.normalise_timestamps(spark.createDataFrame(rows, FEED)).collect()}
    assert got == {("1", 1577853000_000_000), ("2", 1577817000_000_000)}
    # One odd restatement is no evidence against it.
    odd = feed([(1, "2020-01-01 10:00:00", None, 1, None), (1, "2020-01-01T10:00:00Z", None, 1, None)])
    assert history(spark, odd)[0][0] == "Asia/Kolkata"
