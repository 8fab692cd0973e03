import datetime as dt

import pytest

from siteloom.operators.timestamps import estimate_zones, normalise_timestamps, normalise_with_estimates, offset_histories

UTC = dt.timezone.utc
SOURCES = [(1, "UTC", "dmy"), (2, "Europe/Berlin", "dmy"), (3, "America/New_York", "mdy"), (4, "Asia/Kolkata", "dmy"), (5, None, "mdy"), (6, "Australia/Lord_Howe", "dmy")]

#: stamp, source, received (UTC), instant (UTC) or None
CASES = [
    ("1761781118.246", 1, "2025-10-30", "2025-10-29 23:38:38.246"), ("1761781118", 1, "2025-10-30", "2025-10-29 23:38:38"), ("1761781118246", 1, "2025-10-30", "2025-10-29 23:38:38.246"), ("1761781118246123", 1, "2025-10-30", "2025-10-29 23:38:38.246123"),
    ("1761781118246123999", 1, "2025-10-30", "2025-10-29 23:38:38.246123"), ("2026-02-28T08:20:38.351780776Z", 2, "2026-03-01", "2026-02-28 08:20:38.351780"), (" 2026-01-10T17:37:43.333  ", 2, "2026-01-13", "2026-01-10 16:37:43.333"),
    ("2026-02-13t14:03:23z", 3, "2026-02-14", "2026-02-13 14:03:23"), ("2025-10-08T12:59:46+02", 2, "2025-10-08 12:00", "2025-10-08 10:59:46"), ("2026-01-24 17:25:45 +0100", 2, "2026-01-25", "2026-01-24 16:25:45"), ("2025-10-01 18:39:41,723", 3, "2025-10-02", "2025-10-01 22:39:41.723"),
    ("20260329T013410Z", 1, "2026-03-30", "2026-03-29 01:34:10"), ("Wed Sep 24 06:08:03 2025", 1, "2025-09-25", "2025-09-24 06:08:03"), ("Dec 12, 2025 12:41:15 AM", 1, "2025-12-13", "2025-12-12 00:41:15"), ("Dec 12, 2025 12:41:15 PM", 1, "2025-12-13", "2025-12-12 12:41:15"),
    ("Sun, 23 Nov 2025 10:23:59 +1100", 1, "2025-11-24", "2025-11-22 23:23:59"), ("30/Dec/2025:15:14:23 +0000", 1, "2025-12-31", "2025-12-30 15:14:23"), ("02-04-26 20:46:38", 3, "2026-02-06", "2026-02-05 01:46:38"), ("02-04-26 20:46:38", 1, "2026-05-06", "2026-04-02 20:46:38"),
    ("23/02/2026 14:55", 4, "2026-02-24", "2026-02-23 09:25:00"), ("2026-02-01 02:06", 5, "2026-02-02", "2026-02-01 02:06:00"),
    # which of two equal local times: the latest not after ingestion
    ("2025-10-26 02:30:00", 2, "2025-10-26 00:40:00", "2025-10-26 00:30:00"), ("2025-10-26 02:30:00", 2, "2025-10-26 05:00:00", "2025-10-26 01:30:00"), ("2025-11-02 01:15:00 EDT", 3, "2025-11-03", "2025-11-02 05:15:00"), ("2025-11-02 01:15:00 EST", 3, "2025-11-03", "2025-11-02 06:15:00"),
    ("2025-07-01 10:00:00 CEST", 2, "2025-07-02", "2025-07-01 08:00:00"), ("2026-04-05 01:45:00", 6, "2026-04-06", "2026-04-04 15:15:00"),
    # the year: the latest not after ingestion
    ("Dec  7 12:34:31", 1, "2026-01-05", "2025-12-07 12:34:31"), ("Jan  2 00:10:00", 1, "2026-01-01 23:00", "2025-01-02 00:10:00"), ("Feb 29 10:00:00", 1, "2026-01-01", "2024-02-29 10:00:00"), ("Jan 1 00:30:00", 4, "2025-12-31 20:00", "2025-12-31 19:00:00"),
    # without a time
    ("", 1, "2026-01-01", None), (None, 1, "2026-01-01", None), ("null", 1, "2026-01-01", None), ("0000-00-00 00:00:00", 1, "2026-01-01", None), ("-", 1, "2026-01-01", None), ("2026-02-30 10:00:00", 1, "2026-03-01", None), ("2026-01-01 25:00:00", 1, "2026-03-01", None), ("Feb 30 10:00:00", 1, "2026-03-01", None),
    # unknown source, no source, no ingestion time
    ("2026-02-01 02:06:00", 99, "2026-02-02", "2026-02-01 02:06:00"), ("2026-02-01 02:06:00", None, "2026-02-02", "2026-02-01 02:06:00"), ("2026-02-01 02:06:00", 1, None, "2026-02-01 02:06:00"), ("Feb  1 02:06:00", 1, None, None),
]


def micros(text):
    return None if text is None else round(dt.datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1_000_000)


def hits(spark, rows):
    return spark.createDataFrame(rows, "hit_id long, source_id int, timestamp_text string, received_at timestamp, tz string, _c int")


def test_cases(spark):
    rows = [(i, s, t, None if r is None else dt.datetime.fromisoformat(r).replace(tzinfo=UTC), "x", 1) for i, (t, s, r, _) in enumerate(CASES)]
    got = {r.hit_id: r.utc_micros for r in normalise_timestamps(hits(spark, rows), spark.createDataFrame(SOURCES, "source_id int, tz string, date_order string")).collect()}
    wrong = [(CASES[i], got.get(i)) for i in range(len(CASES)) if got.get(i) != micros(CASES[i][3])]
    assert not wrong


def test_session_zone_does_not_matter(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        rows = [(1, 2, "2026-01-10T17:37:43.333", dt.datetime(2026, 1, 13, tzinfo=UTC), None, None)]
        got = normalise_timestamps(hits(spark, rows), spark.createDataFrame(SOURCES, "source_id int, tz string, date_order string")).collect()
        assert got[0].utc_micros == micros("2026-01-10 16:37:43.333")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_empty_and_without_sources(spark):
    assert normalise_timestamps(hits(spark, [])).count() == 0
    one = hits(spark, [(1, None, "2026-01-01 00:00:00", None, None, None)] * 2)
    assert [r.utc_micros for r in normalise_timestamps(one).collect()] == [micros("2026-01-01")] * 2


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kolkata"])
def test_zones_are_estimated(spark, zone):
    from zoneinfo import ZoneInfo

    rows = []
    for i in range(400):
        at = dt.datetime(2025, 10, 1, tzinfo=UTC) + dt.timedelta(hours=7 * i, minutes=i % 50)
        rows.append((i, 1, at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), at + dt.timedelta(minutes=i % 9), None, None))
    got = estimate_zones(hits(spark, rows), ["UTC", "Europe/London", "Europe/Berlin", "America/New_York", "America/Chicago", "Asia/Kolkata", "Asia/Dubai"]).collect()
    assert [r.zone for r in got] == [zone]


def test_zones_are_estimated_from_stamps_of_any_format(spark):
    from zoneinfo import ZoneInfo

    forms, rows = ["%b %e %H:%M:%S", "%a %b %d %H:%M:%S %Y", "%b %d, %Y %I:%M:%S %p", "%m/%d/%y %H:%M:%S", "%m/%d/%Y %H:%M"], []
    for i in range(400):
        at = dt.datetime(2025, 10, 1, tzinfo=UTC) + dt.timedelta(hours=7 * i, minutes=i % 50)
        for source, form in enumerate(forms):
            rows.append((i, source, at.astimezone(ZoneInfo("America/New_York")).strftime(form), at + dt.timedelta(minutes=i % 9 + 1), None, None))
    order = spark.createDataFrame([(i, "mdy") for i in range(len(forms))], "source_id int, date_order string")
    got = estimate_zones(hits(spark, rows), ["UTC", "Europe/Berlin", "America/New_York", "America/Chicago", "Asia/Kolkata"], sources=order).collect()
    assert {r.source_id: (r.zone, r.stamps) for r in got} == dict.fromkeys(range(len(forms)), ("America/New_York", 400))


def test_missing_zones_are_estimated_and_used(spark):
    from zoneinfo import ZoneInfo

    zones = {1: "Asia/Kathmandu", 2: "America/New_York", 3: "Australia/Lord_Howe", 4: "UTC"}
    rows, truth = [], {}
    for source, zone in zones.items():
        for i in range(300):
            at = dt.datetime(2024, 9, 1, tzinfo=UTC) + dt.timedelta(hours=29 * i, minutes=i % 50)
            truth[1000 * source + i] = at
            rows.append((1000 * source + i, source, at.astimezone(ZoneInfo(zone)).strftime("%d %b %Y %H:%M:%S" if i % 2 else "%Y-%m-%dT%H:%M:%S"), at + dt.timedelta(seconds=30 + i % 500), None, None))
    rows += [(1, None, "2024-01-05 10:00:00", dt.datetime(2024, 1, 5, 12, tzinfo=UTC), None, None), (2, 77, "no time", dt.datetime(2024, 1, 5, 12, tzinfo=UTC), None, None)]
    # source 2 is known, the others' zones are missing
    dim = spark.createDataFrame([(1, None, "dmy"), (2, "America/New_York", "dmy"), (3, None, "dmy")], "source_id int, tz string, date_order string")
    got = {r.hit_id: r.utc_micros for r in normalise_with_estimates(hits(spark, rows), dim).collect()}
    right = sum(got.get(k) == int(v.timestamp()) * 1_000_000 for k, v in truth.items())
    assert right >= 0.99 * len(truth) and got[1] == micros("2024-01-05 10:00:00") and 2 not in got


def test_histories():
    names = offset_histories()
    assert names[0] == "UTC" and len(names) == len(set(names)) > 50


def test_estimates_of_nothing(spark):
    dim = spark.createDataFrame([(1, None, None)], "source_id int, tz string, date_order string")
    assert normalise_with_estimates(hits(spark, []), dim).count() == 0
    one = hits(spark, [(1, 1, "2026-01-01 00:00:00", None, None, None), (2, 1, None, dt.datetime(2026, 1, 1, tzinfo=UTC), None, None)])
    assert [r.utc_micros for r in normalise_with_estimates(one, dim.limit(0)).collect()] == [micros("2026-01-01")]
