"""Timestamps of mixed formats, precisions and zones as one instant in UTC.

Everything is column arithmetic on microseconds since 1970 (never on session-zone
timestamps), so results don't depend on ``spark.sql.session.timeZone``.

A stamp with an offset is converted at once. A stamp without one is read as local time of
its source's clock. Each offset of the zone's history near that time, and where the year is
missing each year, gives one candidate instant; a candidate after the reliable ingestion
time is a violation. The latest candidate without violation is chosen.

Where a source's zone is missing it is estimated: the local times of its stamps are aligned with
their ingestion times, and of all offset histories that the time-zone database knows the one with
the fewest violations and then the least delay is taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC"
DAY_US = 86_400_000_000
#: Years before and after the ingestion year that are tried where a stamp has none (29 February needs eight).
YEARS_BACK, YEARS_ON = 8, 1
#: What a violation costs when zones are compared, in microseconds of delay; no hour costs more.
VIOLATION_US = DAY_US
#: The most that a zone is ahead of UTC.
MOST_AHEAD_US = 14 * 3_600_000_000

_MON = "(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\\.?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(?:\s*\(?(Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5}(?<!AM|PM))\)?)?"
_HALF = r"(?:\s*([AP])\.?M\.?)?"
_WEEKDAY = r"(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*,?\s+)?"

#: (pattern over the trimmed upper-case stamp, replacement giving year|month|day|hour|minute|second|fraction|zone|A or P).
FORMATS: Sequence[tuple[str, str]] = (
    (rf"^\[?(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[T\s]\s*{_TIME}{_HALF}{_ZONE}\]?$", "$1|$2|$3|$4|$5|$6|$7|$9|$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T\s]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    (rf"^\[?(\d{{1,2}})/{_MON}/(\d{{4}}):{_TIME}{_ZONE}\]?$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    (rf"^{_WEEKDAY}(\d{{1,2}})[\s-]{_MON},?[\s-](\d{{4}}|\d{{2}}),?\s+{_TIME}{_HALF}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$9|$8"),
    (rf"^{_WEEKDAY}{_MON}\s+(\d{{1,2}})\s+{_TIME}(?:\s+([A-Z]{{3,5}}|[+-]\d{{4}}))?\s+(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6|$7|"),
    (rf"^{_WEEKDAY}{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_TIME}{_HALF}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
    (rf"^{_WEEKDAY}{_MON}\s+(\d{{1,2}})\s+{_TIME}{_ZONE}$", "|$1|$2|$3|$4|$5|$6|$7|"),
)
#: Numbers only, neither year nor month name first: the order of the first two comes from the source.
NUMERIC = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}),?[T\s]\s*{_TIME}{_HALF}{_ZONE}$"
NUMERIC_DMY, NUMERIC_MDY = "$3|$2|$1|$4|$5|$6|$7|$9|$8", "$3|$1|$2|$4|$5|$6|$7|$9|$8"
EPOCH = r"^(\d{9,20})(?:\.(\d+))?$"


def zone_offset(zone: Column, instant_us: Column) -> Column:
    """Microseconds that ``zone`` is ahead of UTC at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant_us), zone)) - instant_us


def _epoch_us(t: Column) -> Column:
    digits, n = F.regexp_extract(t, EPOCH, 1), F.length(F.regexp_extract(t, EPOCH, 1))
    tail = F.rpad(F.substring(F.regexp_extract(t, EPOCH, 2), 1, 6), 6, "0").try_cast("long")
    whole = digits.try_cast("decimal(20,0)")
    return (
        F.when(n <= 11, whole.cast("long") * 1_000_000 + tail)
        .when(n <= 14, whole.cast("long") * 1_000 + F.substring(F.rpad(F.regexp_extract(t, EPOCH, 2), 3, "0"), 1, 3).try_cast("long"))
        .when(n <= 17, whole.cast("long"))
        .otherwise(F.floor(whole / 1_000).cast("long"))
    )


def parsed_parts(stamp: Column, date_order: Column) -> Column:
    """The pieces ``year|month|day|hour|minute|second|fraction|zone|half`` of a stamp, null if it gives no time."""
    t = F.upper(F.regexp_replace(stamp, r"(?U)^[\s\"'\[]+|[\s\"'\]]+$", ""))
    out = F.when(t.rlike(FORMATS[0][0]), F.regexp_replace(t, *map(F.lit, FORMATS[0])))
    for pattern, order in FORMATS[1:]:
        out = out.when(t.rlike(pattern), F.regexp_replace(t, F.lit(pattern), F.lit(order)))
    return out.when(
        t.rlike(NUMERIC),
        F.when(date_order == "mdy", F.regexp_replace(t, F.lit(NUMERIC), F.lit(NUMERIC_MDY))).otherwise(F.regexp_replace(t, F.lit(NUMERIC), F.lit(NUMERIC_DMY))),
    )


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _local_us(year: Column, month: Column, day: Column, clock_us: Column) -> Column:
    """Microseconds of a local date and time of day; null for a date that doesn't exist."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.unix_date(text.try_cast("date")).cast("long") * DAY_US + clock_us


def _with_parts(base: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``base(keep, _raw, _got, _tz, _ord)`` with the stamp's epoch, date, time of day, offset and abbreviation."""
    bare = F.regexp_replace("_raw", r"(?U)^[\s\"'\[]+|[\s\"'\]]+$", "")
    cut = base.select(*keep, "_got", "_tz", bare.alias("_t"), F.split(parsed_parts(F.col("_raw"), F.col("_ord")), r"\|").alias("_p"))
    part = lambda i: F.col("_p")[i]
    hour, half = _int(part(3)), part(8)
    hour24 = F.when((half == "A") & (hour == 12), 0).when((half == "P") & (hour < 12), hour + 12).otherwise(hour)
    minute, second = _int(part(4)), F.coalesce(_int(part(5)), F.lit(0))
    clock = F.when(
        (hour24 <= 24) & (minute < 60) & (second <= 60),
        ((hour24.cast("long") * 60 + minute) * 60 + second) * 1_000_000 + F.rpad(F.substring(part(6), 1, 6), 6, "0").try_cast("long"),
    )
    year = _int(part(0))
    named = F.floor((F.instr(F.lit(MONTHS), part(1)) - 1) / 4 + 1).cast("int")
    zone = part(7)
    signed = F.regexp_extract(zone, r"^([+-])(\d{2}):?(\d{2})?$", 1)
    offset_us = (_int(F.substring(zone, 2, 2)).cast("long") * 60 + F.coalesce(_int(F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})$", 1)), F.lit(0))) * 60_000_000
    fixed = F.when(zone.isin("Z", "UTC", "GMT", "UT"), F.lit(0)).when(signed == "+", offset_us).when(signed == "-", -offset_us)
    return cut.select(
        *keep,
        "_got",
        "_tz",
        F.when(F.col("_p").isNull() & F.col("_t").rlike(EPOCH), _epoch_us(F.col("_t"))).alias("_epoch"),
        F.when(F.length(part(0)) == 2, year + 2000).otherwise(year).alias("_y"),
        F.when(part(1).rlike("^[A-Z]"), named).otherwise(_int(part(1))).alias("_mo"),
        _int(part(2)).alias("_d"),
        clock.alias("_clock"),
        fixed.cast("long").alias("_fixed"),
        F.when(fixed.isNull() & (F.length(zone) > 0), zone).alias("_abbr"),
    )


def _locals() -> Column:
    """The local times that a stamp may mean: one, or where it has no year one of each year around the ingestion."""
    got_year = F.year(F.timestamp_micros("_got"))
    years = F.when(F.col("_y").isNotNull(), F.array("_y")).when(F.col("_got").isNotNull(), F.sequence(got_year + YEARS_ON, got_year - YEARS_BACK, F.lit(-1)))
    return F.filter(F.transform(years, lambda y: _local_us(y, F.col("_mo"), F.col("_d"), F.col("_clock"))), lambda x: x.isNotNull())


def normalise_timestamps(
    hits: DataFrame,
    sources: DataFrame | None = None,
    stamp: str = "timestamp_text",
    received: str = "received_at",
    source: str = "source_id",
    keep: Sequence[str] = ("hit_id",),
    default_zone: str = "UTC",
) -> DataFrame:
    """``keep`` columns and ``utc_micros`` for every row of ``hits`` whose stamp gives a time.

    ``sources(source_id, tz, date_order)`` is a dimension table with one row per program; it
    is joined, not broadcast by hint, so its size is the optimizer's affair. A row whose source
    is unknown or null is read in ``default_zone``, day first. Defined cases: null, empty and
    void stamps and impossible dates give no row; finer digits than microseconds are cut; a
    local time that a clock change skips is read with the offset before it; if every candidate
    lies after ingestion, the earliest is taken; without ingestion time the latest candidate is
    taken, and a stamp without year gives no row. Further columns of either table are ignored.
    """
    base = hits.select(*keep, F.col(source).alias("_src"), F.col(stamp).alias("_raw"), F.unix_micros(F.col(received).cast("timestamp")).alias("_got"))
    if sources is not None:
        dim = sources.select(F.col(source).alias("_id"), F.col("tz").alias("_tz"), F.col("date_order").alias("_ord")).where("_id is not null").dropDuplicates(["_id"])
        base = base.join(dim, F.col("_src") == F.col("_id"), "left").drop("_id")
    else:
        base = base.withColumns({"_tz": F.lit(None).cast("string"), "_ord": F.lit(None).cast("string")})
    cols = _with_parts(base.withColumn("_tz", F.coalesce("_tz", F.lit(default_zone))), keep)
    locals_ = _locals()
    tz = F.col("_tz")
    # a zone's two offsets are both met within four quarters
    quarters = [F.lit(days * DAY_US) for days in (0, 91, 182, 273)]
    daylight = F.col("_abbr").rlike("DT$") | F.col("_abbr").isin("CEST", "EEST", "WEST", "BST")

    def candidates(local: Column) -> Column:
        before, after = local - zone_offset(tz, local - DAY_US), local - zone_offset(tz, local + DAY_US)
        true = F.filter(F.array(before, after), lambda c: c + zone_offset(tz, c) == local)
        by_history = F.when(F.size(true) > 0, true).otherwise(F.array(before))
        seasons = [zone_offset(tz, local + season) for season in quarters]
        named_ = F.array(local - F.when(daylight, F.greatest(*seasons)).otherwise(F.least(*seasons)))
        return F.when(F.col("_fixed").isNotNull(), F.array(local - F.col("_fixed"))).when(F.col("_abbr").isNotNull(), named_).otherwise(by_history)

    all_ = F.flatten(F.transform(F.col("_local"), candidates))
    chosen = F.coalesce(F.array_max(F.filter("_c", lambda c: F.col("_got").isNull() | (c <= F.col("_got")))), F.array_min("_c"))
    return (
        cols.withColumn("_local", locals_)
        .withColumn("_c", F.when(F.col("_epoch").isNull(), all_))
        # explode drops the nulls; a filter here would be pushed below and evaluate everything once more
        .select(*keep, F.explode(F.filter(F.array(F.coalesce("_epoch", chosen)), lambda x: x.isNotNull())).alias("utc_micros"))
    )


#: Names preferred for an offset history that several zones share, and years in which histories are told apart.
PREFERRED = (
    "UTC", "Europe/London", "Europe/Berlin", "Europe/Athens", "Europe/Moscow", "Asia/Dubai", "Asia/Kolkata", "Asia/Bangkok", "Asia/Shanghai", "Asia/Tokyo",
    "Australia/Sydney", "Pacific/Auckland", "America/Sao_Paulo", "America/Halifax", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles",
)
HISTORY_YEARS = (2018, 2030)


@lru_cache(maxsize=8)
def offset_histories(first: int = HISTORY_YEARS[0], last: int = HISTORY_YEARS[1]) -> tuple[str, ...]:
    """One zone for each distinct history of offsets in the years given, the preferred names first."""
    known = available_timezones()
    names = [z for z in PREFERRED if z in known] + sorted(z for z in known if "/" in z and not z.startswith(("Etc/", "posix/", "right/", "SystemV/", "US/")) and z not in PREFERRED)
    days = [datetime(first, 1, 1, 12) + timedelta(days=d) for d in range(0, 366 * (last - first + 1), 5)]
    histories: dict[tuple, str] = {}
    for name in names or ["UTC"]:
        zone = ZoneInfo(name) if names else None
        histories.setdefault(tuple(zone.utcoffset(d) for d in days) if zone else (), name)
    return tuple(histories.values())


def normalise_with_estimates(hits: DataFrame, sources: DataFrame, **options: object) -> DataFrame:
    """``normalise_timestamps`` with estimated zones for the sources of the hits that ``sources`` gives no zone for.

    A source without a zone whose stamps don't allow an estimate is read in the default zone, as are hits without
    source. Only the hits of sources without a zone are read a second time.
    """
    known = sources.where("source_id is not null").dropDuplicates(["source_id"])
    missing = hits.join(known.where("tz is not null").select("source_id"), "source_id", "left_anti")
    guessed = estimate_zones(missing, sources=known).select("source_id", F.col("zone").alias("_zone"))
    both = known.join(guessed, "source_id", "full_outer").select("source_id", F.coalesce("tz", "_zone").alias("tz"), "date_order")
    return normalise_timestamps(hits, both, **options)


def estimate_zones(
    hits: DataFrame, zones: Sequence[str] | None = None, stamp: str = "timestamp_text", received: str = "received_at", source: str = "source_id", sources: DataFrame | None = None
) -> DataFrame:
    """For each source the zone whose offset history fits its zoneless stamps best.

    Output: ``source_id, zone, stamps, violations``, a row for each source with a zoneless stamp of any
    format and its ingestion time. Of ``sources(source_id, date_order)`` only the order of numeric dates is
    taken, never the zone. A stamp without year is of the latest year that some zone allows. Local times are reduced to the smallest
    and mean delay per source and hour before the zones are tried, so the work per zone is bounded
    by the hours a source was active. ``zones`` are all distinct offset histories unless given. An hour costs its least delay, and ``VIOLATION_US`` if a
    hit would lie after its ingestion; chosen is the zone of the lowest cost, the first of equals.
    """
    zones = offset_histories() if zones is None else zones
    base = hits.select(F.col(source).alias("source_id"), F.col(stamp).alias("_raw"), F.unix_micros(F.col(received).cast("timestamp")).alias("_got")).where("source_id is not null and _got is not null")
    if sources is not None:
        dim = sources.select(F.col(source).alias("source_id"), F.col("date_order").alias("_ord")).where("source_id is not null").dropDuplicates(["source_id"])
        base = base.join(dim, "source_id", "left")
    else:
        base = base.withColumn("_ord", F.lit(None).cast("string"))
    zoneless = F.col("_epoch").isNull() & F.col("_fixed").isNull() & F.col("_abbr").isNull()
    parts = _with_parts(base.withColumn("_tz", F.lit(None).cast("string")), ["source_id"])
    each = parts.select("source_id", F.col("_got").alias("got"), F.when(zoneless, _locals()).alias("_all"))
    latest = F.coalesce(F.array_max(F.filter("_all", lambda x: x <= F.col("got") + MOST_AHEAD_US)), F.array_min("_all"))
    # explode drops the nulls; a filter here would be pushed below and evaluate everything once more
    local = each.select("source_id", "got", F.explode(F.filter(F.array(latest), lambda x: x.isNotNull())).alias("local"))
    hour = F.floor(F.col("local") / 3_600_000_000)
    hours = local.groupBy("source_id", hour.alias("hour")).agg(F.min(F.col("got") - F.col("local")).alias("least"), F.count(F.lit(1)).alias("n"), F.avg(F.col("got") - F.col("local")).alias("mean"))
    tried = hours.withColumn("z", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(z).alias("zone")) for i, z in enumerate(zones)])))
    at = F.col("hour") * 3_600_000_000
    offset = zone_offset(F.col("z.zone"), at - zone_offset(F.col("z.zone"), at))
    tried = tried.withColumn("offset", offset)
    scored = tried.groupBy("source_id", "z").agg(
        F.sum("n").alias("stamps"),
        F.sum(F.when(F.col("least") + F.col("offset") < 0, 1).otherwise(0)).alias("violations"),
        F.sum(F.when(F.col("least") + F.col("offset") < 0, VIOLATION_US).otherwise(F.least(F.lit(VIOLATION_US), F.col("least") + F.col("offset")))).alias("cost"),
    )
    best = scored.groupBy("source_id").agg(F.min(F.struct("cost", "violations", F.col("z.i").alias("i"), F.col("z.zone").alias("zone"), "stamps")).alias("b"))
    return best.select("source_id", "b.zone", "b.stamps", "b.violations")
