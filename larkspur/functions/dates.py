"""Dates and times.  Clocks are parameters; the zone of wall-clock text is explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Tokyo"
#: Hours: retired after 60 days without change; polls fade from hourly to weekly.
RETIRE_HOURS, FADE, LEAST, MOST = 1440, 24, 1, 168


def _null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parsed_local(text: Column, now: Column, zone: str = ZONE) -> Column:
    """YYYY/MM/DD[ HH:mm] of a zone as an instant; text without such a date gives `now`."""
    date = F.regexp_extract(text, r"([0-9]{4})[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})", 0)
    clock = F.regexp_extract(text, r"[0-9]{4}[/.-][0-9]{1,2}[/.-][0-9]{1,2}\D+([0-9]{1,2}:[0-9]{2})", 1)
    local = F.try_to_timestamp(F.concat_ws(" ", F.regexp_replace(date, "[.-]", "/"), F.when(clock == "", "0:00").otherwise(clock)), F.lit("yyyy/M/d H:mm"))
    return F.coalesce(F.to_utc_timestamp(local, zone), now)


def date_in_title(title: Column, year: Column, month: Column, now: Column, zone: str = ZONE) -> Column:
    """The date in a title, else the first of the listing's month, else now."""
    own = F.regexp_extract(title, r"[0-9]{4}[/年][0-9]{1,2}[/月][0-9]{1,2}", 0)
    local = F.try_to_timestamp(F.regexp_replace(own, "[年月]", "/"), F.lit("yyyy/M/d"))
    fallback = F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.coalesce(F.to_utc_timestamp(F.coalesce(local, fallback), zone), now)


def inferred_date(month: Column, day: Column, today: Column) -> Column:
    """A month and day in the year that lies within 180 days of today; null if no such date exists.

    Years are tried from this one outward, so 29 February resolves only where it exists.
    """
    out = F.lit(None).cast("date")
    for shift in (1, -1, 0):
        text = F.concat_ws("-", (F.year(today) + shift).cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
        d = text.try_cast("date")
        out = F.when(d.isNotNull() & (F.abs(F.datediff(d, today)) <= 180), d).otherwise(out)
    return out


def game_date(date: Column, hour: Column, rollover: int = 6) -> Column:
    """Hours before the rollover belong to the next date."""
    return F.date_add(date, (hour < rollover).cast("int"))


def changeover(date: Column, hours: int = 6) -> Column:
    return F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + hours * 3_600_000_000)


def recheck_hours(quiet_hours: Column) -> Column:
    """Hours until the next poll: the quiet time over 24, between 1 and 168; null (retired) beyond 60 days."""
    return F.when(quiet_hours <= RETIRE_HOURS, F.least(F.greatest(quiet_hours / FADE, F.lit(float(LEAST))), F.lit(float(MOST))))


def quiet_hours(changed: Column, now: Column) -> Column:
    return (F.unix_millis(now) - F.unix_millis(changed)) / 3_600_000


def next_check(checked: Column, changed: Column, now: Column) -> Column:
    """Last check plus the rounded interval; null once retired."""
    return F.timestamp_millis(F.unix_millis(checked) + F.round(recheck_hours(quiet_hours(changed, now)) * 3_600_000).cast("long"))


def is_due(checked: Column, changed: Column, now: Column) -> Column:
    return F.coalesce(next_check(checked, changed, now) <= now, F.lit(False))


def anchors(published: Column, fetched: Column, changed: Column, checked: Column) -> tuple[Column, Column]:
    """(changed, checked): change falls back to publication, then fetch; check to fetch."""
    anchor = F.coalesce(published, fetched)
    return F.coalesce(changed, anchor), F.coalesce(checked, fetched)


def horizon(now: Column, days: int = 120, zone: str = ZONE) -> tuple[Column, Column]:
    """Midnight of the zone's today and the instant `days` later, in UTC."""
    start = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(now, zone)), zone)
    return start, F.timestamp_micros(F.unix_micros(start) + days * 86_400_000_000)


def retention_cutoff(now: Column, months: int, zone: str = ZONE) -> Column:
    """The same wall-clock time `months` earlier in the zone."""
    local = F.from_utc_timestamp(now, zone)
    return F.to_utc_timestamp(F.make_interval(months=F.lit(-months)) + local, zone)


def event_attribute(kind: Column, at: Column, zone: str = ZONE, offset: str = "+09:00") -> Column:
    """All-day kinds as a date, others as a date and time with offset."""
    local = F.from_utc_timestamp(at, zone)
    return F.when(kind.isin("allDay", "multiDay"), F.date_format(local, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset)))


def dated_with_weekday(at: Column, names: list[str], zone: str = ZONE) -> Column:
    """YYYY-MM-DD (weekday name), Monday first in `names`."""
    local = F.from_utc_timestamp(at, zone)
    return F.concat(F.date_format(local, "yyyy-MM-dd"), F.lit(" ("), F.element_at(F.array(*[F.lit(n) for n in names]), F.weekday(local) + 1), F.lit(")"))


def _span(seconds: Column) -> Column:
    s = F.abs(seconds)
    return (
        F.when(s < 60, F.concat(F.floor(s).cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d")))
    )


def relative_past(at: Column, now: Column) -> Column:
    seconds = (F.unix_millis(now) - F.unix_millis(at)) / 1000
    return F.when(seconds < 60, "just now").otherwise(F.concat(_span(seconds), F.lit(" ago")))


def until(at: Column, now: Column) -> Column:
    seconds = (F.unix_millis(at) - F.unix_millis(now)) / 1000
    return F.when(seconds <= 0, "now").otherwise(F.concat(F.lit("in "), _span(seconds)))


def overdue(at: Column, now: Column) -> Column:
    seconds = (F.unix_millis(now) - F.unix_millis(at)) / 1000
    return F.when(seconds < 60, "due now").otherwise(F.concat(_span(seconds), F.lit(" overdue")))


def seconds_to_hour(now: Column) -> Column:
    return 3600 - F.pmod(F.unix_seconds(now), F.lit(3600))


def parsed_iso(text: Column, zone: str = ZONE) -> Column:
    """ISO text with an offset, or a bare local time of the zone; else null."""
    with_offset = text.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$")
    bare = F.regexp_replace(F.regexp_replace(text, "T", " "), r"\[.*$", "")
    return F.when(with_offset, text.try_cast("timestamp")).otherwise(F.to_utc_timestamp(bare.try_cast("timestamp_ntz").cast("timestamp"), zone))


def plausible(start: Column, end: Column, published: Column) -> Column:
    """Start within -180 and +540 days of publication, end not before it, duration 180 days at most."""
    days = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 86_400_000_000
    return days(start, published).between(-180, 540) & F.coalesce((days(end, start) >= 0) & (days(end, start) <= 180), F.lit(True))
