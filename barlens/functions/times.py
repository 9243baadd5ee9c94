"""Date and session-clock functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONES = {"US": "America/New_York", "KR": "Asia/Seoul"}
CLOSE_MINUTE = {"US": 16 * 60, "KR": 15 * 60 + 30}


def parse_datetime(raw: Column, default_tz: str = "UTC", date_at_end: bool = False) -> Column:
    """UTC timestamp of 14 digits, 8 digits, ISO date, ISO time or RFC-822 text; else null.

    A text without an offset is local time of ``default_tz``; a date alone is its
    first or, with ``date_at_end``, its last second.
    """
    s = F.trim(F.coalesce(raw, F.lit("")))
    end = "235959" if date_at_end else "000000"
    digits = F.regexp_replace(s, "-", "")
    is_date = F.regexp(s, F.lit(r"^(\d{8}|\d{4}-\d{2}-\d{2})$"))
    local = F.when(F.regexp(s, F.lit(r"^\d{14}$")), s).when(is_date, F.concat(digits, F.lit(end)))
    from_digits = F.to_utc_timestamp(F.try_to_timestamp(local, F.lit("yyyyMMddHHmmss")), default_tz)
    has_zone = F.regexp(s, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    iso = F.when(F.regexp(s, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]")), s.try_cast("timestamp"))
    iso = F.when(has_zone, iso).otherwise(F.to_utc_timestamp(iso, default_tz))
    mail = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|UT|Z)$", " +0000")
    mail = F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.coalesce(from_digits, iso, mail)


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def last_completed_session(now: Column, market: str) -> Column:
    """Newest weekday whose regular session has closed at ``now`` (UTC)."""
    local = F.from_utc_timestamp(now, ZONES[market])
    day = F.to_date(local)
    minute = F.hour(local) * 60 + F.minute(local)
    open_day = (F.weekday(day) < 5) & (minute < CLOSE_MINUTE[market])
    day = F.when(open_day, F.date_sub(day, 1)).otherwise(day)
    return F.date_sub(day, F.greatest(F.lit(0), F.weekday(day) - 4))


def session_clock(text: Column, market: str = "US") -> Column:
    """UTC time of a 14-digit exchange clock whose hour may run to 47.

    A local time skipped by a DST change moves forward; an ambiguous one is null.
    """
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    day = F.to_date(F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")))
    h, m, s = (F.substring(digits, k, 2).cast("int") for k in (9, 11, 13))
    limit = 47 if market == "US" else 23
    ok = (F.length(digits) >= 14) & (h <= limit) & (m <= 59) & (s <= 59)
    wall = day.cast("timestamp") + F.make_dt_interval(hours=h, mins=m, secs=s)
    zone = ZONES[market]
    utc = F.to_utc_timestamp(wall, zone)
    # The same wall time an hour of UTC away means the clock was set back over it.
    hour = F.make_dt_interval(hours=F.lit(1))
    twice = (F.from_utc_timestamp(utc + hour, zone) == wall) | (F.from_utc_timestamp(utc - hour, zone) == wall)
    # Inside the skipped hour the next valid instant is the change itself.
    back = F.from_utc_timestamp(utc, zone)
    skipped = back != wall
    change = F.to_utc_timestamp(F.date_trunc("hour", back), zone)
    return F.when(ok & ~twice, F.when(skipped, change).otherwise(utc))


def display_time(published: Column, precision: Column, synthetic: Column) -> Column:
    """Date for date-only or synthetic times, else the minute; "time unknown" when empty."""
    date_only = F.lower(F.coalesce(precision, F.lit("second"))).isin("date", "date_only") | synthetic
    minute = F.replace(F.substring(published, 1, 16), F.lit("T"), F.lit(" "))
    known = F.coalesce(published, F.lit("")) != ""
    return F.when(known & date_only, F.substring(published, 1, 10)).when(known, minute).otherwise("time unknown")
