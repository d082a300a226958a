"""Date and time column functions.

Every function takes and returns explicit UTC values; the session zone is
pinned to UTC by ``session.prepare`` so naive strings read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import LOCAL_ZONE
from .text import strip_ws


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _try(s: Column, fmt: str) -> Column:
    return F.try_to_timestamp(s, F.lit(fmt))


def _iso(s: Column) -> Column:
    """ISO 8601 forms accepted by ``datetime.fromisoformat`` that occur in feeds:
    date, date+time with T or space, optional fraction, optional offset, and
    the compact ``yyyyMMdd`` date (quirk Q19). Cheap shape tests pick the one
    pattern to try, so a value is parsed at most twice."""
    z = F.regexp_replace(s, "Z$", "+00:00")
    n = F.char_length(s)
    sep = F.substring(s, 11, 1)
    timed = (n >= 16) & sep.isin("T", " ")
    zoned = s.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return (F.when(timed & zoned, F.coalesce(
                _try(z, "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"),
                _try(z, "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX"),
                _try(z, "yyyy-MM-dd'T'HH:mmXXX")))
            .when(timed, F.coalesce(
                _try(s, "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"),
                _try(s, "yyyy-MM-dd HH:mm:ss[.SSSSSS]"),
                _try(s, "yyyy-MM-dd'T'HH:mm"),
                _try(s, "yyyy-MM-dd HH:mm")))
            .when(n == 10, _try(s, "yyyy-MM-dd"))
            .when((n == 8) & s.rlike(r"^\d{8}$"), _try(s, "yyyyMMdd")))


def _rfc2822(s: Column) -> Column:
    """``%a, %d %b %Y %H:%M:%S %z`` and the ``+0000 (UTC)`` variant. Spark 3+
    cannot parse day names, so the 3-letter weekday is removed first; a
    ``GMT`` zone stays unparsed, as with ``%z`` (quirk Q4)."""
    body = F.regexp_extract(s, r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun), (.*)$", 1)
    ok = body != ""
    return F.when(ok, F.coalesce(
        F.when(body.rlike(r" [+-]\d{4}$"), _try(body, "d MMM yyyy HH:mm:ss Z")),
        F.when(body.rlike(r" [+-]\d{2}:\d{2}$"), _try(body, "d MMM yyyy HH:mm:ss XXX")),
        F.when(body.endswith(" +0000 (UTC)"),
               _try(F.regexp_replace(body, r" \+0000 \(UTC\)$", ""), "d MMM yyyy HH:mm:ss")),
    ))


def parse_datetime(col, month_names: bool = True) -> Column:
    """fn_parse_datetime (month_names=True) and fn_parse_datetime_fresh
    (month_names=False). Result is a UTC timestamp or null. Values starting
    with a digit go to the ISO / numeric patterns, others to the month-name
    and RFC 2822 patterns."""
    s = strip_ws(_c(col).cast("string"))
    s = F.when(s != "", s)
    digit = F.substring(s, 1, 1).between("0", "9")
    numeric = F.coalesce(_iso(s), _try(s, "yyyy-MM-dd HH:mm:ss"))
    named = [_try(s, "MMM d, yyyy"), _try(s, "MMMM d, yyyy")] if month_names else []
    return F.when(digit, numeric).otherwise(F.coalesce(*named, _rfc2822(s)))


def parse_api_datetime(col) -> Column:
    """fn_parse_api_datetime: ISO only."""
    s = _c(col).cast("string")
    return _iso(F.when(s != "", s))


def age_days(ts, as_of) -> Column:
    """fn_age_days: whole days before ``as_of``, floored, never negative."""
    diff = F.unix_micros(_c(as_of)) - F.unix_micros(_c(ts))
    return F.greatest(F.floor(diff / F.lit(86400000000.0)), F.lit(0)).cast("int")


def age_bucket(ts, target_date) -> Column:
    """fn_age_bucket: UTC calendar-day distance to the target date."""
    delta = F.datediff(_c(target_date), F.to_date(_c(ts)))
    return (F.when(_c(ts).isNull(), "undated")
            .when(delta < 0, "future")
            .when(delta <= 1, "fresh_48h")
            .when(delta <= 7, "recent_7d")
            .otherwise("stale_gt7d"))


def freshness_bucket(age) -> Column:
    """fn_freshness_bucket: age <= 1 fresh, <= 7 recent, else stale."""
    a = _c(age)
    return (F.when(a.isNull(), "undated").when(a <= 1, "fresh")
            .when(a <= 7, "recent").otherwise("stale"))


def local_date(ts, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(_c(ts), zone))


def day_start_utc(date_col, zone: str = LOCAL_ZONE) -> Column:
    """fn_day_start_utc: local midnight of a date, as UTC."""
    return F.to_utc_timestamp(_c(date_col).cast("timestamp"), zone)


def service_ts(col) -> Column:
    """Task-service timestamp string read as UTC from its first 19 chars
    (offset ignored, quirk Q13)."""
    return F.try_to_timestamp(F.substring(_c(col), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def fn_local_date(col, zone: str = LOCAL_ZONE) -> Column:
    """fn_local_date: service string to Beijing date text; bad input -> ''."""
    ts = service_ts(col)
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd"), F.lit(""))


def fn_local_time(col, zone: str = LOCAL_ZONE) -> Column:
    """fn_local_time: service string to Beijing time text; bad input -> first 19 chars."""
    ts = service_ts(col)
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd'T'HH:mm:ss"),
                      F.substring(F.coalesce(_c(col), F.lit("")), 1, 19))


def parse_due(col) -> Column:
    """fn_parse_due: date-only -> 09:00 UTC (quirk Q14); minute precision ->
    seconds and +0000 appended; anything else unchanged."""
    c = _c(col)
    n = F.char_length(c)
    return (F.when(n == 10, F.concat(c, F.lit("T09:00:00.000+0000")))
            .when(n == 16, F.concat(c, F.lit(":00.000+0000")))
            .otherwise(c))
