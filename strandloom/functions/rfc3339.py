"""Strict RFC 3339 timestamps as epoch milliseconds, and a lenient policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.instants import instant

#: The shape alone; every field but the fraction has a fixed place, and ranges are checked on the values.
SHAPE = r"\A\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})\z"
_DAY_MS, _HOUR_MS, _MINUTE_MS = 86_400_000, 3_600_000, 60_000


def strict_ms(value: Column) -> Column:
    """Epoch ms of a timestamp with a mandatory offset, NULL if it is not one or names no real instant.

    Which days exist is left to Spark's own calendar. Second 60 is refused; offsets reach 23:59; a fraction of any length is
    rounded to the millisecond. Years 0 to 99 mean 1900 to 1999, as in the implementation this follows.
    """
    part = lambda start, length: F.substring(value, start, length)
    number = lambda text: text.cast("int")
    named_day = F.concat(part(1, 10)).try_cast("date")
    year = F.when(part(1, 2) == "00", F.concat(F.lit("19"), part(3, 2))).otherwise(part(1, 4))
    first = F.concat(year, part(5, 3), F.lit("-01")).try_cast("date")
    hour, minute, second = number(part(12, 2)), number(part(15, 2)), number(part(18, 2))
    fraction = F.when(part(20, 1) == ".", F.concat(F.lit("0"), F.regexp_extract(value, r"\.\d+", 0)).cast("double")).otherwise(0.0)
    away = F.when(~F.upper(F.right(value, F.lit(1))).isin("Z"), F.right(value, F.lit(6)))
    off_hour, off_minute = F.coalesce(number(F.substring(away, 2, 2)), F.lit(0)), F.coalesce(number(F.substring(away, 5, 2)), F.lit(0))
    east = (off_hour * _HOUR_MS + off_minute * _MINUTE_MS) * F.when(away.startswith("-"), -1).otherwise(1)
    real = named_day.isNotNull() & (hour <= 23) & (minute <= 59) & (second <= 59) & (off_hour <= 23) & (off_minute <= 59)
    days = F.unix_date(first).cast("bigint") + number(part(9, 2)) - 1
    wall = days * _DAY_MS + hour * _HOUR_MS + minute * _MINUTE_MS + second * 1000 + F.floor(fraction * 1000 + 0.5)
    return F.when(value.rlike(SHAPE), F.when(real, (wall - east).cast("bigint")))


def lenient_ms(value: Column) -> Column:
    """Strict first, then every writing known to :func:`instant` with UTC for missing zones, then a date alone (midnight UTC).

    Bare numbers are no times here: nothing says in which years they would have to lie.
    """
    day = F.when(value.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.concat(value, F.lit("T00:00:00Z")))
    return F.coalesce(strict_ms(value), instant(value, zone=F.lit("UTC")), strict_ms(day))


def parse_ms(value: Column, policy: str = "rfc3339") -> Column:
    if policy not in ("rfc3339", "lenient"):
        raise ValueError(f"unknown timestamp policy {policy!r}")
    return strict_ms(value) if policy == "rfc3339" else lenient_ms(value)
