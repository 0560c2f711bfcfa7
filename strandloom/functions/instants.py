"""Any writing of a time to one UTC instant in epoch milliseconds.

All formats are one regex alternation with named groups. One ``regexp_replace`` turns a value into its components, which
are range-checked and assembled by integer day arithmetic; only wall times of a named zone go through the zone rules.
Everything stays in JVM expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names as written in dates.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "LHST": 630, "LHDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300,
    "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480,
    "HST": -600, "BRT": -180,
}

_MON = "|".join(MONTHS)
_DATE = "|".join(
    [
        r"(?<isoY>\d{4})-(?<isoM>\d{2})-(?<isoD>\d{2})",
        r"(?<ordY>\d{4})-(?<ordN>\d{3})",
        r"(?<basY>\d{4})(?<basM>\d{2})(?<basD>\d{2})",
        r"(?<dotD>\d{1,2})\.(?<dotM>\d{1,2})\.(?<dotY>\d{4})",
        r"(?<slaA>\d{1,2})/(?<slaB>\d{1,2})/(?<slaY>\d{4})",
        rf"(?:[a-z]{{3,9}},? +)?(?<rfcD>\d{{1,2}})[ -](?<rfcM>{_MON})[a-z]*\.?[ -](?<rfcY>\d{{4}})",
        rf"(?<lonM>{_MON})[a-z]*\.? (?<lonD>\d{{1,2}}),? (?<lonY>\d{{4}})",
    ]
)
_TIME = (
    r"(?:(?<h>\d{1,2}):(?<mi>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d+))?)?"
    r"|(?<bh>\d{2})(?<bmi>\d{2})(?:(?<bs>\d{2})(?:[.,](?<bf>\d+))?)?)"
)
_ZONE = (
    r"(?: ?(?:utc|gmt)?(?<off>[+-]\d{2}(?::?\d{2})?))?"
    r"(?: ?(?:\[(?<brk>[A-Za-z][\w+/-]*)\]|(?<nam>[A-Za-z][\w/-]*)))?"
)
PATTERN = rf"(?i)\A(?:(?:{_DATE})(?:t|,? +){_TIME}(?: ?(?<ap>[ap])\.?m\.?(?![a-z]))?{_ZONE}|(?<num>\d+)(?:\.(?<nf>\d+))?)\z"
_SEP = "\u0001"
_SLOTS = {
    "year": "${isoY}${ordY}${basY}${dotY}${slaY}${rfcY}${lonY}", "month": "${isoM}${basM}${dotM}", "day": "${isoD}${basD}${dotD}${rfcD}${lonD}",
    "name": "${rfcM}${lonM}", "nth": "${ordN}", "a": "${slaA}", "b": "${slaB}", "hour": "${h}${bh}", "minute": "${mi}${bmi}",
    "second": "${s}${bs}", "fraction": "${f}${bf}", "half": "${ap}", "offset": "${off}", "zone": "${brk}${nam}", "number": "${num}", "rest": "${nf}",
}
CANONICAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"


@dataclass(frozen=True)
class EpochRange:
    """Bare numbers are taken as an instant only within these years; their size tells the unit."""

    first_year: int
    last_year: int

    def bounds(self) -> tuple[int, int]:
        return days_of(self.first_year, 1, 1) * 86_400_000, days_of(self.last_year + 1, 1, 1) * 86_400_000


def days_of(year: int, month: int, day: int) -> int:
    """Days from 1970-01-01, by the same arithmetic as the column form."""
    y = year - (month <= 2)
    return y // 400 * 146097 + (y % 400) * 365 + (y % 400) // 4 - (y % 400) // 100 + (153 * ((month + 9) % 12) + 2) // 5 + day - 1 - 719468


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _div(a: Column, b: int) -> Column:
    """Integer division rounding down."""
    return F.floor(a / b).cast("int")


def _day_number(y: Column, m: Column, d: Column) -> Column:
    yy = y - F.when(m <= 2, 1).otherwise(0)
    of_era, shifted = F.pmod(yy, F.lit(400)), F.pmod(m + 9, F.lit(12))
    return _div(yy, 400) * 146097 + of_era * 365 + _div(of_era, 4) - _div(of_era, 100) + _div(shifted * 153 + 2, 5) + d - 1 - 719468


def epoch_ms(n: Column) -> Column:
    """BIGINT seconds, milli-, micro- or nanoseconds to milliseconds (rounded half up); the size tells the unit."""
    half_up = lambda unit: (n - F.pmod(n, F.lit(unit))) / unit
    down = lambda unit: F.round(half_up(unit)).cast("bigint") + F.when(F.pmod(n, F.lit(unit)) * 2 >= unit, 1).otherwise(0)
    return F.when(F.abs(n) < 10**11, n * 1000).when(F.abs(n) < 10**14, n).when(F.abs(n) < 10**17, down(1000)).otherwise(down(1_000_000))


def observed_ms(column: str = "observed_at") -> Column:
    """A stored BIGINT time in any of the four units as epoch milliseconds; NULL stays NULL."""
    return epoch_ms(F.col(column).cast("bigint"))


def let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once: bound as a lambda variable, which the optimizer does not inline."""
    return F.transform(F.array(value), body)[0]


def instant(value: Column, *, zone: Column | None = None, date_order: Column | None = None, numbers: EpochRange | None = None) -> Column:
    """BIGINT: the instant that the text ``value`` names, or NULL if it names none.

    zone: IANA id of the clock a value without zone or offset was read from; NULL makes such values unresolvable.
    date_order: 'DMY' or 'MDY' for slashed dates; NULL counts as DMY. Empty texts, words, dates without a time of day,
    impossible dates and times and unknown zones give NULL. numbers: the years in which bare numbers may lie; without it a
    bare number names no instant. Wall times that occur twice mean the earlier instant, skipped
    ones take the offset in force before the change.
    """
    lo, hi = numbers.bounds() if numbers else (0, 0)
    zone = F.lit(None).cast("string") if zone is None else zone
    mdy = F.lit(False) if date_order is None else F.coalesce(date_order == "MDY", F.lit(False))
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    regions = sorted(x for x in available_timezones() if "/" in x)

    def components(p: Column) -> Column:
        part = {k: p[i + 1] for i, k in enumerate(_SLOTS)}
        first, second, name, half = _int(part["a"]), _int(part["b"]), F.lower(part["name"]), F.lower(part["half"])
        named_month = F.when(name != "", F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int"))
        month = F.coalesce(_int(part["month"]), named_month, F.when(mdy, first).otherwise(second))
        hour = _int(part["hour"])
        hour = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        off = F.regexp_replace(part["offset"], ":", "")
        off_h, off_m = _int(F.substring(off, 2, 2)), F.coalesce(_int(F.substring(off, 4, 2)), F.lit(0))
        minutes = F.when((off_h <= 23) & (off_m <= 59), (off_h * 60 + off_m) * F.when(off.startswith("-"), -1).otherwise(1))
        milli = lambda digits: F.coalesce(F.floor((F.rpad(F.substring(digits, 1, 4), 4, "0").cast("int") + 5) / 10).cast("int"), F.lit(0))
        has_off, own = off != "", F.when(part["zone"] != "", part["zone"])
        named = F.coalesce(own, zone)
        number = F.when(F.length(part["number"]).between(1, 19), part["number"].try_cast("bigint"))
        return F.struct(
            _int(part["year"]).alias("y"), month.alias("m"), F.coalesce(_int(part["day"]), F.when(mdy, second).otherwise(first)).alias("d"),
            _int(part["nth"]).alias("nth"), hour.alias("h"), _int(part["minute"]).alias("mi"), F.coalesce(_int(part["second"]), F.lit(0)).alias("s"),
            F.when(part["number"] == "", milli(part["fraction"])).otherwise(milli(part["rest"])).alias("ms"),
            F.when(has_off, minutes).when(own.isNotNull(), F.try_element_at(known, F.upper(own))).alias("fixed"),
            F.when(~has_off, F.when(F.upper(named).isin("UTC", "GMT", "Z"), F.lit("Etc/UTC")).otherwise(named)).alias("zone"),
            number.alias("n"),
        )

    def assembled(c: Column) -> Column:
        y, m, d, nth, n = c["y"], c["m"], c["d"], c["nth"], c["n"]
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        month_days = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        civil = F.when(m.between(1, 12) & (d >= 1) & (d <= month_days), _day_number(y, m, d))
        ordinal = F.when((nth >= 1) & (nth <= F.when(leap, 366).otherwise(365)), _day_number(y, F.lit(1), F.lit(1)) + nth - 1)
        clock = F.when((c["h"] <= 23) & (c["mi"] <= 59) & (c["s"] <= 59), (c["h"] * 3600 + c["mi"] * 60 + c["s"]) * F.lit(1000).cast("bigint") + c["ms"])
        local = F.when(nth.isNull(), civil).otherwise(ordinal) * F.lit(86_400_000).cast("bigint") + clock
        scaled = F.when(F.abs(n) < 10**11, n * 1000 + c["ms"]).otherwise(epoch_ms(n))
        in_zone = let(local, lambda x: F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(x), c["zone"])))
        return (
            F.when(n.isNotNull(), let(scaled, lambda x: F.when((x >= lo) & (x < hi), x)))
            .when(c["fixed"].isNotNull(), local - c["fixed"] * 60_000)
            .when(c["zone"].isin(regions), in_zone)
        )

    text = F.trim(F.translate(value, _SEP, ""))
    split = F.split(F.regexp_replace(text, PATTERN, _SEP.join(["@", *_SLOTS.values()])), _SEP)
    return let(split, lambda p: F.when(F.size(p) == len(_SLOTS) + 1, let(components(p), assembled)))


def is_canonical(value: Column) -> Column:
    return F.coalesce(value.rlike(CANONICAL), F.lit(False))
