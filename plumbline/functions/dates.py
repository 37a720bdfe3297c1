"""Date functions over naive UTC dates and timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.nulls import col

#: Units and their Spark names: fixed values.
UNITS = {
    "YEARS": "YEAR", "QUARTERS": "QUARTER", "MONTHS": "MONTH", "WEEKS": "WEEK", "DAYS": "DAY", "HOURS": "HOUR", "MINUTES": "MINUTE",
    "SECONDS": "SECOND", "MILLISECONDS": "MILLISECOND", "MICROSECONDS": "MICROSECOND",
}
_SECONDS = {"WEEKS": 604_800, "DAYS": 86_400, "HOURS": 3_600, "MINUTES": 60, "SECONDS": 1}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _ntz(d) -> Column:
    return col(d).cast("timestamp_ntz")


def _micros(d) -> Column:
    return F.unix_micros(col(d).cast("timestamp"))


def year(d) -> Column:
    return F.year(col(d)).cast("bigint")


def month_number(d) -> Column:
    return F.month(col(d)).cast("bigint")


def month(d) -> Column:
    return F.date_format(col(d), "MMMM")


def quarter_number(d) -> Column:
    return F.quarter(col(d)).cast("bigint")


quarter = quarter_number


def week_of_year(d) -> Column:
    return F.weekofyear(col(d)).cast("bigint")


def day_of_month(d) -> Column:
    return F.dayofmonth(col(d)).cast("bigint")


def day_of_year(d) -> Column:
    return F.dayofyear(col(d)).cast("bigint")


def day_of_week(d) -> Column:
    return F.date_format(col(d), "EEEE")


def day_of_week_number(d, first: str = "Monday") -> Column:
    """1 to 7, counted from the given first day."""
    return ((F.weekday(col(d)) + 7 - WEEKDAYS.index(first)) % 7 + 1).cast("bigint")


def hour(d) -> Column:
    return F.hour(col(d)).cast("bigint")


def minute(d) -> Column:
    return F.minute(col(d)).cast("bigint")


def second(d) -> Column:
    return F.second(col(d)).cast("bigint")


def date(y, m=None, d=None, h=None, mi=None, s=None) -> Column | str:
    """A date or timestamp; without a day a partial date, which is its ISO text."""
    if d is None:
        parts = [F.lpad(col(y).cast("string"), 4, "0")] + ([] if m is None else [F.lpad(col(m).cast("string"), 2, "0")])
        return F.concat_ws("-", *parts)
    if h is None:
        return F.make_date(col(y), col(m), col(d))
    return F.make_timestamp_ntz(col(y), col(m), col(d), col(h), col(0 if mi is None else mi), col(0 if s is None else s).cast("decimal(8,6)"))


def date_part(d) -> Column:
    return F.to_date(col(d))


def _start(unit: str, d) -> Column:
    return F.date_trunc(unit, col(d)).cast("timestamp_ntz")


def first_day_of_year(d) -> Column:
    return _start("year", d).cast("date")


def first_day_of_quarter(d) -> Column:
    return _start("quarter", d).cast("date")


def first_day_of_month(d) -> Column:
    return _start("month", d).cast("date")


def first_day_of_week(d) -> Column:
    return _start("week", d).cast("date")


def first_hour_of_day(d) -> Column:
    return _start("day", d)


def first_minute_of_hour(d) -> Column:
    return _start("hour", d)


def first_second_of_minute(d) -> Column:
    return _start("minute", d)


def first_millisecond_of_second(d) -> Column:
    return _start("second", d)


def today() -> Column:
    return F.current_date()


def now() -> Column:
    return F.localtimestamp()


def first_day_of_this_year() -> Column:
    return first_day_of_year(today())


def first_day_of_this_quarter() -> Column:
    return first_day_of_quarter(today())


def first_day_of_this_month() -> Column:
    return first_day_of_month(today())


def most_recent_day_of_week(day: str, d=None) -> Column:
    """The last such weekday up to and including the date."""
    return F.next_day(F.date_sub(F.to_date(col(today() if d is None else d)), 7), day[:3])


def previous_day_of_week(day: str, d=None) -> Column:
    """The last such weekday before the date."""
    return F.next_day(F.date_sub(F.to_date(col(today() if d is None else d)), 8), day[:3])


def is_on_day(a, b) -> Column:
    return F.to_date(col(a)) == F.to_date(col(b))


def is_after_day(a, b) -> Column:
    return F.to_date(col(a)) > F.to_date(col(b))


def is_before_day(a, b) -> Column:
    return F.to_date(col(a)) < F.to_date(col(b))


def is_on_or_after_day(a, b) -> Column:
    return F.to_date(col(a)) >= F.to_date(col(b))


def is_on_or_before_day(a, b) -> Column:
    return F.to_date(col(a)) <= F.to_date(col(b))


def adjust(d, amount, unit: str, is_date: bool = False) -> Column:
    """Move by an amount; a date moved by days or more stays a date."""
    moved = F.timestamp_add(UNITS[unit], col(amount).cast("int"), col(d).cast("timestamp")).cast("timestamp_ntz")
    return moved.cast("date") if is_date and unit in ("YEARS", "QUARTERS", "MONTHS", "WEEKS", "DAYS") else moved


adjust_temporal = adjust


def date_diff(a, b, unit: str) -> Column:
    """From a to b. Years, months, days: boundaries crossed; weeks: Sundays crossed; shorter units: whole ones elapsed."""
    day_a, day_b = F.to_date(col(a)), F.to_date(col(b))
    if unit == "YEARS":
        return (F.year(day_b) - F.year(day_a)).cast("bigint")
    months = 12 * (F.year(day_b) - F.year(day_a)) + F.month(day_b) - F.month(day_a)
    if unit == "MONTHS":
        return months.cast("bigint")
    if unit == "QUARTERS":
        return (4 * (F.year(day_b) - F.year(day_a)) + F.quarter(day_b) - F.quarter(day_a)).cast("bigint")
    if unit == "DAYS":
        return F.datediff(day_b, day_a).cast("bigint")
    if unit == "WEEKS":
        back = F.when(day_b < day_a, 1).otherwise(0)
        sundays = lambda d: F.floor((F.datediff(d, F.lit("0001-01-07").cast("date")) - back) / 7)
        return (sundays(day_b) - sundays(day_a)).cast("bigint")
    elapsed = _micros(b) - _micros(a)
    size = {"HOURS": 3_600_000_000, "MINUTES": 60_000_000, "SECONDS": 1_000_000, "MILLISECONDS": 1_000, "MICROSECONDS": 1}[unit]
    return ((elapsed - elapsed % size) / size).cast("bigint")  # exact: the rest is taken off first


def time_bucket(d, quantity: int, unit: str, is_date: bool = False) -> Column:
    """Start of the bucket; weeks count from Monday 1969-12-29, every other unit from 1970-01-01."""
    if unit in ("YEARS", "QUARTERS", "MONTHS"):
        width = quantity * {"YEARS": 12, "QUARTERS": 3, "MONTHS": 1}[unit]
        number = (F.year(col(d)) - 1970) * 12 + F.month(col(d)) - 1
        start = F.add_months(F.lit("1970-01-01").cast("date"), (F.floor(number / width) * width).cast("int"))
    elif is_date and unit in ("HOURS", "MINUTES", "SECONDS"):
        return F.raise_error(F.lit(f"Unsupported duration unit {unit} for a date without time")).cast("date")
    else:
        origin = -3 * 86_400 if unit == "WEEKS" else 0
        width = (quantity * _SECONDS[unit]) * 1_000_000
        micros = _micros(d) - origin * 1_000_000
        start = F.timestamp_micros((micros - F.pmod(micros, F.lit(width))) + origin * 1_000_000)
    return start.cast("date") if is_date else start.cast("timestamp_ntz")


def to_epoch_value(d, unit: str = "SECONDS") -> Column:
    return date_diff(F.lit("1970-01-01").cast("timestamp"), d, unit)


def from_epoch_value(value, unit: str = "SECONDS") -> Column:
    return adjust(F.lit("1970-01-01").cast("timestamp"), value, unit)


def format_date(d, pattern: str) -> Column:
    return F.date_format(col(d), pattern)


def convert_date_format(s, pattern: str = "yyyy-MM-dd") -> Column:
    return F.to_date(col(s), pattern)


def convert_date_time_format(s, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.to_timestamp(col(s), pattern).cast("timestamp_ntz")


parse_date_format = convert_date_time_format


def convert_time_zone_format(d, zone: str, pattern: str) -> Column:
    return F.date_format(F.from_utc_timestamp(col(d).cast("timestamp"), zone), pattern)


_PARTIAL = re.compile(r"%?(\d{4})(?:-(\d\d))?(?:-(\d\d))?(?:T(\d\d)(?::(\d\d))?(?::(\d\d)(?:\.(\d+))?)?)?")


class DateLiteral:
    """A literal with the precision it was written in; the `has...` functions are facts about that text."""

    def __init__(self, text: str):
        m = _PARTIAL.fullmatch(text.removesuffix("+0000"))
        if not m:
            raise ValueError(f"not a date: {text}")
        self.parts = m.groups()

    def _has(self, k: int) -> Column:
        return F.lit(self.parts[k] is not None)

    def column(self) -> Column:
        y, m, d, h, mi, s, f = self.parts
        if d is None:
            return F.lit("-".join(p for p in (y, m) if p))
        if h is None:
            return F.lit(f"{y}-{m}-{d}").cast("date")
        return F.lit(f"{y}-{m}-{d} {h}:{mi or '00'}:{s or '00'}.{f or '0'}").cast("timestamp_ntz")


def has_month(d: DateLiteral) -> Column:
    return d._has(1)


def has_day(d: DateLiteral) -> Column:
    return d._has(2)


def has_hour(d: DateLiteral) -> Column:
    return d._has(3)


def has_minute(d: DateLiteral) -> Column:
    return d._has(4)


def has_second(d: DateLiteral) -> Column:
    return d._has(5)


def has_subsecond(d: DateLiteral) -> Column:
    return d._has(6)


def has_subsecond_with_at_least_precision(d: DateLiteral, precision: int) -> Column:
    return F.lit(d.parts[6] is not None and len(d.parts[6]) >= precision)


def max_(*dates) -> Column:
    return F.greatest(*map(col, dates))


def min_(*dates) -> Column:
    return F.least(*map(col, dates))
