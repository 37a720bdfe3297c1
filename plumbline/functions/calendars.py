"""Fiscal-calendar aggregation: a value counts if its date stands in a relation to the report's end date.

Both dates are looked up in a calendar table; `d` are the columns of the value's date and `e` those of the end date. A
calendar has a row a day, so it is small and bounded, and both joins are broadcast.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Row = Callable[[str], Column]
Rule = Callable[[Row, Row, Column], Column]


def _when(condition: Callable[[Row, Row], Column], value: Callable[[Row, Column], Column] = lambda e, v: v) -> Rule:
    return lambda d, e, v: F.when(condition(d, e), value(e, v))


def _same(*names: str) -> Callable[[Row, Row], Column]:
    def condition(d: Row, e: Row) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & (d(n) == e(n))
        return out

    return condition


def _upto(*names: str, by: str) -> Callable[[Row, Row], Column]:
    return lambda d, e: _same(*names)(d, e) & (d(by) <= e(by))


def _last_year(*names: str, by: str | None = None, back: int = 0) -> Callable[[Row, Row], Column]:
    def condition(d: Row, e: Row) -> Column:
        out = (d("currentYear") == e("previousFiscalYear") - back) & _same(*names)(d, e)
        return out & (d(by) <= e(by)) if by else out

    return condition


def _weeks_since(name: str) -> Callable[[Row, Row], Column]:
    def condition(d: Row, e: Row) -> Column:
        end = F.when(e("date") == e("adjustedDate"), e("adjustedDate")).otherwise(e("previousBusinessDay"))
        return (d("date") >= e(name)) & (d("date") <= end)

    return condition


def _week(back: int, weekend: bool) -> Callable[[Row, Row], Column]:
    def condition(d: Row, e: Row) -> Column:
        more = F.when(e("shortNameWeekDay").isin("Sat", "Sun"), 1).otherwise(0) if weekend else F.lit(0)
        return d("fiscalWeekOffset") == e("fiscalWeekOffset") - back - more

    return condition


def _previous(unit: str, first: str, previous: str, day: str) -> Callable[[Row, Row], Column]:
    def condition(d: Row, e: Row) -> Column:
        year = F.when(e(first) == 1, e("previousFiscalYear")).otherwise(e("currentYear"))
        return (d("currentYear") == year) & (d(unit) == e(previous)) & (d(day) <= e(day))

    return condition


def _pma(d: Row, e: Row, v: Column) -> Column:
    first = (e("currentMonthNum") == 1) & (d("currentYear") == e("previousFiscalYear"))
    later = (e("currentMonthNum") > 1) & (d("currentYear") == e("currentYear")) & (d("currentMonthNum") <= e("previousFiscalMonth"))
    return F.when(first, v / 12).when(later, v / e("previousFiscalMonth"))


def _year_average(e: Row, v: Column) -> Column:
    return v / e("numberOfFiscalDaysInYear") * 5


def _pwa(d: Row, e: Row, v: Column) -> Column:
    last = e("fiscalDay") - e("fiscalDayOfWeek")
    first = (e("currentWeek") <= 5) & (d("currentYear") == e("previousFiscalYear"))
    later = (e("currentWeek") > 5) & (d("currentYear") == e("currentYear")) & (d("fiscalDay") <= last)
    return F.when(first, _year_average(e, v)).when(later, v / F.when(later, last) * 5)


#: Every calendar function: what a value counts for, or null where it doesn't.
RULES: dict[str, Rule] = {
    "reportEndDay": _when(_same("date")),
    "priorDay": _when(lambda d, e: d("date") == e("previousBusinessDay")),
    "wtd": _when(_upto("currentYear", "currentWeek", by="dayOfCalendarYear")),
    "mtd": _when(_upto("currentYear", "currentMonthNum", by="fiscalDay")),
    "qtd": _when(_upto("currentYear", "currentQuarterNum", by="fiscalDay")),
    "ytd": _when(_upto("currentYear", by="fiscalDay")),
    "cw": _when(_week(0, weekend=True)),
    "cw_fm": _when(_week(0, weekend=False)),
    "pw": _when(_week(1, weekend=True)),
    "pw_fm": _when(_week(1, weekend=False)),
    "pwtd": _when(lambda d, e: _week(1, weekend=False)(d, e) & (d("fiscalDayOfWeek") <= e("fiscalDayOfWeek"))),
    "pmtd": _when(_previous("currentMonthNum", "currentMonthNum", "previousFiscalMonth", "fiscalDayOfMonth")),
    "pqtd": _when(_previous("currentQuarterNum", "currentQuarterNum", "previousFiscalQuarter", "fiscalDayOfQuarter")),
    "pytd": _when(_last_year(by="fiscalDay")),
    "pywtd": _when(_last_year("currentWeek", by="fiscalDayOfWeek")),
    "pymtd": _when(_last_year("currentMonthNum", by="fiscalDayOfMonth")),
    "pyqtd": _when(_last_year("currentQuarterNum", by="fiscalDayOfQuarter")),
    "priorYear": _when(_last_year()),
    "CYMinus2": _when(_last_year(back=1)),
    "CYMinus3": _when(_last_year(back=2)),
    "p4wtd": _when(_weeks_since("prior4WeekDate")),
    "p12wtd": _when(_weeks_since("prior12WeekDate")),
    "p52wtd": _when(_weeks_since("prior52WeekDate")),
    "p4wa": _when(_weeks_since("prior4WeekDate"), lambda e, v: v / 4),
    "p12wa": _when(_weeks_since("prior12WeekDate"), lambda e, v: v / 12),
    "p52wa": _when(_weeks_since("prior52WeekDate"), lambda e, v: v / 52),
    "p12mtd": _when(lambda d, e: (d("date") > F.add_months(e("date"), -12)) & (d("date") <= e("date"))),
    "annualized": _when(_same("currentYear"), lambda e, v: v / (e("fiscalDay") / e("numberOfFiscalDaysInYear"))),
    "cme": _when(_same("currentYear", "currentMonthNum"), lambda e, v: v / (e("fiscalDay") / e("numberOfFiscalDaysInMonth"))),
    "pma": _pma,
    "pwa": _pwa,
    "pywa": _when(lambda d, e: (e("currentWeek") <= 5) & _last_year()(d, e), _year_average),
}


def with_calendar(df: DataFrame, calendar: DataFrame, date: Column, end: Column) -> DataFrame:
    """df with the calendar's columns of both dates, prefixed d__ and e__."""
    for prefix, key in (("d__", date), ("e__", end)):
        side = F.broadcast(calendar.select([F.col(c).alias(prefix + c) for c in calendar.columns]))
        df = df.join(side, key.cast("date") == side[f"{prefix}date"], "left")
    return df


def value(name: str, v: Column) -> Column:
    """What v counts for under a calendar function, over a frame made by with_calendar."""
    return RULES[name](lambda n: F.col(f"d__{n}"), lambda n: F.col(f"e__{n}"), v.cast("double"))


def plain_calendar(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """A calendar whose fiscal year is the calendar year and whose weekends are Saturday and Sunday; a row a day."""
    days = spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    date = F.col("date")
    weekday = F.weekday(date)
    business = F.when(weekday == 5, F.date_sub(date, 1)).when(weekday == 6, F.date_sub(date, 2)).otherwise(date)
    before = F.when(weekday == 0, F.date_sub(date, 3)).when(weekday == 6, F.date_sub(date, 2)).otherwise(F.date_sub(date, 1))
    quarter_start = F.trunc(date, "quarter")
    return days.select(
        "date",
        business.alias("adjustedDate"),
        before.alias("previousBusinessDay"),
        F.dayofyear(date).alias("fiscalDay"),
        (weekday + 1).alias("fiscalDayOfWeek"),
        F.dayofmonth(date).alias("fiscalDayOfMonth"),
        (F.datediff(date, quarter_start) + 1).alias("fiscalDayOfQuarter"),
        F.floor(F.datediff(date, F.lit("1969-12-29").cast("date")) / 7).cast("int").alias("fiscalWeekOffset"),
        F.year(date).alias("currentYear"),
        F.quarter(date).alias("currentQuarterNum"),
        F.month(date).alias("currentMonthNum"),
        (F.floor((F.dayofyear(date) - 1) / 7) + 1).cast("int").alias("currentWeek"),
        F.dayofyear(date).alias("dayOfCalendarYear"),
        (F.year(date) - 1).alias("previousFiscalYear"),
        F.quarter(F.add_months(date, -3)).alias("previousFiscalQuarter"),
        F.month(F.add_months(date, -1)).alias("previousFiscalMonth"),
        F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31))).alias("numberOfFiscalDaysInYear"),
        F.dayofmonth(F.last_day(date)).alias("numberOfFiscalDaysInMonth"),
        F.date_sub(date, 28).alias("prior4WeekDate"),
        F.date_sub(date, 84).alias("prior12WeekDate"),
        F.date_sub(date, 364).alias("prior52WeekDate"),
        F.date_format(date, "EEE").alias("shortNameWeekDay"),
    )
