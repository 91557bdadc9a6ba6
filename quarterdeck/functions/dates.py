"""Calendar expressions: quarters, weeks, federal business days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US federal holidays as published by the government.
# Dates moved to the nearest weekday, written month * 100 + day.
NEAREST_WEEKDAY = (101, 704, 1111, 1225)
JUNETEENTH, JUNETEENTH_SINCE = 619, 2021
# Mondays, written month * 10 + week of the month: Presidents, Labor, Columbus.
MONDAYS = (23, 91, 102)
MARTIN_LUTHER_KING, MARTIN_LUTHER_KING_SINCE = 13, 1986
THANKSGIVING_THURSDAY = 114
MEMORIAL_MONTH, MEMORIAL_FROM_DAY = 5, 25
_LONGEST_CLOSURE_DAYS = 6


def quarter_end(day: Column) -> Column:
    return F.last_day(F.make_date(F.year(day), F.quarter(day) * 3, F.lit(1)))


def is_quarter_end(day: Column) -> Column:
    return (F.last_day(day) == day) & (F.month(day) % 3 == 0)


def quarter_index(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day)


def quarters_between(earlier: Column, later: Column) -> Column:
    """Quarter boundaries crossed from ``earlier`` to ``later``."""
    return quarter_index(later) - quarter_index(earlier)


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit(" Q"), F.quarter(day).cast("string"))


def week_ending_friday(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 1), "Fri")


def is_federal_holiday(day: Column) -> Column:
    """True on the observed date of a US federal holiday."""
    weekday = F.dayofweek(day)  # Sunday is 1

    def is_fixed(when: Column) -> Column:
        code = F.month(when) * 100 + F.dayofmonth(when)
        return code.isin(*NEAREST_WEEKDAY) | (
            (code == JUNETEENTH) & (F.year(when) >= JUNETEENTH_SINCE)
        )

    week_code = F.month(day) * 10 + F.ceil(F.dayofmonth(day) / 7)
    monday = (
        week_code.isin(*MONDAYS)
        | ((week_code == MARTIN_LUTHER_KING) & (F.year(day) >= MARTIN_LUTHER_KING_SINCE))
        | ((F.month(day) == MEMORIAL_MONTH) & (F.dayofmonth(day) >= MEMORIAL_FROM_DAY))
        | is_fixed(F.date_sub(day, 1))
    )
    return (
        (weekday.between(2, 6) & is_fixed(day))
        | ((weekday == 2) & monday)
        | ((weekday == 5) & (week_code == THANKSGIVING_THURSDAY))
        | ((weekday == 6) & is_fixed(F.date_add(day, 1)))
    )


def is_business_day(day: Column) -> Column:
    return F.dayofweek(day).between(2, 6) & ~is_federal_holiday(day)


def next_business_day(day: Column) -> Column:
    """``day`` itself when it is a business day, else the first one after it."""
    candidates = F.sequence(day, F.date_add(day, _LONGEST_CLOSURE_DAYS))
    return F.filter(candidates, is_business_day)[0]


def filing_deadline(period: Column, lag_days: int = 45) -> Column:
    return next_business_day(F.date_add(period, lag_days))


def parse_date(text: Column, pattern: str = "dd-MMM-yyyy", lenient: bool = False) -> Column:
    if lenient:
        return F.try_to_date(text, pattern)
    return F.to_date(text, pattern)
