"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, in calendar order.
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December",
]

# Names of the time frames and the unit each one truncates to.
TIMEFRAMES = {"Daily": "day", "Weekly": "week", "Monthly": "month", "Yearly": "year"}

COHORT_WEEKS = 12


def month_name(month: Column) -> Column:
    """1..12 to the full name; any other number (0 is an opening balance) to null."""
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), month.cast("int") - 1)


def month_number(month: Column) -> Column:
    """Full or three-letter name in any case, or a number, to 1..12; anything else is an error."""
    pairs = []
    for number, name in enumerate(MONTHS, start=1):
        for spelling in {name.lower(), name[:3].lower()}:
            pairs += [F.lit(spelling), F.lit(number)]
    text = month.cast("string")
    found = F.coalesce(
        F.try_element_at(F.create_map(*pairs), F.lower(text)),
        text.try_cast("double").cast("int"),
    )
    unknown = F.raise_error(F.concat(F.lit("not a month: "), text)).cast("int")
    return F.when(month.isNull() | found.isNotNull(), found).otherwise(unknown)


def day_of_month(date: Column) -> Column:
    return F.dayofmonth(date)


def day_name(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def period_label(year: Column, month: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def period_start(date: Column, timeframe: str) -> Column:
    """First day of the period; weeks start on Monday, an unknown frame means days."""
    return F.trunc(date, TIMEFRAMES[timeframe]) if timeframe in TIMEFRAMES and timeframe != "Daily" \
        else date.cast("date")


def relative_week(start: Column, current: Column, weeks: int = COHORT_WEEKS) -> Column:
    """Week 1..weeks after start, else null. Floors, so the day before start is not week 1."""
    week = (F.floor(F.datediff(current, start) / 7) + 1).cast("int")
    return F.when(week.between(1, weeks), week)
