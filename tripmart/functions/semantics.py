"""Column helpers for rules in which Spark's defaults differ from the results to match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Round a double by scaling it first; ties go away from zero.

    ``F.round(value, digits)`` works on the decimal text instead: 1.005 gives 1.01 there, 1.0 here.
    """
    scale = float(10**digits)
    return F.round(value.cast("double") * F.lit(scale)) / F.lit(scale)


def to_int_half_even(value: Column) -> Column:
    """Double to integer, rounding ties to the even neighbour (a plain cast truncates)."""
    return F.rint(value).cast("int")


# Times without zone are counted in UTC seconds, so plain arithmetic gives their calendar fields. It is
# several times faster than year(), hour() and the like, which build a date-time object for each call.


def whole_seconds(ts: Column) -> Column:
    """Seconds since the epoch, rounded down, before 1970 too."""
    cut = F.unix_timestamp(ts)  # without a zone, but towards zero
    below = (cut <= 0) & (ts < F.lit("1970-01-01").cast("timestamp_ntz")) & (F.date_part(F.lit("SECOND"), ts) % 1 != 0)
    return cut - F.when(below, 1).otherwise(0)


def seconds_between(start: Column, end: Column) -> Column:
    """Number of second boundaries crossed: 0.9 s to 1.1 s counts as one."""
    return whole_seconds(end) - whole_seconds(start)


def hour_number(ts: Column) -> Column:
    """Hours since the epoch."""
    return F.floor(whole_seconds(ts) / F.lit(3600))


def hours_between(start: Column, end: Column) -> Column:
    """Number of hour boundaries crossed: 00:59:59 to 01:00:00 counts as one."""
    return hour_number(end) - hour_number(start)


def hour_of_day(ts: Column) -> Column:
    return F.pmod(hour_number(ts), F.lit(24)).cast("int")


def day_of(ts: Column) -> Column:
    """Calendar day as DATE."""
    return F.date_from_unix_date(F.floor(whole_seconds(ts) / F.lit(86400)).cast("int"))


def iso_weekday(ts: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(day_of(ts)) + F.lit(1)


def day_name(ts: Column) -> Column:
    """Full English weekday name."""
    return F.date_format(ts, "EEEE")


def in_month(ts: Column, year: Column, month: Column) -> Column:
    """Does the time lie in that month? NULL where a part is NULL."""
    day = day_of(ts)
    return (F.year(day) == year) & (F.month(day) == month)


def period_start(year: Column, month: Column) -> Column:
    """First day of the month as DATE."""
    return F.make_date(year, month, F.lit(1))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole in double arithmetic; NULL when the whole is zero."""
    return F.try_divide(F.lit(100.0) * part, whole.cast("double"))


def speed_mph(distance: Column, minutes: Column) -> Column:
    """Miles per hour. A trip inside one second has zero minutes and infinite speed."""
    hours = minutes / F.lit(60.0)
    return F.when(hours == 0, F.lit(float("inf"))).otherwise(F.try_divide(distance, hours))
