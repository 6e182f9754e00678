"""Sums of doubles that do not depend on the order in which they are added.

Adding doubles rounds at every step, so a sum depends on how rows are dealt to tasks. Here each value is split into three
whole numbers, its digits in steps of 2^-8, 2^-36 and 2^-64, and those are added as longs, which is exact. Parts of a sum may be stored
and merged in any grouping: the total's last bit stays the same. A value of which digits below 2^-64 remain (a magnitude under 2^-12)
is rounded to that step by itself, again alike in every order.

Values beyond 2^45, infinite ones and NaN have no such digits; they are added as doubles in a fourth part. Each of the lower parts
holds 2^36 rows before a long overflows, which ANSI mode reports as an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = (8, 36, 64)  # binary places of the three parts
LARGEST = float(2**45)
PARTS = ("a", "b", "c", "x")


def parts_of(name: str) -> list[str]:
    """The columns that hold a stored sum."""
    return [f"{name}__{part}" for part in PARTS]


def _is_ordinary(value: Column) -> Column:
    return F.abs(value) < F.lit(LARGEST)  # not so for NaN, which Spark takes for the greatest number


def split(value: Column, name: str) -> list[Column]:
    """The parts of one value, to be summed under the names of ``parts_of``; NULL has NULL parts."""
    ordinary = F.when(_is_ordinary(value), value)
    digits, rest, columns = [], ordinary, []
    for step in STEPS:
        scale = float(2**step)
        whole = F.rint(rest * F.lit(scale))
        digits.append(whole.cast("long"))
        rest = rest - whole / F.lit(scale)  # exact: both are multiples of the value's last place
    wild = F.when(~_is_ordinary(value), value)
    for part, column in zip(parts_of(name), [*digits, wild], strict=True):
        columns.append(column.alias(part))
    return columns


def summed(name: str) -> list[Column]:
    """Aggregates that add up parts; applied to values split before, or to sums stored before."""
    return [F.sum(part).alias(part) for part in parts_of(name)]


def total(name: str) -> Column:
    """The double nearest to the sum; NULL where there was no value."""
    a, b, c, wild = (F.col(part) for part in parts_of(name))
    (first, second, third) = STEPS
    # 126 bits at most: a long times 2^56
    whole = F.expr(
        f"CAST(`{name}__a` AS DECIMAL(19, 0)) * CAST({2 ** (third - first)} AS DECIMAL(18, 0))"
        f" + CAST(`{name}__b` AS DECIMAL(19, 0)) * CAST({2 ** (third - second)} AS DECIMAL(18, 0)) + CAST(`{name}__c` AS DECIMAL(19, 0))"
    )
    exact = whole.cast("double") / F.lit(float(2**third))
    return F.when(wild.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + wild)


def mean(name: str, count: Column) -> Column:
    """The mean of ``count`` values; NULL where there is none."""
    return F.try_divide(total(name), count)
