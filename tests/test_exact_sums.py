"""Exact sums against rational arithmetic."""

import math
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripmart.operators.exact_sums import STEPS, mean, split, summed, total


def result(spark, values, partitions=1):
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(partitions)
    sums = rows.select("v", *split(F.col("v"), "s")).agg(F.count("v").alias("n"), *summed("s"))
    return sums.select(total("s").alias("total"), mean("s", F.col("n")).alias("mean")).first()


@pytest.mark.parametrize("partitions", [1, 5])
def test_nearest_double_of_the_true_sum(spark, partitions):
    values = [0.1] * 10 + [1e13, 0.3, -1e13, 0.7, 2.5, -0.0, 123456.78] + [i / 100 for i in range(-500, 3000)]
    got = result(spark, values, partitions)
    assert got["total"] == math.fsum(values)
    assert got["mean"] == math.fsum(values) / len(values)


cents = st.integers(-(10**12), 10**12).map(lambda n: n / 100)
ordinary = st.floats(min_value=-(2.0**44), max_value=2.0**44, allow_nan=False).filter(lambda v: v == 0 or abs(v) >= 2.0**-12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(cents, ordinary), min_size=1, max_size=60))
def test_any_ordinary_values(spark, values):
    assert result(spark, values, 3)["total"] == float(sum(map(Fraction, values)))


def test_small_values_are_rounded_to_the_last_step(spark):
    tiny = 1.0 / 3 / 2**40
    step = Fraction(1, 2 ** STEPS[-1])
    assert result(spark, [tiny] * 7)["total"] == float(7 * round(Fraction(tiny) / step) * step)


def test_values_without_digits(spark):
    inf = float("inf")
    assert result(spark, [1.0, inf])["total"] == inf
    assert math.isnan(result(spark, [inf, -inf, 3.0])["total"])
    assert math.isnan(result(spark, [float("nan"), 3.0])["total"])
    assert result(spark, [1e300, 1.5])["total"] == 1e300 + 1.5


def test_null_and_empty(spark):
    assert tuple(result(spark, [None, 2.0])) == (2.0, 2.0)
    assert tuple(result(spark, [None])) == (None, None)
    assert tuple(result(spark, [])) == (None, None)
