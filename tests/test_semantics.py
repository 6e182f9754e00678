import math
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripmart.functions import semantics as sem

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def pairs(spark, values, expression):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a timestamp_ntz, b timestamp_ntz")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("a"), F.col("b"))).collect()]


def test_rounding_ties(spark):
    values = [1.005, 2.675, 1.115, 0.285, 123456.785, -1.005, -2.5, None, float("inf")]
    expected = [1.0, 2.68, 1.12, 0.28, 123456.79, -1.0, -2.5, None, float("inf")]
    assert column(spark, values, "double", lambda x: sem.round_to(x, 2)) == expected
    assert column(spark, [0.5, 1.5, -0.5], "double", lambda x: sem.round_to(x, 0)) == [1.0, 2.0, -1.0]


def _scaled_round(x, digits):
    scaled = x * 10**digits
    whole = math.floor(abs(scaled))
    return math.copysign(whole + (abs(scaled) - whole >= 0.5), scaled) / 10**digits


@FEW
@given(st.lists(st.floats(-1e7, 1e7), min_size=1, max_size=200), st.integers(0, 3))
def test_rounding_matches_model(spark, values, digits):
    got = column(spark, values, "double", lambda x: sem.round_to(x, digits))
    assert got == [_scaled_round(v, digits) for v in values]


@FEW
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200))
def test_half_even_matches_model(spark, values):
    assert column(spark, values, "double", sem.to_int_half_even) == [round(v) for v in values]


def test_half_even_ties(spark):
    assert column(spark, [0.5, 1.5, 2.5, -0.5, None], "double", sem.to_int_half_even) == [0, 2, 2, 0, None]


STAMPS = st.datetimes(datetime(1900, 1, 1), datetime(2060, 1, 1))


@FEW
@given(st.lists(st.tuples(STAMPS, STAMPS), min_size=1, max_size=100))
def test_differences_count_boundaries(spark, values):
    epoch = datetime(1970, 1, 1)

    def units(ts, size):
        return (ts - epoch) // size

    for size, between in ((timedelta(seconds=1), sem.seconds_between), (timedelta(hours=1), sem.hours_between)):
        assert pairs(spark, values, between) == [units(b, size) - units(a, size) for a, b in values]


@FEW
@given(st.lists(STAMPS, min_size=1, max_size=100))
def test_calendar_fields(spark, values):
    def fields(ts):
        return F.struct(sem.hour_of_day(ts), sem.day_of(ts), sem.iso_weekday(ts), sem.day_name(ts))

    got = [tuple(r) for r in column(spark, values, "timestamp_ntz", fields)]
    assert got == [(v.hour, v.date(), v.isoweekday(), v.strftime("%A")) for v in values]


def test_boundary_dates(spark):
    midnight = (datetime(2024, 1, 1, 23, 59, 59), datetime(2024, 1, 2))
    sub_second = (datetime(2024, 1, 1, 0, 0, 0, 900000), datetime(2024, 1, 1, 0, 0, 1, 100000))
    long = (datetime(2024, 1, 1, 0, 59, 59), datetime(2024, 1, 2, 1, 0, 0))
    assert pairs(spark, [midnight, sub_second, long], sem.seconds_between)[:2] == [1, 1]
    assert pairs(spark, [midnight, sub_second, long], sem.hours_between) == [1, 0, 25]


def test_session_zone_does_not_matter(spark):
    """On 2024-03-10 New York skips 02:00 to 03:00; times without zone do not."""
    across = [(datetime(2024, 3, 10, 1, 30), datetime(2024, 3, 10, 3, 30))]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert pairs(spark, across, sem.seconds_between) == [7200]
        assert pairs(spark, across, lambda a, b: sem.hour_of_day(b)) == [3]
        assert pairs(spark, across, lambda a, b: sem.day_of(b)) == [across[0][1].date()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_speed_of_zero_minutes(spark):
    assert column(spark, [0.0, 30.0], "double", lambda m: sem.speed_mph(F.lit(5.0), m)) == [float("inf"), 10.0]
