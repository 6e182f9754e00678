"""Profiles merged from months against a profile of the rows themselves."""

import math

import pytest
from pyspark.sql import functions as F

from tests.builders import trip, trips
from tests.conftest import SMALL
from tripmart.operators.profile import profile
from tripmart.plans.exploration import PROFILED
from tripmart.plans.increments import Warehouse
from tripmart.plans.month_profiles import merged_profile, month_profiles
from tripmart.testbed.layout import trips_table

EXACT = ["column_name", "column_type", "min", "max", "count", "null_percentage"]


def near(a, b, share):
    return a == b or (a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=share))


def check(data, merged):
    want = {r["column_name"]: r for r in profile(data, PROFILED).collect()}
    got = {r["column_name"]: r for r in merged.collect()}
    assert set(got) == set(want)
    for name, row in got.items():
        assert [row[c] for c in EXACT] == [want[name][c] for c in EXACT]
        assert set(row.asDict()) == set(want[name].asDict())
        assert near(row["std"], want[name]["std"], 1e-9)
        if not name.endswith("_ts"):
            assert near(row["avg"], want[name]["avg"], 1e-9)
    return got


def test_any_months_without_a_scan(spark, tmp_path):
    data = trips_table(spark, SMALL)
    path = str(tmp_path / "profiles")
    month_profiles(data).write.parquet(path)
    stored = spark.read.parquet(path)
    got = check(data, merged_profile(stored))
    fare = [r[0] for r in data.select("fare_amount").collect()]
    distinct = len(set(fare))
    assert abs(got["fare_amount"]["approx_unique"] - distinct) < 0.05 * distinct
    for quartile, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        rank = sum(v <= float(got["fare_amount"][quartile]) for v in fare) / len(fare)
        assert abs(rank - p) < 0.03
    first = data.where("taxi_type = 'yellow'").agg(F.min("src_year")).first()[0]
    some = f"taxi_type = 'yellow' AND src_year <= {first + 1}"
    merged = merged_profile(stored.where(some))
    assert not any("trips_tbl" in f for f in merged.inputFiles())
    check(data.where(some), merged)


@pytest.mark.parametrize("rows", [
    [trip()], [trip(fare_amount=None, pickup_ts=None), trip(src_month=2, fare_amount=None, pickup_ts=None)],
    [trip(trip_distance=-0.0), trip(src_year=None, src_month=None, fare_amount=1e9), trip(src_month=3, fare_amount=1e9 + 1)],
], ids=["one", "nulls", "undated"])
def test_edges(spark, rows):
    data = trips(spark, rows)
    check(data, merged_profile(month_profiles(data)))


def test_no_rows(spark):
    assert merged_profile(month_profiles(trips(spark, []))).count() == 0


def test_warehouse_keeps_profiles(spark, tmp_path):
    warehouse = Warehouse.at(spark, str(tmp_path))
    first, second = ("yellow", 2024, 1), ("yellow", 2024, 2)
    rows = {first: [trip(), trip(fare_amount=7.5)], second: [trip(src_month=2, fare_amount=99.0)]}
    warehouse.trips.replace({first: "a"}, lambda months: trips(spark, rows[first]))
    assert warehouse.add_profiles() == [first]
    warehouse.trips.replace({first: "a", second: "b"}, lambda months: trips(spark, rows[second]))
    assert warehouse.add_profiles() == [second] and warehouse.add_profiles() == []
    check(warehouse.trips.read(), warehouse.profile())
    check(warehouse.trips.read([second]), warehouse.profile([second]))
    assert warehouse.profile().where(F.col("column_name") == "fare_amount").first()["max"] == "99.0"
