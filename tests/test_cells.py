"""The ten indicators from cells against each of them by itself, and against themselves with rows dealt otherwise."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.builders import trip, trips
from tests.conftest import SMALL
from tests.test_marts import same
from tripmart.plans.indicators import INDICATORS
from tripmart.plans.cells import exact_indicators, indicators_of, trip_cells, zone_cells
from tripmart.testbed import tables
from tripmart.testbed.layout import trips_table


# The indicators that show sums and means.
MEANS = ("ind_02_ingreso_mensual", "ind_04_viaje_tipico_mensual", "ind_06_propina_mensual", "ind_09_velocidad_por_hora")


def check(data, zones, folder):
    built = exact_indicators(data, zones, folder)
    assert list(built) == list(INDICATORS)
    for name, build in built.items():
        direct, added = INDICATORS[name](data, zones), build()
        assert added.dtypes == direct.dtypes, name
        assert same(added.collect(), direct.collect()), name


def test_together_they_are_the_same(spark, tmp_path):
    check(trips_table(spark, SMALL), tables.zones(spark, SMALL), str(tmp_path / "cells"))


@pytest.mark.parametrize("rows", [
    [],
    [trip(fare_amount=0.0), trip(fare_amount=None), trip(pickup_ts=None)],
    [trip(), trip(tip_amount=None), trip(payment_type=None), trip(payment_type=2, tip_amount=0.0), trip(trip_distance=0.0)],
    [trip(pu_location_id=None), trip(src_month=2), trip(tip_amount=0.0, taxi_type="green")],
], ids=["empty", "none kept", "nulls", "mixed"])
def test_edge_rows(spark, tmp_path, rows):
    check(trips(spark, rows), tables.zones(spark, SMALL), str(tmp_path / "cells"))


def test_two_passes(spark, tmp_path):
    data = trips_table(spark, SMALL)
    folder = str(tmp_path / "cells")
    built = exact_indicators(data, tables.zones(spark, SMALL), folder)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (trip_cells(data), zone_cells(data))]
    plans += [build()._jdf.queryExecution().executedPlan().toString() for build in built.values()]
    scans = [sum("trips_tbl" in line for line in plan.split("== Initial Plan ==")[0].splitlines() if "FileScan" in line) for plan in plans]
    assert sum(scans) == 2 and scans[:2] == [1, 1]


def test_same_bits_however_rows_are_dealt(spark, tmp_path):
    """Ten deals of the rows to tasks; cells merged from parts of each."""
    data, zones, seen = trips_table(spark, SMALL).drop("filename"), tables.zones(spark, SMALL), set()
    for deal in range(10):
        dealt = data.repartition(1 + 3 * deal, F.rand(deal))
        marked = dealt.withColumn("half", F.rand(deal + 50) < 0.5)
        halves = [marked.where(F.col("half") == side).drop("half") for side in (True, False)]
        stored = []
        for make in (trip_cells, zone_cells):
            path = str(tmp_path / f"{make.__name__}-{deal}")
            reduce(DataFrame.unionByName, map(make, halves)).write.parquet(path)
            stored.append(spark.read.parquet(path))
        built = indicators_of(*stored, zones)
        seen.add(repr([built[name]().collect() for name in MEANS]))
    assert len(seen) == 1
