"""The ten indicators together against each of them by itself."""

import pytest

from tests.builders import trip, trips
from tests.conftest import SMALL
from tripmart.plans.indicators import INDICATORS
from tripmart.plans.marts import indicator_builders, monthly_measures, trip_cells
from tripmart.testbed import tables
from tripmart.testbed.layout import trips_table


def near(left, right) -> bool:
    """Two decimals are shown; sums added in another order may round to the next one."""
    return left == right or (isinstance(left, float) and isinstance(right, float) and abs(left - right) < 0.0101)


def same(left, right) -> bool:
    def labels(row) -> list[str]:  # ties in the shown order are sorted by what else the row says
        return [str(v) for v in row if not isinstance(v, float)]

    left, right = sorted(left, key=labels), sorted(right, key=labels)
    return len(left) == len(right) and all(
        len(a) == len(b) and all(map(near, a, b)) for a, b in zip(left, right, strict=True)
    )


def check(data, zones, folder):
    built = indicator_builders(data, zones, folder)
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


def test_three_passes(spark, tmp_path):
    data = trips_table(spark, SMALL)
    folder = str(tmp_path / "cells")
    built = indicator_builders(data, tables.zones(spark, SMALL), folder)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (monthly_measures(data), trip_cells(data))]
    plans += [build()._jdf.queryExecution().executedPlan().toString() for build in built.values()]
    scans = [sum("trips_tbl" in line for line in plan.split("== Initial Plan ==")[0].splitlines() if "FileScan" in line) for plan in plans]
    assert sum(scans) == 3 and scans[:2] == [1, 1]
