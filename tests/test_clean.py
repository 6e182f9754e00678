from datetime import datetime, timedelta

from tests.builders import GOOD, trip, trips
from tripmart.operators.clean import clean_trips
from tripmart.plans.eda import rule_report
from tripmart.plans.indicators import monthly_quality

START = GOOD["pickup_ts"]
EDGES = [
    (trip(), True),
    (trip(pickup_ts=datetime(2024, 2, 1), dropoff_ts=datetime(2024, 2, 1, 1)), False),
    (trip(dropoff_ts=START), False),
    (trip(dropoff_ts=START + timedelta(seconds=21600)), True),
    (trip(dropoff_ts=START + timedelta(seconds=21601)), False),
    (trip(dropoff_ts=START + timedelta(microseconds=5)), True),
    (trip(trip_distance=0.0), False),
    (trip(trip_distance=100.0), True),
    (trip(trip_distance=100.01), False),
    (trip(fare_amount=0.0), False),
    (trip(fare_amount=0.01), True),
    (trip(total_amount=0.0), False),
    (trip(total_amount=1000.0), True),
    (trip(total_amount=1000.01), False),
    (trip(passenger_count=None, payment_type=9), True),
    (trip(src_year=2024, src_month=13), False),
    *[(trip(**{c: None}), False) for c in ("pickup_ts", "dropoff_ts", "trip_distance", "fare_amount", "total_amount", "src_year")],
]


def test_each_threshold(spark):
    rows = [{**row, "vendor_id": i} for i, (row, _) in enumerate(EDGES)]
    kept = {r["vendor_id"] for r in clean_trips(trips(spark, rows)).collect()}
    assert kept == {i for i, (_, keep) in enumerate(EDGES) if keep}


def test_report_counts_no_nulls_as_violations(spark):
    row = rule_report(trips(spark, [r for r, _ in EDGES])).first().asDict()
    assert row == {
        "taxi_type": "yellow", "registros": 22, "r1_fuera_de_periodo": 2, "r2_llegada_no_posterior": 1,
        "r3_duracion_mayor_6h": 1, "r4_distancia_invalida": 2, "r5_tarifa_no_positiva": 1, "r6_total_invalido": 2,
        "registros_conservados": sum(keep for _, keep in EDGES),
    }


def test_duration_has_whole_seconds(spark):
    row = trip(dropoff_ts=START + timedelta(seconds=90, microseconds=999999))
    assert clean_trips(trips(spark, [row])).first()["duration_min"] == 1.5


def test_month_without_kept_rows_stays_in_quality(spark):
    row = monthly_quality(trips(spark, [trip(fare_amount=-1.0)])).first()
    assert (row["registros"], row["conservados"], row["pct_descartado"]) == (1, 0, 100.0)
