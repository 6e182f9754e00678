"""Small hand-made trips and raw files."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from tripmart.sources.schema import TRIPS_SCHEMA

GOOD = {
    "taxi_type": "yellow", "vendor_id": 1, "pickup_ts": datetime(2024, 1, 10, 8, 0), "dropoff_ts": datetime(2024, 1, 10, 8, 30),
    "passenger_count": 1, "trip_distance": 5.0, "ratecode_id": 1, "pu_location_id": 10, "do_location_id": 20,
    "payment_type": 1, "fare_amount": 20.0, "tip_amount": 4.0, "tolls_amount": 0.0, "total_amount": 25.0,
    "src_year": 2024, "src_month": 1, "filename": "yellow_tripdata_2024-01.parquet",
}


def trip(**changes) -> dict:
    return {**GOOD, **changes}


def trips(spark, rows: list[dict]):
    return spark.createDataFrame([tuple(row[n] for n in TRIPS_SCHEMA.fieldNames()) for row in rows], TRIPS_SCHEMA)


def raw_table(taxi_type: str, year: int, month: int, rows: int = 3, **types) -> pa.Table:
    """Raw rows of one month; ``types`` overrides column types, a value of None drops the column."""
    prefix = {"yellow": "tpep", "green": "lpep"}[taxi_type]
    start = [datetime(year, month, 1, 6) + timedelta(hours=i) for i in range(rows)]
    columns = {
        "VendorID": ([1] * rows, pa.int32()),
        f"{prefix}_pickup_datetime": (start, pa.timestamp("us")),
        f"{prefix}_dropoff_datetime": ([t + timedelta(minutes=20) for t in start], pa.timestamp("us")),
        "passenger_count": ([1] * rows, pa.int64()),
        "trip_distance": ([2.5] * rows, pa.float64()),
        "RatecodeID": ([1] * rows, pa.int64()),
        "PULocationID": ([10] * rows, pa.int32()),
        "DOLocationID": ([20] * rows, pa.int32()),
        "payment_type": ([1] * rows, pa.int64()),
        "fare_amount": ([10.0] * rows, pa.float64()),
        "tip_amount": ([1.0] * rows, pa.float64()),
        "tolls_amount": ([0.0] * rows, pa.float64()),
        "total_amount": ([12.0] * rows, pa.float64()),
        "Airport_fee": ([1.75] * rows, pa.float64()),
    }
    for name, changed in types.items():
        if changed is None:
            del columns[name]
        elif isinstance(changed, tuple):
            columns[name] = changed
        else:
            columns[name] = (columns[name][0], changed)
    return pa.table({name: pa.array(values, kind) for name, (values, kind) in columns.items()})


def write_month(root: Path, taxi_type: str, year: int, month: int, table: pa.Table | None = None) -> Path:
    path = root / taxi_type / str(year) / f"{taxi_type}_tripdata_{year}-{month:02d}.parquet"
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(raw_table(taxi_type, year, month) if table is None else table, path)
    return path
