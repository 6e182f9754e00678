"""The normalised trips relation."""

from __future__ import annotations

from pyspark.sql import types as T

TRIPS_SCHEMA = T.StructType(
    [
        T.StructField("taxi_type", T.StringType()),
        T.StructField("vendor_id", T.IntegerType()),
        T.StructField("pickup_ts", T.TimestampNTZType()),
        T.StructField("dropoff_ts", T.TimestampNTZType()),
        T.StructField("passenger_count", T.IntegerType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("ratecode_id", T.IntegerType()),
        T.StructField("pu_location_id", T.IntegerType()),
        T.StructField("do_location_id", T.IntegerType()),
        T.StructField("payment_type", T.IntegerType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("tolls_amount", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("src_year", T.IntegerType()),
        T.StructField("src_month", T.IntegerType()),
        T.StructField("filename", T.StringType()),
    ]
)
TRIPS_COLUMNS = TRIPS_SCHEMA.fieldNames()
TAXI_TYPES = ("yellow", "green")
