"""Monthly raw files derived from the trips of ``testbed.tables``, for the jobs that start from files.

Layout: ``<root>/raw/<type>/anio=YYYY/archivo=<type>_tripdata_YYYY-MM.parquet/part-*.parquet``, a
zone CSV, and the same trips as a partitioned table. Column types and names drift with the year.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.operators.sinks import materialize_trips, read_trips_table
from tripmart.session import new_folder
from tripmart.sources.schema import TAXI_TYPES
from tripmart.testbed import tables

# First years of the second and third file generation.
SECOND_GENERATION, THIRD_GENERATION = 1997, 2000


@dataclass(frozen=True)
class Layout:
    """Where the derived data of one source folder lie."""

    root: str

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def table(self) -> str:
        return f"{self.root}/trips_tbl"

    @property
    def zones_csv(self) -> str:
        return f"{self.root}/zones"


_layouts: dict[tuple[str, str], Layout] = {}
_written: set[str] = set()


def _layout(spark: SparkSession, sf_dir: str) -> Layout:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _layouts:
        _layouts[key] = Layout(new_folder(spark, "trips"))
    return _layouts[key]


def trips_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips of ``sf_dir`` as a partitioned table, written at first use in an application.

    Deriving trips joins two large tables; doing it once turns every later query into a scan of
    a few columns.
    """
    target = _layout(spark, sf_dir).table
    if target not in _written:
        materialize_trips(tables.trips(spark, sf_dir, by_period=True), target, by_period=True)
        _written.add(target)
    return read_trips_table(spark, target)


def raw_layout(spark: SparkSession, sf_dir: str) -> Layout:
    """The raw files and the zone CSV of ``sf_dir``, written at first use in an application."""
    target = _layout(spark, sf_dir)
    if target.raw not in _written:
        write_raw(trips_table(spark, sf_dir), tables.zones(spark, sf_dir), target)
        _written.add(target.raw)
    return target


def write_raw(table: DataFrame, zones: DataFrame, target: Layout) -> None:
    """Write a trips table as raw files of three generations, and the zones as CSV.

    Each write reads only its own folders of the table, whose rows are grouped by period already, and replaces only
    its own periods, so that a repeated write doubles nothing.
    """
    year = F.col("src_year")
    generations = [
        year < SECOND_GENERATION,
        (year >= SECOND_GENERATION) & (year < THIRD_GENERATION),
        year >= THIRD_GENERATION,
    ]
    for number, years in enumerate(generations, start=1):
        for taxi_type in TAXI_TYPES:
            rows = table.where(years & (F.col("taxi_type") == taxi_type))
            files = rows.select(
                *raw_columns(taxi_type, number), F.col("src_year").alias("anio"), F.col("filename").alias("archivo")
            )
            writer = files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("anio", "archivo").parquet(f"{target.raw}/{taxi_type}")
    named = zones.select(
        F.col("location_id").alias("LocationID"),
        F.col("borough").alias("Borough"),
        F.col("zone").alias("Zone"),
        "service_zone",
    )
    named.write.mode("overwrite").option("header", "true").csv(target.zones_csv)


def raw_columns(taxi_type: str, generation: int) -> list:
    """Raw columns of one file generation: integer widths, name case and extra charges differ."""
    code = "int" if generation == 1 else "bigint"
    count = "bigint" if generation == 1 else "double"
    prefix = {"yellow": "tpep", "green": "lpep"}[taxi_type]
    columns = [
        F.col("vendor_id").cast(code).alias("VendorID"),
        F.col("pickup_ts").alias(f"{prefix}_pickup_datetime"),
        F.col("dropoff_ts").alias(f"{prefix}_dropoff_datetime"),
        F.col("passenger_count").cast(count).alias("passenger_count"),
        F.col("trip_distance"),
        F.col("ratecode_id").cast(count).alias("RatecodeID"),
        F.lit("N").alias("store_and_fwd_flag"),
        F.col("pu_location_id").alias("PULocationID"),
        F.col("do_location_id").alias("DOLocationID"),
        F.col("payment_type").cast("bigint").alias("payment_type"),
        F.col("fare_amount"),
        F.lit(0.0).alias("extra"),
        F.lit(0.5).alias("mta_tax"),
        F.col("tip_amount"),
        F.col("tolls_amount"),
        F.lit(1.0).alias("improvement_surcharge"),
        F.col("total_amount"),
        F.lit(2.5).alias("congestion_surcharge"),
    ]
    if taxi_type == "yellow":
        columns.append(F.lit(1.75).alias("Airport_fee" if generation == 1 else "airport_fee"))
    else:
        columns += [F.lit(None).cast("double").alias("ehail_fee"), F.lit(1).cast("bigint").alias("trip_type")]
    if generation == 3:
        columns.append(F.lit(0.75).alias("cbd_congestion_fee"))
    return columns
