"""Writing results: the trips table and the indicator tables."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.sources.schema import TRIPS_COLUMNS, TRIPS_SCHEMA

PARTITIONS = ["taxi_type", "src_year", "src_month"]


def subset_by_files(trips: DataFrame, files: Collection[str]) -> DataFrame:
    """Trips of the named source files. For raw files prefer ``read_trips(..., sources=files)``,
    which does not open the others."""
    return trips.where(F.col("filename").isin(list(files)))


def read_trips_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``materialize_trips``; filters on type and period prune its folders."""
    return spark.read.schema(TRIPS_SCHEMA).parquet(path).select(*TRIPS_COLUMNS)


def materialize_trips(
    trips: DataFrame, path: str, files: Collection[str] | None = None, by_period: bool = False
) -> DataFrame:
    """Write trips (or those of some files) as a table partitioned by type and period.

    The rebalance hint gathers each period's rows into files of a good size: a large period is
    split over several tasks, small ones share a task, so neither tiny files nor a hot task arise.
    Trips that are grouped by period already (``by_period``), as ``read_trips`` gives them from monthly files,
    are written as they come, without a shuffle.
    """
    chosen = trips if files is None else subset_by_files(trips, files)
    rows = chosen if by_period else chosen.hint("rebalance", *PARTITIONS)
    rows.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(path)
    return read_trips_table(trips.sparkSession, path)


def materialize_indicators(
    queries: Mapping[str, Callable[[], DataFrame]], folder: str
) -> tuple[dict[str, str], dict[str, str]]:
    """Write each result as its own table; a failing one is reported and the others continue.

    Returns the written tables (name -> path) and the failures (name -> error).
    """
    written, failed = {}, {}
    for name, build in queries.items():
        path = f"{folder.rstrip('/')}/{name}"
        try:
            build().write.mode("overwrite").parquet(path)
            written[name] = path
        except Exception as error:
            failed[name] = str(error)
    return written, failed
