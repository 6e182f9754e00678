"""The zone dimension."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV_SCHEMA = "LocationID string, Borough string, Zone string, service_zone string"


def read_zones(spark: SparkSession, path: str | None) -> DataFrame:
    """Zones from a CSV with header; where there is no such file, no zones, so defaults apply downstream."""
    raw = spark.createDataFrame([], _CSV_SCHEMA)
    if path is not None:
        try:
            raw = spark.read.schema(_CSV_SCHEMA).option("header", "true").csv(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return raw.select(
        F.col("LocationID").cast("int").alias("location_id"),
        F.col("Borough").alias("borough"),
        F.col("Zone").alias("zone"),
        "service_zone",
    )
