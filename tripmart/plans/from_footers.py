"""Counts and time ranges of raw files answered from their footers, without a scan.

Row counts are in every footer. Times need the statistics of the pickup column; monthly datasets that have a file without them are
scanned instead, and only those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.operators.shaping import ordered
from tripmart.plans.exploration import date_range_by_period
from tripmart.plans.increments import month_of
from tripmart.session import small_table
from tripmart.sources.catalogue import Snapshot, default_catalogue, footers, readable
from tripmart.sources.raw import TIME_PREFIX, read_trips

MONTH = ["taxi_type", "src_year", "src_month"]


def _files(spark: SparkSession, snapshot: Snapshot, root: str) -> DataFrame:
    """The footers with taxi type and period; a file that is not readable fails the call, by name."""
    broken = [d.path for d in snapshot.datasets if d.layout is None]
    if broken:
        raise OSError(f"not readable as Parquet: {', '.join(broken[:10])}")
    sources = sorted({d.source for d in snapshot.datasets})
    taxi_type, year, month = zip(*[month_of(source, root) for source in sources], strict=True)
    # A row for each monthly dataset, which the driver knows in any case.
    months = small_table(spark, source=sources, taxi_type=list(taxi_type), src_year=list(year), src_month=list(month))
    typed = months.select("source", "taxi_type", F.col("src_year").cast("int"), F.col("src_month").cast("int"))
    return snapshot.files.join(typed, "source")


def count_rows(spark: SparkSession, root: str) -> DataFrame:
    return readable(footers(spark, root)).agg(F.sum("num_rows").alias("viajes"))


def rows_by_type_year(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, default_catalogue(spark).snapshot(root), root).groupBy("taxi_type", "src_year").agg(F.sum("num_rows").alias("registros"))


def _pickup() -> Column:
    """The pickup column's entry in a footer."""
    names = [f"{prefix}_pickup_datetime" for prefix in TIME_PREFIX.values()]
    return F.try_element_at(F.filter("columns", lambda c: F.lower(c["name"]).isin(names)), F.lit(1))


def date_range(spark: SparkSession, root: str) -> DataFrame:
    """First and last pickup and number of rows of each type and month."""
    now = default_catalogue(spark).snapshot(root)
    files = _files(spark, now, root).withColumn("pickup", _pickup())
    rows = F.col("num_rows")
    told = (rows == 0) | F.col("pickup.low").isNotNull() | (F.col("pickup.nulls") == rows)
    bounds = [F.col(f"pickup.{end}").cast("timestamp_ntz").alias(end) for end in ("low", "high")]
    by_source = files.select(*MONTH, "source", "num_rows", F.coalesce(told, F.lit(False)).alias("told"), *bounds)
    by_source = by_source.groupBy(*MONTH, "source").agg(
        F.every("told").alias("told"), F.sum("num_rows").alias("registros"),
        F.min("low").alias("primera_recogida"), F.max("high").alias("ultima_recogida"),
    )
    untold = [row["source"] for row in by_source.where("NOT told").select("source").collect()]
    found = by_source.where("told").select(*MONTH, "primera_recogida", "ultima_recogida", "registros")
    if untold:
        found = found.unionByName(date_range_by_period(read_trips(spark, root, untold, snapshot=now)))
    return found.where("registros > 0").groupBy(*MONTH).agg(
        F.min("primera_recogida").alias("primera_recogida"), F.max("ultima_recogida").alias("ultima_recogida"),
        F.sum("registros").alias("registros"),
    )


FROM_FOOTERS = {
    "b1_conteo_metadatos": count_rows,
    "q3_2_registros_metadatos": ordered(rows_by_type_year, "taxi_type", "src_year", "registros"),
    "q3_7_rango_fechas_metadatos": ordered(date_range, "taxi_type", "src_year", "src_month", "primera_recogida", "ultima_recogida", "registros"),
}
