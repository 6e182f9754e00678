"""Checks that newly added periods are really part of the trips relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.operators.shaping import distinct_sorted, ordered, wide

MONTH = ["taxi_type", "src_year", "src_month"]


def months_by_year(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Trips per calendar month, one column per year that occurs."""
    counts = trips.groupBy("taxi_type", F.col("src_month").alias("mes"), F.col("src_year").alias("anio")).agg(
        F.count("*").alias("n")
    )
    return wide(counts, ["taxi_type", "mes"], "anio", F.sum("n"), fill=0)


def duplicated_periods(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Periods that come from more than one file; none are expected.

    Names are counted from distinct (period, file) rows, a handful after the map-side combine.
    """
    sources = trips.select(*MONTH, "filename").distinct()
    return sources.groupBy(*MONTH).agg(F.count("filename").alias("archivos")).where("archivos > 1")


def months_present(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return trips.groupBy("taxi_type", "src_year").agg(
        F.count_distinct("src_month").alias("meses_presentes"), distinct_sorted(F.col("src_month")).alias("meses")
    )


INCORPORATION = {
    "q5_2_consulta_conjunta_por_mes": ordered(months_by_year, "taxi_type", "mes"),
    "q5_3_sin_archivos_duplicados": duplicated_periods,
    "q5_4_meses_presentes": ordered(months_present, "taxi_type", "src_year", "meses_presentes"),
}
