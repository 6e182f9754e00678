"""The benchmark workload. Each query takes any relation shaped like trips: raw files or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.functions.semantics import hour_of_day
from tripmart.operators.quantiles import exact_quantiles
from tripmart.operators.shaping import ordered, top_n

TOP_PAIRS = 20


def count_rows(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return trips.agg(F.count("*").alias("viajes"))


def totals_by_type(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return trips.groupBy("taxi_type").agg(
        F.count("*").alias("viajes"),
        F.avg("fare_amount").alias("tarifa_media"),
        F.avg("trip_distance").alias("distancia_media"),
        F.sum("total_amount").alias("ingreso_total"),
    )


def trips_by_hour(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return trips.groupBy("taxi_type", hour_of_day(F.col("pickup_ts")).alias("hora")).agg(
        F.count("*").alias("viajes"), F.avg("total_amount").alias("total_medio")
    )


def monthly_by_payment(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return trips.groupBy("taxi_type", "src_year", "src_month", "payment_type").agg(
        F.count("*").alias("viajes"),
        F.sum("total_amount").alias("ingreso"),
        F.avg("tip_amount").alias("propina_media"),
    )


def top_zone_pairs(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    pairs = trips.groupBy("pu_location_id", "do_location_id").agg(F.count("*").alias("viajes"))
    return top_n(
        pairs,
        TOP_PAIRS,
        F.col("viajes").desc(),
        F.col("pu_location_id").asc_nulls_last(),
        F.col("do_location_id").asc_nulls_last(),
    )


def selective_filter(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return trips.where((F.col("total_amount") > 150) & (F.col("trip_distance") < 1)).agg(
        F.count("*").alias("viajes"),
        F.avg("total_amount").alias("total_medio"),
        F.max("total_amount").alias("total_max"),
    )


def fare_quantiles(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return exact_quantiles(
        trips.where(F.col("fare_amount") > 0),
        ["taxi_type"],
        {"fare": F.col("fare_amount")},
        {"mediana": ("fare", 0.50), "p90": ("fare", 0.90), "p99": ("fare", 0.99)},
    )


WORKLOAD = {
    "b1_conteo": count_rows,
    "b2_agregado_por_tipo": ordered(totals_by_type, "taxi_type"),
    "b3_viajes_por_hora": ordered(trips_by_hour, "taxi_type", "hora"),
    "b4_mensual_por_pago": ordered(monthly_by_payment, "taxi_type", "src_year", "src_month", "payment_type"),
    "b5_top_pares_de_zonas": top_zone_pairs,
    "b6_filtro_selectivo": selective_filter,
    "b7_percentiles_tarifa": ordered(fare_quantiles, "taxi_type"),
}

# Columns that identify a result row of each query, for comparing two sources.
RESULT_KEYS = {
    "b1_conteo": [],
    "b2_agregado_por_tipo": ["taxi_type"],
    "b3_viajes_por_hora": ["taxi_type", "hora"],
    "b4_mensual_por_pago": ["taxi_type", "src_year", "src_month", "payment_type"],
    "b5_top_pares_de_zonas": ["pu_location_id", "do_location_id"],
    "b6_filtro_selectivo": [],
    "b7_percentiles_tarifa": ["taxi_type"],
}
