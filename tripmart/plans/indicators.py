"""The ten dashboard indicators. Each takes the trips relation and returns a small result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmart.functions import labels
from tripmart.functions.semantics import hour_of_day, percent, period_start, round_to, speed_mph
from tripmart.operators.clean import clean_trips, is_clean
from tripmart.operators.shaping import ordered, with_share

MONTH = ["taxi_type", "src_year", "src_month"]
TOP_ZONES = 10


def by_month(rows: DataFrame, *measures) -> DataFrame:
    """Aggregate per taxi type and source month, with the month shown as a date."""
    months = rows.groupBy(*MONTH).agg(*measures)
    period = period_start(F.col("src_year"), F.col("src_month")).alias("periodo")
    return months.select("taxi_type", period, *[c for c in months.columns if c not in MONTH])


def monthly_trips(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return by_month(clean_trips(trips), F.count("*").alias("viajes"))


def monthly_revenue(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return by_month(
        clean_trips(trips),
        round_to(F.sum("total_amount"), 2).alias("ingreso_total"),
        round_to(F.avg("total_amount"), 2).alias("ingreso_por_viaje"),
    )


def hourly_demand(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    counts = (
        clean_trips(trips)
        .groupBy("taxi_type", labels.day_type(F.col("pickup_ts")).alias("dia_tipo"), hour_of_day(F.col("pickup_ts")).alias("hora"))
        .agg(F.count("*").alias("viajes"))
    )
    return with_share(counts, ["taxi_type", "dia_tipo"], "pct_viajes")


def typical_trip(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return by_month(
        clean_trips(trips),
        round_to(F.avg("fare_amount"), 2).alias("tarifa_media"),
        round_to(F.avg("trip_distance"), 2).alias("distancia_media_mi"),
        round_to(F.avg("duration_min"), 1).alias("duracion_media_min"),
    )


def yearly_payment(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    counts = (
        clean_trips(trips)
        .groupBy("taxi_type", "src_year", labels.payment_group(F.col("payment_type")).alias("metodo"))
        .agg(F.count("*").alias("viajes"))
    )
    return with_share(counts, ["taxi_type", "src_year"])


def monthly_tip(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    by_card = clean_trips(trips).where(F.col("payment_type") == labels.CARD)
    return by_month(
        by_card,
        round_to(F.lit(100) * F.avg(F.col("tip_amount") / F.col("fare_amount")), 2).alias("pct_propina_medio"),
        round_to(percent(F.count_if(F.col("tip_amount") == 0), F.count("*")), 2).alias("pct_sin_propina"),
    )


def distance_distribution(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    counts = (
        clean_trips(trips)
        .groupBy("taxi_type", labels.distance_band_order(F.col("trip_distance")).alias("orden"))
        .agg(F.count("*").alias("viajes"))
    )
    return named_bands(counts)


def named_bands(counts: DataFrame) -> DataFrame:
    """Shares of the distance bands, from trips per ``taxi_type, orden``."""
    shares = with_share(counts, ["taxi_type"])
    return shares.select(
        "taxi_type", labels.distance_band_name(F.col("orden")).alias("tramo_millas"), "orden", "viajes", "pct"
    )


def top_pickup_zones(trips: DataFrame, zones: DataFrame) -> DataFrame:
    return best_zones(clean_trips(trips).groupBy("taxi_type", "pu_location_id").agg(F.count("*").alias("viajes")), zones)


def best_zones(counts: DataFrame, zones: DataFrame) -> DataFrame:
    """The zones with most trips of each type, from trips per ``taxi_type, pu_location_id``."""
    best_first = Window.partitionBy("taxi_type").orderBy(
        F.col("viajes").desc(), F.col("pu_location_id").asc_nulls_last()
    )
    ranked = with_share(counts, ["taxi_type"]).withColumn("posicion", F.row_number().over(best_first))
    top = ranked.where(F.col("posicion") <= TOP_ZONES)
    location = F.col("pu_location_id")
    return top.join(zones, location == F.col("location_id"), "left").select(
        "taxi_type",
        "posicion",
        location.alias("location_id"),
        F.coalesce("zone", F.concat(F.lit("Zona "), location.cast("string"))).alias("zona"),
        F.coalesce("borough", F.lit("N/D")).alias("borough"),
        "viajes",
        "pct",
    )


def hourly_speed(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return (
        clean_trips(trips)
        .where(F.col("duration_min") >= 1)
        .groupBy("taxi_type", hour_of_day(F.col("pickup_ts")).alias("hora"))
        .agg(
            round_to(F.avg(speed_mph(F.col("trip_distance"), F.col("duration_min"))), 2).alias("velocidad_media_mph"),
            F.count("*").alias("viajes"),
        )
    )


def monthly_quality(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """All and kept rows in one pass over the trips."""
    counts = by_month(trips, F.count("*").alias("registros"), F.count_if(is_clean()).alias("conservados"))
    return quality(counts)


def quality(counts: DataFrame) -> DataFrame:
    """Adds the share that cleaning drops."""
    dropped = F.col("registros") - F.col("conservados")
    return counts.withColumn("pct_descartado", round_to(percent(dropped, F.col("registros")), 2))


# How each result is sorted; "-" means from high to low.
ORDERS = {
    "ind_01_viajes_mensuales": ("taxi_type", "periodo"),
    "ind_02_ingreso_mensual": ("taxi_type", "periodo"),
    "ind_03_demanda_por_hora": ("taxi_type", "dia_tipo", "hora"),
    "ind_04_viaje_tipico_mensual": ("taxi_type", "periodo"),
    "ind_05_metodo_pago_anual": ("taxi_type", "src_year", "-viajes"),
    "ind_06_propina_mensual": ("taxi_type", "periodo"),
    "ind_07_distribucion_distancia": ("taxi_type", "orden"),
    "ind_08_top_zonas_recogida": ("taxi_type", "posicion"),
    "ind_09_velocidad_por_hora": ("taxi_type", "hora"),
    "ind_10_calidad_mensual": ("taxi_type", "periodo"),
}

_PLANS = {
    "ind_01_viajes_mensuales": monthly_trips,
    "ind_02_ingreso_mensual": monthly_revenue,
    "ind_03_demanda_por_hora": hourly_demand,
    "ind_04_viaje_tipico_mensual": typical_trip,
    "ind_05_metodo_pago_anual": yearly_payment,
    "ind_06_propina_mensual": monthly_tip,
    "ind_07_distribucion_distancia": distance_distribution,
    "ind_08_top_zonas_recogida": top_pickup_zones,
    "ind_09_velocidad_por_hora": hourly_speed,
    "ind_10_calidad_mensual": monthly_quality,
}

INDICATORS = {name: ordered(plan, *ORDERS[name]) for name, plan in _PLANS.items()}
