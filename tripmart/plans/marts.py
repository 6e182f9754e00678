"""All ten dashboard indicators from three passes over the trips.

Each indicator by itself reads the trips once. To write all of them, trips are added up three times instead of ten:
by month, by cells (year, day type, hour, payment group, distance band) and by zone. The first two results are stored, and their
sizes follow the calendar, not the trips. Monthly means are not added up from cells: adding doubles in another order would
turn some second decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.functions import labels
from tripmart.functions.semantics import hour_of_day, percent, round_to, speed_mph
from tripmart.operators.clean import clean_trips, duration_minutes, is_clean
from tripmart.operators.shaping import in_order, with_share
from tripmart.plans.indicators import ORDERS, by_month, named_bands, quality, top_pickup_zones


def monthly_measures(trips: DataFrame) -> DataFrame:
    """What five indicators need of each taxi type and month; months of which cleaning keeps nothing are there too."""
    fare, tip = F.col("fare_amount"), F.col("tip_amount")
    marked = trips.withColumn("clean", is_clean()).withColumn("minutes", duration_minutes())
    by_card = F.col("clean") & F.coalesce(F.col("payment_type") == labels.CARD, F.lit(False))

    def kept(value: Column) -> Column:
        return F.when(F.col("clean"), value)

    return by_month(
        marked,
        F.count("*").alias("registros"),
        F.count_if("clean").alias("viajes"),
        F.sum(kept(F.col("total_amount"))).alias("ingreso"),
        F.avg(kept(F.col("total_amount"))).alias("ingreso_medio"),
        F.avg(kept(fare)).alias("tarifa"),
        F.avg(kept(F.col("trip_distance"))).alias("millas"),
        F.avg(kept(F.col("minutes"))).alias("minutos"),
        F.count_if(by_card).alias("con_tarjeta"),
        F.avg(F.when(by_card, F.try_divide(tip, fare))).alias("propina"),
        F.count_if(by_card & (tip == 0)).alias("sin_propina"),
    )


def trip_cells(trips: DataFrame) -> DataFrame:
    """Clean trips, and those of a minute or more with the sum of their speeds, in each cell."""
    pickup, minutes = F.col("pickup_ts"), F.col("duration_min")
    timed = minutes >= 1
    return clean_trips(trips).groupBy(
        "taxi_type",
        "src_year",
        labels.day_type(pickup).alias("dia_tipo"),
        hour_of_day(pickup).alias("hora"),
        labels.payment_group(F.col("payment_type")).alias("metodo"),
        labels.distance_band_order(F.col("trip_distance")).alias("orden"),
    ).agg(
        F.count("*").alias("viajes"),
        F.count_if(timed).alias("con_minuto"),
        F.sum(F.when(timed, speed_mph(F.col("trip_distance"), minutes))).alias("velocidad"),
    )


def from_months(months: DataFrame) -> dict[str, DataFrame]:
    """The five indicators by month."""
    month = ["taxi_type", "periodo"]
    kept, by_card = months.where("viajes > 0"), months.where("con_tarjeta > 0")
    return {
        "ind_01_viajes_mensuales": kept.select(*month, "viajes"),
        "ind_02_ingreso_mensual": kept.select(
            *month,
            round_to(F.col("ingreso"), 2).alias("ingreso_total"),
            round_to(F.col("ingreso_medio"), 2).alias("ingreso_por_viaje"),
        ),
        "ind_04_viaje_tipico_mensual": kept.select(
            *month,
            round_to(F.col("tarifa"), 2).alias("tarifa_media"),
            round_to(F.col("millas"), 2).alias("distancia_media_mi"),
            round_to(F.col("minutos"), 1).alias("duracion_media_min"),
        ),
        "ind_06_propina_mensual": by_card.select(
            *month,
            round_to(F.lit(100) * F.col("propina"), 2).alias("pct_propina_medio"),
            round_to(percent(F.col("sin_propina"), F.col("con_tarjeta")), 2).alias("pct_sin_propina"),
        ),
        "ind_10_calidad_mensual": quality(months.select(*month, "registros", F.col("viajes").alias("conservados"))),
    }


def from_cells(cells: DataFrame) -> dict[str, DataFrame]:
    """The four indicators that are sums over cells."""

    def counts(*by: str) -> DataFrame:
        return cells.groupBy(*by).agg(F.sum("viajes").alias("viajes"))

    speed = F.sum("velocidad") / F.sum("con_minuto")
    return {
        "ind_03_demanda_por_hora": with_share(
            counts("taxi_type", "dia_tipo", "hora"), ["taxi_type", "dia_tipo"], "pct_viajes"
        ),
        "ind_05_metodo_pago_anual": with_share(counts("taxi_type", "src_year", "metodo"), ["taxi_type", "src_year"]),
        "ind_07_distribucion_distancia": named_bands(counts("taxi_type", "orden")),
        "ind_09_velocidad_por_hora": cells.where("con_minuto > 0")
        .groupBy("taxi_type", "hora")
        .agg(round_to(speed, 2).alias("velocidad_media_mph"), F.sum("con_minuto").alias("viajes")),
    }


def indicator_builders(trips: DataFrame, zones: DataFrame, folder: str) -> dict[str, Callable[[], DataFrame]]:
    """Builders of all ten indicators, in order. Months and cells are computed here, once, and written below ``folder``."""
    spark, root = trips.sparkSession, folder.rstrip("/")
    monthly_measures(trips).write.parquet(f"{root}/months")
    trip_cells(trips).write.parquet(f"{root}/cells")
    found = {
        **from_months(spark.read.parquet(f"{root}/months")),
        **from_cells(spark.read.parquet(f"{root}/cells")),
        "ind_08_top_zonas_recogida": top_pickup_zones(trips, zones),
    }
    return {name: partial(in_order, found[name], *ORDERS[name]) for name in sorted(found)}
