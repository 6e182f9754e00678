"""All ten dashboard indicators from cells: exact sums that may be stored by month and merged.

Trips are added up twice: by cells (month, day type, hour, payment group, distance band), which are many and carry few numbers, and by month and
zone, which are fewer and carry the sums that are shown by month. Both results follow the calendar in size, not the trips. Sums in cells are exact (``operators.exact_sums``), so means by month or hour are added up
from cells, and cells of months that come later can be merged with stored ones; neither changes a bit of the result.

A mean of doubles that were added one by one (``plans.marts``, as single indicators do) may fall on the other side of a tie: of 160 months
at 60,000 trips, two tip percentages are shown 0.01 apart, the true means lying 1e-14 above the tie.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.functions import labels
from tripmart.functions.semantics import hour_of_day, percent, round_to, speed_mph
from tripmart.operators.clean import clean_trips, duration_minutes, is_clean
from tripmart.operators.exact_sums import mean, split, summed, total
from tripmart.operators.shaping import in_order, with_share
from tripmart.plans.indicators import MONTH, ORDERS, best_zones, by_month, named_bands, quality

SUMS = ("ingreso", "tarifa", "millas", "minutos", "propina")
COUNTS = ("registros", "viajes", "con_tarjeta", "con_propina", "sin_propina")


def trip_cells(trips: DataFrame) -> DataFrame:
    """Clean trips of each cell of a month, and those of a minute or more with the sum of their speeds."""
    pickup, minutes = F.col("pickup_ts"), F.col("duration_min")
    timed = minutes >= 1
    speed = F.when(timed, speed_mph(F.col("trip_distance"), minutes))
    rows = clean_trips(trips).select(
        *MONTH,
        labels.day_type(pickup).alias("dia_tipo"),
        hour_of_day(pickup).alias("hora"),
        labels.payment_group(F.col("payment_type")).alias("metodo"),
        labels.distance_band_order(F.col("trip_distance")).alias("orden"),
        timed.alias("timed"),
        *split(speed, "velocidad"),
    )
    return rows.groupBy(*MONTH, "dia_tipo", "hora", "metodo", "orden").agg(
        F.count("*").alias("viajes"), F.count_if("timed").alias("con_minuto"), *summed("velocidad")
    )


def zone_cells(trips: DataFrame) -> DataFrame:
    """Counts and exact sums of each month and pickup zone; trips that cleaning drops count in the cell without a zone."""
    fare, tip, clean = F.col("fare_amount"), F.col("tip_amount"), F.col("clean")
    marked = trips.withColumn("clean", is_clean()).withColumn("minutes", duration_minutes())
    by_card = clean & F.coalesce(F.col("payment_type") == labels.CARD, F.lit(False))
    tipped = F.when(by_card, F.try_divide(tip, fare))

    def kept(value: Column) -> Column:
        return F.when(clean, value)

    values = (kept(F.col("total_amount")), kept(fare), kept(F.col("trip_distance")), kept(F.col("minutes")), tipped)
    rows = marked.select(
        *MONTH, kept(F.col("pu_location_id")).alias("pu_location_id"), "clean", by_card.alias("by_card"),
        tipped.isNotNull().alias("tipped"), (by_card & (tip == 0)).alias("untipped"),
        *[column for name, value in zip(SUMS, values, strict=True) for column in split(value, name)],
    )
    return rows.groupBy(*MONTH, "pu_location_id").agg(
        F.count("*").alias("registros"),
        F.count_if("clean").alias("viajes"),
        F.count_if("by_card").alias("con_tarjeta"),
        F.count_if("tipped").alias("con_propina"),
        F.count_if("untipped").alias("sin_propina"),
        *[column for name in SUMS for column in summed(name)],
    )


def from_cells(cells: DataFrame, by_zone: DataFrame, zones: DataFrame) -> dict[str, DataFrame]:
    """All ten indicators."""

    def counts(*by: str) -> DataFrame:
        return cells.groupBy(*by).agg(F.sum("viajes").alias("viajes"))

    counted = [F.sum(name).alias(name) for name in COUNTS]
    months = by_month(by_zone, *counted, *[column for name in SUMS for column in summed(name)])
    hours = cells.groupBy("taxi_type", "hora").agg(F.sum("con_minuto").alias("con_minuto"), *summed("velocidad"))
    month, kept, by_card = ["taxi_type", "periodo"], months.where("viajes > 0"), months.where("con_tarjeta > 0")
    n = F.col("viajes")
    zone_counts = by_zone.groupBy("taxi_type", "pu_location_id").agg(F.sum("viajes").alias("viajes")).where("viajes > 0")
    return {
        "ind_01_viajes_mensuales": kept.select(*month, "viajes"),
        "ind_02_ingreso_mensual": kept.select(
            *month,
            round_to(total("ingreso"), 2).alias("ingreso_total"),
            round_to(mean("ingreso", n), 2).alias("ingreso_por_viaje"),
        ),
        "ind_03_demanda_por_hora": with_share(
            counts("taxi_type", "dia_tipo", "hora"), ["taxi_type", "dia_tipo"], "pct_viajes"
        ),
        "ind_04_viaje_tipico_mensual": kept.select(
            *month,
            round_to(mean("tarifa", n), 2).alias("tarifa_media"),
            round_to(mean("millas", n), 2).alias("distancia_media_mi"),
            round_to(mean("minutos", n), 1).alias("duracion_media_min"),
        ),
        "ind_05_metodo_pago_anual": with_share(counts("taxi_type", "src_year", "metodo"), ["taxi_type", "src_year"]),
        "ind_06_propina_mensual": by_card.select(
            *month,
            round_to(F.lit(100) * mean("propina", F.col("con_propina")), 2).alias("pct_propina_medio"),
            round_to(percent(F.col("sin_propina"), F.col("con_tarjeta")), 2).alias("pct_sin_propina"),
        ),
        "ind_07_distribucion_distancia": named_bands(counts("taxi_type", "orden")),
        "ind_08_top_zonas_recogida": best_zones(zone_counts, zones),
        "ind_09_velocidad_por_hora": hours.where("con_minuto > 0").select(
            "taxi_type",
            "hora",
            round_to(mean("velocidad", F.col("con_minuto")), 2).alias("velocidad_media_mph"),
            F.col("con_minuto").alias("viajes"),
        ),
        "ind_10_calidad_mensual": quality(months.select(*month, "registros", F.col("viajes").alias("conservados"))),
    }


def indicators_of(cells: DataFrame, by_zone: DataFrame, zones: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Builders of all ten indicators, in order, from cells of any months."""
    found = from_cells(cells, by_zone, zones)
    return {name: partial(in_order, found[name], *ORDERS[name]) for name in sorted(found)}


def exact_indicators(trips: DataFrame, zones: DataFrame, folder: str) -> dict[str, Callable[[], DataFrame]]:
    """Builders of all ten indicators, in order. Cells are computed here, once, and written below ``folder``."""
    spark, root = trips.sparkSession, folder.rstrip("/")
    trip_cells(trips).write.parquet(f"{root}/cells")
    zone_cells(trips).write.parquet(f"{root}/zones")
    return indicators_of(spark.read.parquet(f"{root}/cells"), spark.read.parquet(f"{root}/zones"), zones)
