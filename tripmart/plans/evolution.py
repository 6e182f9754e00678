"""Like-for-like comparison of years over the months that every year has.

Which months are common depends on all trips, while most measures use the clean ones. Each
query therefore reads the trips once into a small cube per source month (clean rows counted
conditionally), finds the common months in the cube, and adds the months up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.functions.labels import CARD
from tripmart.functions.semantics import hour_of_day, percent, period_start, round_to
from tripmart.operators.clean import clean_trips, duration_minutes, is_clean
from tripmart.operators.shaping import distinct_sorted, ordered, with_share

YEAR = ["taxi_type", "src_year"]
MONTH = [*YEAR, "src_month"]


def common_months(cube: DataFrame) -> DataFrame:
    """Rows of a per-month cube whose month occurs in every year, over all taxi types together.

    The unpartitioned window is safe: the cube has as many rows as there are source months
    and categories, not trips.
    """
    years_with_month = F.size(F.collect_set("src_year").over(Window.partitionBy("src_month")))
    all_years = F.size(F.collect_set("src_year").over(Window.partitionBy()))
    marked = cube.withColumn("is_common", F.col("src_month").isNotNull() & (years_with_month == all_years))
    return marked.where("is_common").drop("is_common")


def _flagged(trips: DataFrame) -> DataFrame:
    return trips.withColumn("clean", is_clean())


def _clean_sum(value: Column) -> Column:
    return F.sum(F.when(F.col("clean"), value))


def _clean_count(condition: Column) -> Column:
    return F.count_if(F.col("clean") & F.coalesce(condition, F.lit(False)))


def _mean(total: str, count: str) -> Column:
    return F.try_divide(F.col(total), F.col(count))


def months_present(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return trips.groupBy("taxi_type", "src_month").agg(
        F.count_distinct("src_year").alias("anios_con_datos"), distinct_sorted(F.col("src_year")).alias("anios")
    )


def yearly_summary(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    tip_ratio = F.try_divide("tip_amount", "fare_amount")
    by_card = F.col("payment_type") == CARD
    cube = _flagged(trips).groupBy(*MONTH).agg(
        F.count_if("clean").alias("n"),
        _clean_sum(F.col("total_amount")).alias("total"),
        _clean_sum(F.col("fare_amount")).alias("fare"),
        _clean_sum(F.col("trip_distance")).alias("distance"),
        _clean_sum(duration_minutes()).alias("duration"),
        _clean_count(by_card).alias("card"),
        _clean_sum(F.when(by_card, tip_ratio)).alias("tip"),
        _clean_count(by_card & tip_ratio.isNotNull()).alias("tip_n"),
    )
    summed = [c for c in cube.columns if c not in MONTH]
    years = common_months(cube).groupBy(*YEAR).agg(*[F.sum(c).alias(c) for c in summed]).where("n > 0")
    return years.select(
        *YEAR,
        F.col("n").alias("viajes"),
        round_to(F.col("total"), 0).alias("ingreso_total"),
        round_to(_mean("fare", "n"), 2).alias("tarifa_media"),
        round_to(_mean("distance", "n"), 2).alias("distancia_media_mi"),
        round_to(_mean("duration", "n"), 1).alias("duracion_media_min"),
        round_to(percent(F.col("card"), F.col("n")), 2).alias("pct_tarjeta"),
        round_to(F.lit(100) * _mean("tip", "tip_n"), 2).alias("pct_propina_tarjeta"),
    )


def yearly_change(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    cube = _flagged(trips).groupBy(*MONTH).agg(
        F.count_if("clean").alias("n"),
        _clean_sum(F.col("fare_amount")).alias("fare"),
        _clean_sum(F.col("trip_distance")).alias("distance"),
    )
    years = (
        common_months(cube)
        .groupBy(*YEAR)
        .agg(F.sum("n").alias("viajes"), F.sum("fare").alias("fare"), F.sum("distance").alias("distance"))
        .where("viajes > 0")
        .withColumns({"fare_mean": _mean("fare", "viajes"), "distance_mean": _mean("distance", "viajes")})
    )
    by_year = Window.partitionBy("taxi_type").orderBy("src_year")

    def change(name: str) -> Column:
        previous = F.lag(name).over(by_year)
        return round_to(percent(F.col(name) - previous, previous), 2)

    return years.select(
        *YEAR,
        "viajes",
        change("viajes").alias("var_viajes_pct"),
        change("fare_mean").alias("var_tarifa_pct"),
        change("distance_mean").alias("var_distancia_pct"),
    )


def peak_hour(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Busiest pickup hour; the earlier hour wins a tie."""
    cube = _flagged(trips).groupBy(*MONTH, hour_of_day(F.col("pickup_ts")).alias("hora")).agg(F.count_if("clean").alias("n"))
    hours = common_months(cube).groupBy(*YEAR, "hora").agg(F.sum("n").alias("viajes")).where("viajes > 0")
    busiest = Window.partitionBy(*YEAR).orderBy(F.col("viajes").desc(), F.col("hora"))
    ranked = with_share(hours, YEAR, "pct_del_dia").withColumn("rank", F.row_number().over(busiest))
    return ranked.where("rank = 1").select(*YEAR, F.col("hora").alias("hora_pico"), "viajes", "pct_del_dia")


def yearly_payment_mix(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    cube = _flagged(trips).groupBy(*MONTH, "payment_type").agg(F.count_if("clean").alias("n"))
    counts = common_months(cube).groupBy(*YEAR, "payment_type").agg(F.sum("n").alias("viajes")).where("viajes > 0")
    return with_share(counts, YEAR)


def yearly_quality(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Share of dropped rows; a year without any clean row has no result row."""
    cube = trips.groupBy(*MONTH).agg(F.count("*").alias("n"), F.count_if(is_clean()).alias("kept"))
    years = common_months(cube).groupBy(*YEAR).agg(F.sum("n").alias("registros"), F.sum("kept").alias("conservados"))
    dropped = F.col("registros") - F.col("conservados")
    return years.where("conservados > 0").withColumn(
        "pct_descartado", round_to(percent(dropped, F.col("registros")), 2)
    )


def green_share(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    months = clean_trips(trips).groupBy("src_year", "src_month").agg(
        F.count_if(F.col("taxi_type") == "yellow").alias("viajes_amarillos"),
        F.count_if(F.col("taxi_type") == "green").alias("viajes_verdes"),
        F.count("*").alias("n"),
    )
    return months.select(
        period_start(F.col("src_year"), F.col("src_month")).alias("periodo"),
        "viajes_amarillos",
        "viajes_verdes",
        round_to(percent(F.col("viajes_verdes"), F.col("n")), 3).alias("pct_verdes"),
    )


EVOLUTION = {
    "q8_0_meses_comunes": ordered(months_present, "taxi_type", "src_month"),
    "q8_1_resumen_anual_mismos_meses": ordered(yearly_summary, "taxi_type", "src_year"),
    "q8_2_variacion_interanual": ordered(yearly_change, "taxi_type", "src_year"),
    "q8_3_hora_pico_por_anio": ordered(peak_hour, "taxi_type", "src_year"),
    "q8_4_mezcla_de_pago_por_anio": ordered(yearly_payment_mix, "taxi_type", "src_year", "-viajes"),
    "q8_5_calidad_por_anio": ordered(yearly_quality, "taxi_type", "src_year"),
    "q8_6_participacion_verde": ordered(green_share, "periodo"),
}
