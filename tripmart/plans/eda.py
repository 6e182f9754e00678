"""Exploratory analysis of the clean trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmart.functions import labels
from tripmart.functions.semantics import day_name, day_of, hour_of_day, iso_weekday, percent, round_to, speed_mph
from tripmart.operators.clean import clean_trips, is_clean, rules
from tripmart.operators.quantiles import exact_quantiles
from tripmart.operators.shaping import in_order, ordered, top_n, with_share

UNUSUAL_DAYS = 15
EXTREME_TRIPS = 10
FARE_BIN, FARE_CAP = 5, 100
MILE_CAP = 20
FAST_MPH, SLOW_MPH = 80, 1


def monthly_trips(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return clean_trips(trips).groupBy("taxi_type", "src_year", "src_month").agg(
        F.count("*").alias("viajes"),
        round_to(F.sum("total_amount"), 0).alias("ingreso_total"),
        round_to(F.avg("total_amount"), 2).alias("total_medio"),
    )


def unusual_days(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Days farthest from their month's daily mean, in standard deviations."""
    days = (
        clean_trips(trips)
        .groupBy("taxi_type", day_of(F.col("pickup_ts")).alias("dia"))
        .agg(F.count("*").alias("viajes"))
    )
    month = Window.partitionBy("taxi_type", F.trunc("dia", "month"))
    spread = F.nullif(F.stddev_pop("viajes").over(month), F.lit(0.0))
    scored = days.withColumn("z", (F.col("viajes") - F.avg("viajes").over(month)) / spread)
    # Nine digits keep equal scores equal, so the remaining keys settle ties.
    distance = round_to(F.abs("z"), 9)
    top = top_n(scored, UNUSUAL_DAYS, distance.desc_nulls_last(), F.col("taxi_type"), F.col("dia"))
    return top.select(
        "taxi_type", "dia", day_name(F.col("dia")).alias("dia_semana"), "viajes", round_to(F.col("z"), 2).alias("z_score")
    )


def hourly_demand(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    counts = clean_trips(trips).groupBy("taxi_type", hour_of_day(F.col("pickup_ts")).alias("hora")).agg(F.count("*").alias("viajes"))
    return with_share(counts, ["taxi_type"], "pct_viajes")


def weekday_demand(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    days = clean_trips(trips).groupBy("taxi_type", iso_weekday(F.col("pickup_ts")).alias("dia_iso")).agg(
        F.count("*").alias("viajes"),
        round_to(F.avg("total_amount"), 2).alias("total_medio"),
        round_to(F.avg("trip_distance"), 2).alias("distancia_media"),
        F.min("pickup_ts").alias("any_day"),
    )
    return days.select(
        "taxi_type", "dia_iso", day_name(F.col("any_day")).alias("dia"), "viajes", "total_medio", "distancia_media"
    )


def trip_quantiles(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    measures = {name: F.col(name) for name in ("trip_distance", "duration_min", "fare_amount")}
    # Result column -> measure, fraction, shown digits.
    wanted = {
        "dist_p05": ("trip_distance", 0.05, 2),
        "dist_mediana": ("trip_distance", 0.50, 2),
        "dist_p95": ("trip_distance", 0.95, 2),
        "dist_p99": ("trip_distance", 0.99, 2),
        "dur_min_mediana": ("duration_min", 0.50, 1),
        "dur_min_p95": ("duration_min", 0.95, 1),
        "tarifa_mediana": ("fare_amount", 0.50, 2),
        "tarifa_p95": ("fare_amount", 0.95, 2),
    }
    exact = exact_quantiles(
        clean_trips(trips), ["taxi_type"], measures, {name: (m, p) for name, (m, p, _) in wanted.items()}
    )
    return exact.select("taxi_type", *[round_to(F.col(name), d).alias(name) for name, (_, _, d) in wanted.items()])


def passengers(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    counts = clean_trips(trips).groupBy("taxi_type", "passenger_count").agg(F.count("*").alias("viajes"))
    shares = with_share(counts, ["taxi_type"])
    label = F.coalesce(F.col("passenger_count").cast("string"), F.lit("NULL"))
    return shares.select("taxi_type", label.alias("pasajeros"), "viajes", "pct")


def type_comparison(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    speed = speed_mph(F.col("trip_distance"), F.col("duration_min"))
    return clean_trips(trips).groupBy("taxi_type").agg(
        F.count("*").alias("viajes"),
        round_to(F.avg("trip_distance"), 2).alias("distancia_media_mi"),
        round_to(F.avg("duration_min"), 1).alias("duracion_media_min"),
        round_to(F.avg(speed), 1).alias("velocidad_media_mph"),
        round_to(F.avg("fare_amount"), 2).alias("tarifa_media"),
        round_to(F.avg("total_amount"), 2).alias("total_medio"),
        round_to(F.avg("tip_amount"), 2).alias("propina_media"),
        round_to(F.avg("passenger_count"), 2).alias("pasajeros_medios"),
    )


def payment_methods(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    counts = clean_trips(trips).groupBy("taxi_type", "payment_type").agg(
        F.count("*").alias("viajes"), round_to(F.avg("tip_amount"), 2).alias("propina_media")
    )
    shares = with_share(counts, ["taxi_type"])
    label = labels.payment_label(F.col("payment_type")).alias("metodo")
    return shares.select("taxi_type", "payment_type", label, "viajes", "pct", "propina_media")


def card_tips(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Tip relative to fare, for card payments. Mean and zero share come from the first pass of the median."""
    ratio = F.col("tip_amount") / F.col("fare_amount")
    stats = exact_quantiles(
        clean_trips(trips).where(F.col("payment_type") == labels.CARD),
        ["taxi_type", "src_year"],
        {"tip": ratio},
        {"median": ("tip", 0.5)},
        sums={
            "all_rows": F.lit(1),
            "with_tip_value": F.when(ratio.isNotNull(), 1),
            "ratio_sum": ratio,
            "without_tip": F.when(ratio == 0, 1).otherwise(0),
        },
    )
    mean = F.try_divide("ratio_sum", "with_tip_value")
    return stats.select(
        "taxi_type",
        "src_year",
        round_to(F.lit(100) * mean, 2).alias("pct_propina_medio"),
        round_to(F.lit(100) * F.col("median"), 2).alias("pct_propina_mediana"),
        round_to(percent(F.col("without_tip"), F.col("all_rows")), 2).alias("pct_sin_propina"),
    )


def fare_bins(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    start = F.floor(F.col("fare_amount") / FARE_BIN) * FARE_BIN
    bins = F.least(start, F.lit(FARE_CAP).cast("bigint")).cast("int").alias("tarifa_desde")
    return clean_trips(trips).groupBy("taxi_type", bins).agg(F.count("*").alias("viajes"))


def distance_bins(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    bins = F.least(F.floor("trip_distance"), F.lit(MILE_CAP).cast("bigint")).cast("int").alias("milla_desde")
    return clean_trips(trips).groupBy("taxi_type", bins).agg(F.count("*").alias("viajes"))


def outliers(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Tukey limits Q3 + 3 IQR, and the trips beyond them counted in one more pass."""
    clean = clean_trips(trips)
    quartiles = exact_quantiles(
        clean,
        ["taxi_type"],
        {"fare": F.col("fare_amount"), "distance": F.col("trip_distance")},
        {
            "fare_q1": ("fare", 0.25),
            "fare_q3": ("fare", 0.75),
            "distance_q1": ("distance", 0.25),
            "distance_q3": ("distance", 0.75),
        },
    )

    def limit(measure: str):
        low, high = F.col(f"{measure}_q1"), F.col(f"{measure}_q3")
        return high + 3 * (high - low)

    limits = quartiles.select(
        F.col("taxi_type").alias("limit_of"),
        limit("fare").alias("limite_tarifa"),
        limit("distance").alias("limite_distancia"),
    )
    speed = speed_mph(F.col("trip_distance"), F.col("duration_min"))
    # One row of limits per taxi type: small whatever the number of trips.
    with_limits = clean.join(F.broadcast(limits), F.col("taxi_type").eqNullSafe(F.col("limit_of")))
    return with_limits.groupBy("taxi_type").agg(
        F.count("*").alias("viajes"),
        F.any_value("limite_tarifa").alias("limite_tarifa"),
        F.count_if(F.col("fare_amount") > F.col("limite_tarifa")).alias("tarifas_atipicas"),
        F.any_value("limite_distancia").alias("limite_distancia"),
        F.count_if(F.col("trip_distance") > F.col("limite_distancia")).alias("distancias_atipicas"),
        F.count_if(speed > FAST_MPH).alias("velocidad_mayor_80mph"),
        F.count_if(speed < SLOW_MPH).alias("velocidad_menor_1mph"),
    )


def extreme_fares(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Highest fares of the trips before cleaning; times and distance settle ties."""
    visible = trips.select(
        "taxi_type", "pickup_ts", "dropoff_ts", "trip_distance", "fare_amount", "total_amount", "payment_type"
    )
    ties = ("taxi_type", "pickup_ts", "dropoff_ts", "trip_distance", "total_amount", "payment_type")
    return top_n(visible, EXTREME_TRIPS, F.col("fare_amount").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties])


def rule_report(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Rows breaking each rule (a NULL breaks none) and rows kept, in one pass."""
    broken = [F.count_if(~kept).alias(name) for name, kept in rules().items()]
    return trips.groupBy("taxi_type").agg(
        F.count("*").alias("registros"), *broken, F.count_if(is_clean()).alias("registros_conservados")
    )


def fare_per_mile(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Median fare and mean fare per mile by distance band, in the order of the bands."""
    banded = clean_trips(trips).withColumn("orden", labels.distance_band_order(F.col("trip_distance")))
    stats = exact_quantiles(
        banded,
        ["taxi_type", "orden"],
        {"fare": F.col("fare_amount")},
        {"median": ("fare", 0.5)},
        sums={"rows": F.lit(1), "per_mile_sum": F.col("fare_amount") / F.col("trip_distance")},
    )
    return in_order(stats, "taxi_type", "orden").select(
        "taxi_type",
        labels.distance_band_name(F.col("orden")).alias("tramo_millas"),
        F.col("rows").cast("bigint").alias("viajes"),
        round_to(F.col("median"), 2).alias("tarifa_mediana"),
        round_to(F.col("per_mile_sum") / F.col("rows"), 2).alias("tarifa_por_milla_media"),
    )


def pickup_boroughs(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips are counted per zone first, so the dimension joins a few hundred rows, not the trips."""
    per_zone = clean_trips(trips).groupBy("taxi_type", "pu_location_id").agg(F.count("*").alias("viajes"))
    named = per_zone.join(zones, F.col("pu_location_id") == F.col("location_id"), "left")
    counts = named.groupBy("taxi_type", "borough").agg(F.sum("viajes").alias("viajes"))
    shares = with_share(counts, ["taxi_type"])
    return shares.select("taxi_type", F.coalesce("borough", F.lit("Sin zona")).alias("borough"), "viajes", "pct")


EDA = {
    "q4_p1_viajes_mensuales": ordered(monthly_trips, "taxi_type", "src_year", "src_month"),
    "q4_p1b_viajes_diarios": unusual_days,
    "q4_p2_demanda_por_hora": ordered(hourly_demand, "taxi_type", "hora"),
    "q4_p3_demanda_dia_semana": ordered(weekday_demand, "taxi_type", "dia_iso"),
    "q4_p4_caracteristicas_viaje": trip_quantiles,
    "q4_p4b_pasajeros": ordered(passengers, "taxi_type", "-viajes"),
    "q4_p5_amarillo_vs_verde": type_comparison,
    "q4_p6_metodos_de_pago": ordered(payment_methods, "taxi_type", "-viajes"),
    "q4_p6b_propina_tarjeta": ordered(card_tips, "taxi_type", "src_year"),
    "q4_p7_histograma_tarifa": ordered(fare_bins, "taxi_type", "tarifa_desde"),
    "q4_p7b_histograma_distancia": ordered(distance_bins, "taxi_type", "milla_desde"),
    "q4_p8_valores_atipicos": outliers,
    "q4_p8b_top_extremos": extreme_fares,
    "q4_p9_reglas_limpieza": rule_report,
    "q4_p10_tarifa_por_milla": fare_per_mile,
    "q4_p11_zonas_recogida": ordered(pickup_boroughs, "taxi_type", "-viajes"),
}
