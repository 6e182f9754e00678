"""First look at the trips relation: counts, samples, nulls, anomalies, code lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.functions.semantics import hours_between, in_month
from tripmart.operators.profile import profile
from tripmart.operators.shaping import ordered, top_n

PROFILED = [
    "pickup_ts", "dropoff_ts", "passenger_count", "trip_distance", "ratecode_id",
    "payment_type", "fare_amount", "tip_amount", "tolls_amount", "total_amount",
]
SAMPLE_ROWS = 10
FIRST_ROWS = 5


def rows_by_type_year(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return trips.groupBy("taxi_type", "src_year").agg(F.count("*").alias("registros"))


def random_sample(trips: DataFrame, zones: DataFrame | None = None, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """Uniform sample of fixed size; every task keeps its ``rows`` lowest draws."""
    return top_n(trips.drop("filename"), rows, F.rand(seed))


def first_by_type(
    trips: DataFrame, zones: DataFrame | None = None, rows: int = FIRST_ROWS, order: list[Column] | None = None
) -> DataFrame:
    """A few rows of each taxi type; any rows unless an order makes the choice repeatable."""
    visible = trips.drop("filename")

    def head(taxi_type: str) -> DataFrame:
        chosen = visible.where(F.col("taxi_type") == taxi_type)
        return top_n(chosen, rows, *order) if order else chosen.limit(rows)

    return head("yellow").unionByName(head("green"))


def column_profile(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return profile(trips, PROFILED)


def nulls_by_type(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    # Result column for each inspected column.
    inspected = {
        "passenger_count": "passenger_count_nulos",
        "ratecode_id": "ratecode_nulos",
        "payment_type": "payment_type_nulos",
        "pickup_ts": "pickup_nulos",
        "dropoff_ts": "dropoff_nulos",
    }
    return trips.groupBy("taxi_type").agg(
        F.count("*").alias("registros"),
        *[F.count_if(F.col(column).isNull()).alias(name) for column, name in inspected.items()],
    )


def basic_anomalies(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    pickup, dropoff = F.col("pickup_ts"), F.col("dropoff_ts")
    anomalies = {
        "fuera_del_periodo_del_archivo": ~in_month(pickup, F.col("src_year"), F.col("src_month")),
        "llegada_antes_de_salida": dropoff < pickup,
        "duracion_mayor_24h": hours_between(pickup, dropoff) > 24,
        "distancia_cero": F.col("trip_distance") == 0,
        "distancia_mayor_100mi": F.col("trip_distance") > 100,
        "tarifa_negativa": F.col("fare_amount") < 0,
        "total_no_positivo": F.col("total_amount") <= 0,
        "pasajeros_cero": F.col("passenger_count") == 0,
        "pasajeros_nulo": F.col("passenger_count").isNull(),
        "pago_fuera_de_catalogo": (F.col("payment_type") == 0) | (F.col("payment_type") > 6),
    }
    return trips.groupBy("taxi_type").agg(
        F.count("*").alias("registros"),
        *[F.count_if(condition).alias(name) for name, condition in anomalies.items()],
    )


def date_range_by_period(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return trips.groupBy("taxi_type", "src_year", "src_month").agg(
        F.min("pickup_ts").alias("primera_recogida"),
        F.max("pickup_ts").alias("ultima_recogida"),
        F.count("*").alias("registros"),
    )


def code_lists(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Value counts of both code columns from one scan: pairs are counted, then each code is summed."""
    pairs = trips.groupBy("taxi_type", "payment_type", "ratecode_id").agg(F.count("*").alias("n"))
    codes = F.array(
        *[
            F.struct(F.lit(name).alias("campo"), F.col(name).cast("string").alias("valor"))
            for name in ("payment_type", "ratecode_id")
        ]
    )
    return (
        pairs.select("taxi_type", "n", F.inline(codes))
        .groupBy("campo", "valor", "taxi_type")
        .agg(F.sum("n").alias("registros"))
    )


EXPLORATION = {
    "q3_2_registros_por_tipo_anio": ordered(rows_by_type_year, "taxi_type", "src_year", "registros"),
    "q3_5_muestra_aleatoria": random_sample,
    "q3_5b_primeros_por_tipo": first_by_type,
    "q3_6_resumen_estadistico": column_profile,
    "q3_6b_nulos_por_tipo": nulls_by_type,
    "q3_6c_anomalias_basicas": basic_anomalies,
    "q3_7_rango_fechas": ordered(date_range_by_period, "taxi_type", "src_year", "src_month", "primera_recogida", "ultima_recogida", "registros"),
    "q3_7b_catalogos": ordered(code_lists, "campo", "taxi_type", "-registros"),
}
