"""The six cleaning rules and the clean relation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.functions.semantics import in_month, seconds_between

# Limits of the rules.
MAX_SECONDS = 6 * 3600
MAX_MILES = 100
MAX_TOTAL = 1000


def rules() -> dict[str, Column]:
    """Rule name -> condition a kept row meets, in report order."""
    pickup, dropoff = F.col("pickup_ts"), F.col("dropoff_ts")
    distance, fare, total = F.col("trip_distance"), F.col("fare_amount"), F.col("total_amount")
    return {
        "r1_fuera_de_periodo": in_month(pickup, F.col("src_year"), F.col("src_month")),
        "r2_llegada_no_posterior": dropoff > pickup,
        "r3_duracion_mayor_6h": seconds_between(pickup, dropoff) <= MAX_SECONDS,
        "r4_distancia_invalida": (distance > 0) & (distance <= MAX_MILES),
        "r5_tarifa_no_positiva": fare > 0,
        "r6_total_invalido": (total > 0) & (total <= MAX_TOTAL),
    }


def keeps_all() -> Column:
    """True where every rule holds; NULL or false where the clean relation drops the row."""
    return reduce(and_, rules().values())


def is_clean() -> Column:
    """``keeps_all`` with NULL taken as false, for conditional aggregates over all trips."""
    return F.coalesce(keeps_all(), F.lit(False))


def duration_minutes() -> Column:
    return seconds_between(F.col("pickup_ts"), F.col("dropoff_ts")) / F.lit(60.0)


def clean_trips(trips: DataFrame) -> DataFrame:
    """Trips that meet all rules, with ``duration_min`` added."""
    return trips.where(keeps_all()).withColumn("duration_min", duration_minutes())
