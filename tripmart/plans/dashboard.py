"""Data behind the dashboard's headline and its wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.functions.semantics import percent, period_start, round_to
from tripmart.operators.clean import is_clean
from tripmart.operators.shaping import wide
from tripmart.plans import indicators


def kpis(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Period covered, trips and revenue per taxi type, share of dropped rows: one pass, one row.

    Revenue adds the monthly amounts as shown (two decimals), so it equals the monthly indicator's sum.
    """
    months = trips.withColumn("clean", is_clean()).groupBy("taxi_type", "src_year", "src_month").agg(
        F.count("*").alias("registros"),
        F.count_if("clean").alias("conservados"),
        round_to(F.sum(F.when(F.col("clean"), F.col("total_amount"))), 2).alias("ingreso"),
    )
    period = F.when(F.col("conservados") > 0, period_start(F.col("src_year"), F.col("src_month")))

    def of_type(name: str, column: str):
        return F.coalesce(F.sum(F.when(F.col("taxi_type") == name, F.col(column))), F.lit(0))

    one_row = months.agg(
        F.min(period).alias("primer_periodo"),
        F.max(period).alias("ultimo_periodo"),
        of_type("yellow", "conservados").alias("viajes_yellow"),
        round_to(of_type("yellow", "ingreso"), 2).alias("ingreso_yellow"),
        of_type("green", "conservados").alias("viajes_green"),
        round_to(of_type("green", "ingreso"), 2).alias("ingreso_green"),
        F.sum("registros").alias("registros"),
        F.sum("conservados").alias("conservados"),
    )
    dropped = percent(F.col("registros") - F.col("conservados"), F.col("registros"))
    return one_row.withColumn("pct_descartado", round_to(dropped, 2)).drop("registros", "conservados")


def payment_table(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Taxi type and year by payment method, percentages; a method not used shows 0."""
    shares = indicators.yearly_payment(trips)
    group = F.concat_ws(" ", "taxi_type", F.col("src_year").cast("string")).alias("grupo")
    return wide(shares.select(group, "metodo", "pct"), ["grupo"], "metodo", F.sum("pct"), fill=0)


def distance_table(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Distance band by taxi type, percentages."""
    shares = indicators.distance_distribution(trips).select("orden", "tramo_millas", "taxi_type", "pct")
    return wide(shares, ["orden", "tramo_millas"], "taxi_type", F.avg("pct"))


def trips_table(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Month by taxi type, trips."""
    return wide(indicators.monthly_trips(trips), ["periodo"], "taxi_type", F.first("viajes"))


DASHBOARD = {
    "dash_kpis": kpis,
    "dash_payment_pivot": payment_table,
    "dash_distance_pivot": distance_table,
    "dash_trips_pivot": trips_table,
}
