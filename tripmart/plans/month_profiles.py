"""Column profiles kept by month: exact statistics and mergeable sketches, from which any set of months is profiled.

The trips are read when a month's profile is made, and never again: counts, ranges, means and variances of months are combined
exactly as far as doubles allow, distinct counts and quartiles from HLL and KLL sketches of fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.functions.semantics import round_to
from tripmart.operators.profile import QUARTILES, is_time, type_name
from tripmart.plans.exploration import PROFILED
from tripmart.plans.indicators import MONTH
from tripmart.sources.schema import TRIPS_SCHEMA

LG_K = 12  # 2^12 registers: distinct counts are off by 1.6 % (one standard error)
KLL_K = 200  # ranks of quantiles are off by about 1.3 %


def _number(name: str, kind: T.DataType) -> Column:
    """Times as microseconds since the epoch, which doubles hold exactly until the year 2255."""
    return F.unix_micros(F.col(name).cast("timestamp")).cast("double") if is_time(kind) else F.col(name).cast("double")


def _exact(name: str, number: Column) -> list[Column]:
    statistics = {"n": F.count, "low": F.min, "high": F.max, "mean": F.avg, "variance": F.var_pop}
    return [function(number).alias(f"{name}__{part}") for part, function in statistics.items()]


def _sketches(name: str, number: Column) -> list[Column]:
    # HLL takes no doubles; equal values have equal texts
    return [
        F.hll_sketch_agg(F.col(name).cast("string"), LG_K).alias(f"{name}__distinct"),
        F.kll_sketch_agg_double(number, KLL_K).alias(f"{name}__quantiles"),
    ]


def month_profiles(trips: DataFrame, columns: Sequence[str] = PROFILED) -> DataFrame:
    """A row for each month and column: ``rows, n, low, high, mean, variance``, and both sketches.

    Exact statistics and sketches are two scans, since sketches switch off code generation for all aggregates beside them.
    """
    kinds = {name: trips.schema[name].dataType for name in columns}
    numbers = {name: _number(name, kind) for name, kind in kinds.items()}
    exact = trips.groupBy(*MONTH).agg(F.count("*").alias("rows"), *[c for name in columns for c in _exact(name, numbers[name])])
    sketched = trips.groupBy(*MONTH).agg(*[c for name in columns for c in _sketches(name, numbers[name])])
    same = [exact[c].eqNullSafe(sketched[c]) for c in MONTH]  # one row a month on each side
    joined = exact.join(sketched, same).select(*[exact[c] for c in exact.columns], *[c for c in sketched.columns if c not in MONTH])
    parts = ("n", "low", "high", "mean", "variance", "distinct", "quantiles")
    lines = [F.struct(F.lit(name).alias("column_name"), "rows", *[F.col(f"{name}__{p}").alias(p) for p in parts]) for name in columns]
    return joined.select(*MONTH, F.inline(F.array(*lines)))


def merged_profile(months: DataFrame, columns: Sequence[str] = PROFILED, schema: T.StructType = TRIPS_SCHEMA) -> DataFrame:
    """The profile of all ``months`` together, a row for each column, as ``operators.profile`` shows it."""
    n, mean = F.col("n"), F.col("mean")
    centre = months.groupBy("column_name").agg((F.sum(n * mean) / F.sum(n)).alias("centre"))
    # Ten rows. Deviations are taken from the common mean, so that large means cancel nothing.
    spread = months.join(F.broadcast(centre), "column_name").groupBy("column_name").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.first("centre").alias("mean"),
        F.sum(n * (F.col("variance") + (mean - F.col("centre")) * (mean - F.col("centre")))).alias("squares"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("approx_unique"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )

    def line(name: str) -> Column:
        kind = schema[name].dataType
        # adding zero shows a negative zero as zero
        bound = (lambda v: v + F.lit(0.0)) if isinstance(kind, T.DoubleType) else (lambda v: v if is_time(kind) else v.cast(kind))
        quartiles = [
            F.when(F.col("n") > 0, _as_text(F.kll_sketch_get_quantile_double("quantiles", F.lit(p)), kind)).alias(q)
            for q, p in QUARTILES.items()
        ]
        deviation = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
        nulls = F.try_divide(F.lit(100.0) * (F.col("rows") - F.col("n")), F.col("rows").cast("double"))
        return F.struct(
            F.lit(type_name(kind)).alias("column_type"),
            _as_text(bound(F.col("low")), kind).alias("min"),
            _as_text(bound(F.col("high")), kind).alias("max"),
            "approx_unique",
            _as_text(F.col("mean"), kind).alias("avg"),
            (F.lit(None) if is_time(kind) else deviation).cast("string").alias("std"),
            *quartiles,
            F.col("rows").alias("count"),
            round_to(nulls, 2).alias("null_percentage"),
        )

    chosen = F.coalesce(*[F.when(F.col("column_name") == name, line(name)) for name in columns])
    return spread.select("column_name", chosen.alias("line")).select("column_name", "line.*")


def _as_text(value: Column, kind: T.DataType) -> Column:
    return F.timestamp_micros(value.cast("bigint")).cast("timestamp_ntz").cast("string") if is_time(kind) else value.cast("string")
