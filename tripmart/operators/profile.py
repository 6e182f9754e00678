"""Whole-table column profile in a single pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.functions.semantics import round_to

# Type names shown for Spark types.
TYPE_NAMES = {
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "timestamp_ntz": "TIMESTAMP",
}
QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}


def type_name(data_type: T.DataType) -> str:
    text = data_type.simpleString()
    return TYPE_NAMES.get(text, text.upper())


def is_time(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.TimestampNTZType, T.TimestampType))


def _number(name: str, data_type: T.DataType) -> Column:
    """Times are profiled as seconds since the epoch and shown as times again at the end."""
    column = F.col(name)
    return F.unix_timestamp(column).cast("double") if is_time(data_type) else column.cast("double")


def _statistics(name: str, data_type: T.DataType) -> list[Column]:
    """Exact aggregates for one column; all of them run in generated code."""
    column, number = F.col(name), _number(name, data_type)
    # Adding zero shows a negative zero as zero.
    shown = (lambda v: v + F.lit(0.0)) if isinstance(data_type, T.DoubleType) else (lambda v: v)
    return [
        shown(F.min(column)).alias(f"{name}__min"),
        shown(F.max(column)).alias(f"{name}__max"),
        F.avg(number).alias(f"{name}__avg"),
        F.stddev_samp(number).alias(f"{name}__std"),
        F.count(column).alias(f"{name}__count"),
    ]


def _sketches(name: str, data_type: T.DataType) -> list[Column]:
    """Mergeable estimates of fixed size: distinct values and quartiles."""
    return [
        F.approx_count_distinct(name, 0.02).alias(f"{name}__distinct"),
        F.kll_sketch_agg_double(_number(name, data_type)).alias(f"{name}__sketch"),
    ]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: range, distinct count, mean, deviation, quartiles, NULL percentage."""
    types = {name: df.schema[name].dataType for name in columns}
    stats = [stat for name in columns for stat in _statistics(name, types[name])]
    sketches = [sketch for name in columns for sketch in _sketches(name, types[name])]
    # Sketches switch off code generation for every aggregate beside them, which costs more
    # than a second pass over the columns. Each side is one row.
    one_row = df.agg(F.count("*").alias("rows"), *stats).crossJoin(df.agg(*sketches))

    def as_text(value: Column, data_type: T.DataType) -> Column:
        if is_time(data_type):
            value = F.timestamp_micros((value * 1_000_000).cast("bigint")).cast("timestamp_ntz")
        return value.cast("string")

    def line(name: str) -> Column:
        kind = types[name]
        has_values = F.col(f"{name}__count") > 0
        quartiles = [
            F.when(has_values, as_text(F.kll_sketch_get_quantile_double(f"{name}__sketch", F.lit(p)), kind)).alias(q)
            for q, p in QUARTILES.items()
        ]
        deviation = F.lit(None) if is_time(kind) else F.col(f"{name}__std")
        nulls = F.try_divide(F.lit(100.0) * (F.col("rows") - F.col(f"{name}__count")), F.col("rows").cast("double"))
        return F.struct(
            F.lit(name).alias("column_name"),
            F.lit(type_name(kind)).alias("column_type"),
            F.col(f"{name}__min").cast("string").alias("min"),
            F.col(f"{name}__max").cast("string").alias("max"),
            F.col(f"{name}__distinct").alias("approx_unique"),
            as_text(F.col(f"{name}__avg"), kind).alias("avg"),
            deviation.cast("string").alias("std"),
            *quartiles,
            F.col("rows").alias("count"),
            round_to(nulls, 2).alias("null_percentage"),
        )

    return one_row.select(F.inline(F.array(*[line(name) for name in columns])))
