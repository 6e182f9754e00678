"""Are two results the same, apart from rounding noise?"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REL_TOLERANCE = 1e-6
ABS_TOLERANCE = 1e-9


def _is_float(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def _same(left: Column, right: Column, data_type: T.DataType) -> Column:
    """Cell comparison: NULL equals only NULL, finite floats may differ within the tolerance."""
    if not _is_float(data_type):
        return left.eqNullSafe(right)
    inf = F.lit(float("inf"))
    finite = (F.abs(left) < inf) & (F.abs(right) < inf)  # NaN is greater than infinity
    allowed = F.greatest(F.lit(REL_TOLERANCE) * F.greatest(F.abs(left), F.abs(right)), F.lit(ABS_TOLERANCE))
    return left.eqNullSafe(right) | F.coalesce(finite & (F.abs(left - right) <= allowed), F.lit(False))


def _shape(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def _tagged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both results, each with the name of its side."""
    return a.withColumn("__side", F.lit("a")).unionByName(b.withColumn("__side", F.lit("b")))


def _by_key(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    one = F.lit(1)
    left = a.select(one.alias("__one"), one.alias("__row"), "*").alias("a")
    right = b.select(one.alias("__one"), one.alias("__row"), "*").alias("b")
    on = reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("__one", *keys)])
    in_both = F.col("a.__row").isNotNull() & F.col("b.__row").isNotNull()
    cells = [_same(F.col(f"a.{f.name}"), F.col(f"b.{f.name}"), f.dataType) for f in a.schema.fields if f.name not in keys]
    return left.join(right, on, "full").agg(
        F.count("a.__row").alias("filas_a"),
        F.count("b.__row").alias("filas_b"),
        F.count_if(~reduce(and_, cells, in_both)).alias("diferencias"),
    )


def _as_multisets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Equal rows cancel out first; what is left is paired by the rank of its floats among rows that agree in all else.

    Pairing by rank never hides a difference. It may count more than there are: after a missing row the ranks are shifted,
    and noise in a first float can turn the order of a second.
    """
    floats = [f for f in a.schema.fields if _is_float(f.dataType)]
    exact = [f.name for f in a.schema.fields if not _is_float(f.dataType)]
    counted = _tagged(a, b).groupBy(*a.columns).agg(
        F.count_if(F.col("__side") == "a").alias("__a"), F.count_if(F.col("__side") == "b").alias("__b")
    )
    rows = counted.agg(
        F.coalesce(F.sum("__a"), F.lit(0)).alias("filas_a"), F.coalesce(F.sum("__b"), F.lit(0)).alias("filas_b")
    )
    surplus = F.col("__a") - F.col("__b")
    left_over = (
        counted.where(surplus != 0)
        .withColumn("__in_a", surplus > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.abs(surplus).cast("int"))))
    )
    rank = F.row_number().over(Window.partitionBy(*exact, "__in_a").orderBy(*[f.name for f in floats], "__copy"))
    in_a = F.col("__in_a")
    pairs = left_over.withColumn("__rank", rank).groupBy(*exact, "__rank").agg(
        F.count_if(in_a).alias("__n_a"),
        F.count_if(~in_a).alias("__n_b"),
        *[F.max(F.when(in_a, F.col(f.name))).alias(f"__a_{f.name}") for f in floats],
        *[F.max(F.when(~in_a, F.col(f.name))).alias(f"__b_{f.name}") for f in floats],
    )
    near = [_same(F.col(f"__a_{f.name}"), F.col(f"__b_{f.name}"), f.dataType) for f in floats]
    same = reduce(and_, near, (F.col("__n_a") == 1) & (F.col("__n_b") == 1))
    # One row on each side.
    return rows.crossJoin(pairs.agg(F.count_if(~same).alias("diferencias")))


def result_equivalence(a: DataFrame, b: DataFrame, keys: list[str] | None) -> DataFrame:
    """One row: row counts, differing rows, verdict.

    ``keys`` must identify a row; an empty list means one-row results. Without keys (None) the results are
    compared as multisets of rows. Results whose columns differ in name or type are never equivalent, and every row
    counts as different; the order of columns does not matter.
    """
    if _shape(a) != _shape(b):
        sides = a.select(F.lit("a").alias("side")).unionAll(b.select(F.lit("b").alias("side")))
        counts = sides.agg(
            F.count_if(F.col("side") == "a").alias("filas_a"), F.count_if(F.col("side") == "b").alias("filas_b")
        )
        return counts.withColumns({"diferencias": F.greatest("filas_a", "filas_b"), "equivalentes": F.lit(False)})
    counts = _as_multisets(a, b) if keys is None else _by_key(a, b, keys)
    same = (F.col("filas_a") == F.col("filas_b")) & (F.col("diferencias") == 0)
    return counts.withColumn("equivalentes", same)
