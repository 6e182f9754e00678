"""Small relational building blocks shared by the plans."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.functions.semantics import percent, round_to
from tripmart.session import held


def with_share(counts: DataFrame, within: list[str], name: str = "pct", count: str = "viajes") -> DataFrame:
    """Add each row's rounded percentage of its group's total.

    ``counts`` is already aggregated, so the window sees one row per category.
    """
    whole = F.sum(count).over(Window.partitionBy(*within))
    return counts.withColumn(name, round_to(percent(F.col(count), whole), 2))


def distinct_sorted(value: Column, when: Column | None = None) -> Column:
    """Aggregate: ascending list of distinct non-NULL values; NULL instead of an empty list."""
    chosen = value if when is None else F.when(when, value)
    values = F.sort_array(F.collect_set(chosen))
    return F.when(F.size(values) > 0, values)


def wide(cells: DataFrame, rows: list[str], column: str, value: Column, fill: int | float | None = None) -> DataFrame:
    """Turn one column's values into columns, one per value that occurs.

    The column list is data, so the cells, aggregated already, are looked at twice. Columns are ordered by value.
    """
    small = held(cells)
    names = [row[0] for row in small.select(column).distinct().orderBy(column).collect()]
    result = small.groupBy(*rows).pivot(column, names).agg(value)
    return result if fill is None else result.fillna(fill, [c for c in result.columns if c not in rows])


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First n rows by a total order: each task keeps n rows, no full sort."""
    return df.orderBy(*order).limit(n)


def in_order(result: DataFrame, *order: str) -> DataFrame:
    """A small result sorted; ``-`` before a column means from high to low. NULLs come last either way.

    Final rows are so few (months, types, bands) that one task sorts them; aggregation before it stays spread. A sort by
    ranges would run one more job to sample them.
    """
    columns = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order]
    return result.repartition(1).sortWithinPartitions(*columns)


def ordered(query: Callable[..., DataFrame], *order: str) -> Callable[..., DataFrame]:
    """The query with its result ``in_order``."""

    @wraps(query)
    def run(*args, **options) -> DataFrame:
        return in_order(query(*args, **options), *order)

    return run
