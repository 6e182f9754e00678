"""Exact interpolated quantiles that hold for groups of any size, in two passes over the data.

``percentile`` keeps every distinct value of a group in one task's memory. Here the first pass only
counts rows in buckets of the value axis (about 512 for each factor of e), combined map-side, so a
few thousand rows leave each task however many values there are. Running counts say which
buckets hold the wanted ranks. The second pass reads the columns again, keeps the rows of those buckets, counts
equal values, and cuts each bucket into equal steps between its bounds; only the steps that
hold a rank are sorted. A group whose values all lie in one bucket is thus still spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.session import held

_BUCKETS_PER_E_FOLD = 512
_STEPS = 256
_LAST = 2**63 - 1


def _cells(df: DataFrame, keys: list[str], measures: Mapping[str, Column], sums: Mapping[str, Column]) -> DataFrame:
    """One row (keys, measure, value, bucket, sums) for each row and measure; sums come with the first measure only."""
    structs = [
        F.struct(
            F.lit(name).alias("measure"),
            value.cast("double").alias("value"),
            *[(F.lit(None) if i else expr).cast("double").alias(total) for total, expr in sums.items()],
        )
        for i, (name, value) in enumerate(measures.items())
    ]
    if len(structs) == 1:
        rows = df.select(*keys, structs[0].alias("cell")).select(*keys, "cell.*")
    else:
        rows = df.select(*keys, F.inline(F.array(*structs)))
    return rows.withColumn("bucket", _bucket(F.col("value")))


def _bucket(value: Column) -> Column:
    """Never decreases as the value grows: about 512 buckets per factor of e."""
    signed_log = F.signum(value) * F.log1p(F.abs(value)) * F.lit(_BUCKETS_PER_E_FOLD)
    return F.when(F.isnan(value), F.lit(_LAST)).otherwise(F.floor(signed_log))


def _step(value: Column, low: Column, high: Column) -> Column:
    """One of equal steps between the bounds of a bucket; all in one where these are equal or not finite."""
    width = high - low
    cut = F.floor((value - low) / width * F.lit(_STEPS))
    return F.when((width > 0) & (width < F.lit(float("inf"))), cut).otherwise(F.lit(0))


# Conditions over many measures and ranks are written as SQL text: one call for each instead of dozens.


def _position(fraction: float) -> str:
    return f"(total - 1) * {float(fraction)!r}D"


def _holds(start: str, size: str, measure: str, rank: str) -> str:
    return f"(measure = '{measure}' AND {start} <= {rank} AND {rank} < {start} + {size})"


def _same(left: str, right: str, columns: list[str]) -> Column:
    return F.expr(" AND ".join(f"{left}.`{c}` <=> {right}.`{c}`" for c in columns))


def _located(df: DataFrame, keys: list[str], measures: Mapping[str, Column], wanted, sums) -> DataFrame:
    """Distinct values, with counts, of the steps that hold a wanted rank.

    Rows: keys, measure, bucket, step, value, n, total (values of the measure in the group), start (values before the step) and sums.
    """
    cell = [*keys, "measure", "bucket"]

    def needed(start: str, size: str) -> Column:
        ranks = [
            _holds(start, size, measure, f"{edge}({_position(fraction)})")
            for measure, fraction in sorted(set(wanted.values()))
            for edge in ("floor", "ceil")
        ]
        # A group of NULLs only has no bucket to look into but still gets its row.
        return F.expr(" OR ".join([*ranks, "bucket IS NULL"]))

    counts = _cells(df, keys, measures, sums).groupBy(*cell).agg(
        F.count("value").alias("size"), F.min("value").alias("low"), F.max("value").alias("high"),
        *[F.sum(name).alias(name) for name in sums],
    )
    series = Window.partitionBy(*keys, "measure")
    earlier = series.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.select(
        *cell, "size", "low", "high",
        F.sum("size").over(series).alias("total"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"),
        *[F.sum(name).over(Window.partitionBy(*keys)).alias(name) for name in sums],
    )
    chosen = held(buckets.where(needed("start", "size")).drop("size"))

    carried = ["total", "start", *sums]
    found = _cells(df, keys, measures, {}).alias("v").join(chosen.alias("c"), _same("v", "c", cell))
    values = (
        found.select(
            *[F.col(f"v.{c}").alias(c) for c in cell], "value", _step(F.col("value"), F.col("low"), F.col("high")).alias("step"), *carried
        )
        .groupBy(*cell, "step", "value", *carried)
        .agg(F.count("*").alias("n"))
    )
    before = Window.partitionBy(*cell).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = values.groupBy(*cell, "step", "total", "start").agg(F.sum("n").alias("step_n"))
    step_start = F.col("start") + F.coalesce(F.sum("step_n").over(before), F.lit(0))
    steps = steps.withColumn("step_start", step_start).where(needed("step_start", "step_n"))
    v, s = values.alias("v"), steps.select(*cell, "step", "step_start").alias("s")
    return v.join(s, _same("v", "s", [*cell, "step"])).select(
        *[F.col(f"v.{c}").alias(c) for c in [*cell, "step"]], "value", "n", "total", F.col("step_start").alias("start"), *sums
    )


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    measures: Mapping[str, Column],
    wanted: Mapping[str, tuple[str, float]],
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group with the wanted quantiles; NULL values are left out, a group of them alone has NULLs.

    ``wanted`` maps an output column to (measure, fraction). ``sums`` maps an output column to an
    expression that is summed, as a double, over all rows of the group in the same first pass.
    """
    sums = dict(sums or {})
    rows = _located(df, keys, measures, wanted, sums)
    inside = Window.partitionBy(*keys, "measure", "bucket", "step").orderBy("value")
    preceding = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.col("start") + F.coalesce(preceding, F.lit(0)))

    parts, results = [], []
    for name, (measure, fraction) in wanted.items():
        low, high, at = f"`{name}__low`", f"`{name}__high`", f"`{name}__at`"
        for end, edge in ((low, "floor"), (high, "ceil")):
            hit = _holds("start", "n", measure, f"{edge}({_position(fraction)})")
            parts.append(F.expr(f"max(CASE WHEN {hit} THEN value END) AS {end}"))
        parts.append(F.expr(f"max(CASE WHEN measure = '{measure}' THEN {_position(fraction)} END) AS {at}"))
        above = f"({at} - floor({at}))"
        # Equal neighbours need no interpolation, and two infinite ones allow none.
        results.append(
            F.expr(f"CASE WHEN {low} = {high} THEN {low} ELSE {low} * (1D - {above}) + {high} * {above} END AS `{name}`")
        )
    picked = rows.groupBy(*keys).agg(*parts, *[F.max(name).alias(name) for name in sums])
    return picked.select(*keys, *results, *sums)
