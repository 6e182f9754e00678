"""Every query by name, bound to the order tables through ``testbed.tables`` and ``testbed.layout``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial, reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.functions.semantics import round_to
from tripmart.operators.clean import clean_trips
from tripmart.operators.equivalence import result_equivalence
from tripmart.operators.sinks import materialize_indicators, subset_by_files
from tripmart.plans import audit
from tripmart.plans.dashboard import DASHBOARD
from tripmart.plans.eda import EDA
from tripmart.plans.evolution import EVOLUTION
from tripmart.plans.exploration import EXPLORATION, column_profile, first_by_type, random_sample
from tripmart.plans.incorporation import INCORPORATION
from tripmart.plans.from_footers import FROM_FOOTERS
from tripmart.plans.increments import Warehouse
from tripmart.plans.indicators import INDICATORS
from tripmart.plans.marts import indicator_builders
from tripmart.plans.month_profiles import merged_profile, month_profiles
from tripmart.plans.workload import RESULT_KEYS, WORKLOAD
from tripmart.session import configure, held, new_folder
from tripmart.sources.catalogue import footer_metadata, footer_schema
from tripmart.sources.files import file_listing
from tripmart.sources.raw import read_trips, scan_raw, sources_of_first_periods
from tripmart.sources.zones import read_zones
from tripmart.testbed import tables
from tripmart.testbed.layout import raw_layout, trips_table

Query = Callable[[SparkSession, str], DataFrame]

OVER_TRIPS = {**EXPLORATION, **EDA, **INCORPORATION, **WORKLOAD, **INDICATORS, **EVOLUTION, **DASHBOARD}
# These show sums, means and interpolated quantiles of doubles unrounded. Their last bits depend on
# the order of additions and on the processor, so a fixed number of digits is compared.
UNROUNDED = {
    "b2_agregado_por_tipo",
    "b3_viajes_por_hora",
    "b4_mensual_por_pago",
    "b6_filtro_selectivo",
    "b7_percentiles_tarifa",
    "q4_p8_valores_atipicos",
}
DIGITS = 4
FIRST_PERIODS = 12
# Numbers of first periods that the workload is compared on, besides all of them.
PERIOD_SUBSETS = (1, 3, 6, 12, 24)


def _over_trips(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    result = OVER_TRIPS[name](trips_table(spark, sf_dir), tables.zones(spark, sf_dir))
    if name not in UNROUNDED:
        return result
    doubles = [f.name for f in result.schema.fields if f.dataType.typeName() == "double"]
    return result.withColumns({c: round_to(F.col(c), DIGITS) for c in doubles})


def _over_files(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return {**audit.AUDIT, **FROM_FOOTERS}[name](spark, raw_layout(spark, sf_dir).raw)


def _base_name(path: str) -> F.Column:
    return F.regexp_extract(path, r"([a-z]+_tripdata_\d{4}-\d{2}\.parquet)$", 1)


def _period_totals(trips: DataFrame) -> DataFrame:
    return trips.groupBy("taxi_type", "src_year", "src_month").agg(
        F.count("*").alias("filas"), round_to(F.sum("total_amount"), 2).alias("total")
    )


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each type, by time so that the choice is repeatable."""
    configure(spark)
    order = ["pickup_ts", "dropoff_ts", "fare_amount", "trip_distance", "vendor_id", "total_amount"]
    return first_by_type(trips_table(spark, sf_dir), order=[F.col(c) for c in order])


def exact_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of the profile; distinct counts and quartiles are estimates."""
    configure(spark)
    profile = column_profile(trips_table(spark, sf_dir))
    return profile.select("column_name", "column_type", "min", "max", "count", "null_percentage")


def profile_of_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of a profile that is merged from stored profiles of all months."""
    configure(spark)
    path = new_folder(spark, "month-profiles")
    month_profiles(trips_table(spark, sf_dir)).write.parquet(path)
    merged = merged_profile(spark.read.parquet(path))
    return merged.select("column_name", "column_type", "min", "max", "count", "null_percentage")


def raw_rows(taxi_type: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return scan_raw(spark, raw_layout(spark, sf_dir).raw, taxi_type).withColumn("filename", _base_name("filename"))


def trips_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return read_trips(spark, raw_layout(spark, sf_dir).raw).withColumn("filename", _base_name("filename"))


def file_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = trips_from_files(spark, sf_dir)
    return trips.groupBy("filename", "src_year", "src_month").agg(F.count("*").alias("filas"))


def zones_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return read_zones(spark, raw_layout(spark, sf_dir).zones_csv)


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    files = file_listing(spark, raw_layout(spark, sf_dir).raw)
    return files.select(_base_name("source").alias("file_name")).distinct()


def footer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    meta = footer_metadata(spark, raw_layout(spark, sf_dir).raw)
    return meta.select(
        _base_name("file_name").alias("file_name"), "num_rows",
        (F.col("num_row_groups") >= 1).alias("con_grupos"), (F.col("file_size_bytes") > 0).alias("con_bytes"),
    )


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of q3_2c that does not depend on how files are encoded."""
    return _over_files("q3_2c_filas_por_archivo", spark, sf_dir).select("taxi_type", "periodo", "num_rows")


def sample_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the random sample, and how many of its distinct rows are trips."""
    configure(spark)
    trips = trips_table(spark, sf_dir)
    sample = held(random_sample(trips))
    same = reduce(and_, [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in sample.columns])
    # The sample's size is a parameter, far below any broadcast limit.
    found = trips.drop("filename").alias("t").join(F.broadcast(sample.alias("s")), same, "left_semi").distinct()
    return sample.agg(F.count("*").alias("filas")).crossJoin(found.agg(F.count("*").alias("encontradas")))


def footer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    columns = footer_schema(spark, raw_layout(spark, sf_dir).raw)
    return columns.select(_base_name("file_name").alias("file_name"), "name", "type")


def first_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the first twelve months, opening only their files."""
    configure(spark)
    raw = raw_layout(spark, sf_dir).raw
    return _period_totals(read_trips(spark, raw, sources_of_first_periods(spark, raw, FIRST_PERIODS)))


def table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return _period_totals(trips_table(spark, sf_dir))


def indicator_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ten indicators as tables, from three passes over the trips; rows of each and, as read back, the sum of each of its numbers."""
    configure(spark)
    trips, zones = trips_table(spark, sf_dir), read_zones(spark, raw_layout(spark, sf_dir).zones_csv)
    builds = indicator_builders(trips, zones, new_folder(spark, "indicator-cells"))
    written, failed = materialize_indicators(builds, new_folder(spark, "indicators"))
    if failed:
        raise RuntimeError(f"indicators failed: {failed}")
    return reduce(DataFrame.unionByName, [_column_sums(spark.read.parquet(path), name) for name, path in written.items()])


def incremental_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums from indicators that are kept up to date: twelve months are taken over first, then all files.

    Their means come from exact sums.
    """
    configure(spark)
    layout = raw_layout(spark, sf_dir)
    warehouse = Warehouse.at(spark, new_folder(spark, "warehouse"))
    warehouse.update(layout.raw, sources_of_first_periods(spark, layout.raw, FIRST_PERIODS))
    warehouse.update(layout.raw)
    builds = warehouse.indicators(read_zones(spark, layout.zones_csv))
    return reduce(DataFrame.unionByName, [_column_sums(build(), name) for name, build in builds.items()])


def _column_sums(table: DataFrame, name: str) -> DataFrame:
    numbers = [f.name for f in table.schema.fields if f.dataType.typeName() in ("integer", "long", "double")]
    sums = table.agg(F.count("*").alias("__rows"), *[round_to(F.sum(c), 2).alias(c) for c in numbers])
    lines = [F.struct(F.lit(c).alias("columna"), F.col(c).alias("suma")) for c in numbers]
    return sums.select(F.lit(name).alias("indicador"), F.col("__rows").alias("filas"), F.inline(F.array(*lines)))


def source_equivalence(spark: SparkSession, sf_dir: str, periods: int | None = None) -> DataFrame:
    """Does each workload query give the same result over raw files and over the table?

    Over all trips or those of the first ``periods`` months; of the raw files only theirs are opened.
    """
    configure(spark)
    raw, from_table = raw_layout(spark, sf_dir).raw, trips_table(spark, sf_dir)
    if periods is None:
        from_files = read_trips(spark, raw)
    else:
        sources = sources_of_first_periods(spark, raw, periods)
        from_files = read_trips(spark, raw, sources)
        from_table = subset_by_files(from_table, [source.rsplit("archivo=", 1)[1] for source in sources])
    verdicts = [
        result_equivalence(query(from_files), query(from_table), RESULT_KEYS[name]).withColumn("consulta", F.lit(name))
        for name, query in WORKLOAD.items()
    ]
    return reduce(DataFrame.unionByName, verdicts)


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the derived files against a made-up publication record, so that all states occur."""
    configure(spark)
    year = F.year("o_orderdate")
    span = tables.table(spark, sf_dir, "orders").agg(F.min(year).alias("first"), F.max(year).alias("last")).first()
    years, today = list(range(span["first"], span["last"] + 1)), date(span["last"], 12, 31)
    slot = F.split_part(F.col("periodo"), F.lit("-"), F.lit(2)).cast("int") % 6
    manifest = audit.expected_calendar(spark, years, today).select(
        "tipo",
        "periodo",
        F.when(slot != 3, slot != 4).alias("publicado"),
        F.when(slot == 5, F.lit(1)).cast("bigint").alias("bytes_remoto"),
    )
    return audit.completeness_audit(spark, raw_layout(spark, sf_dir).raw, manifest, years, today)


def audit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).drop("bytes_local")


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_summary(_audit(spark, sf_dir))


def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query straight from the order tables, without a table in between.

    It needs no zones, so neither the customer nor the supplier join is planned.
    """
    configure(spark)
    return INDICATORS["ind_02_ingreso_mensual"](tables.trips(spark, sf_dir, locations=False))


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return clean_trips(trips_table(spark, sf_dir))


def all_queries() -> dict[str, Query]:
    named: dict[str, Query] = {name: partial(_over_trips, name) for name in OVER_TRIPS}
    named |= {name: partial(_over_files, name) for name in (*audit.AUDIT, *FROM_FOOTERS)}
    named |= {
        "ind_02_ingreso_mensual": monthly_revenue,
        "q3_5b_primeros_por_tipo": first_rows,
        "q3_6_resumen_exacto": exact_profile,
        "q3_6_resumen_por_meses": profile_of_months,
        "scan_raw": partial(raw_rows, "yellow"),
        "scan_raw_green": partial(raw_rows, "green"),
        "normalize_trips": trips_from_files,
        "src_period": file_periods,
        "zones": zones_from_csv,
        "file_listing": listed_files,
        "footer_metadata": footer_rows,
        "footer_schema": footer_columns,
        "subset_by_files": first_periods,
        "materialize_trips": table_totals,
        "materialize_indicators": indicator_tables,
        "incremental_indicators": incremental_indicators,
        "result_equivalence": source_equivalence,
        **{f"result_equivalence_{n}": partial(source_equivalence, periods=n) for n in PERIOD_SUBSETS},
        "q3_2c_filas_exactas": file_rows,
        "q3_5_muestra_valida": sample_check,
        "completeness_audit": audit_states,
        "completeness_audit_resumen": audit_summary,
        "clean_trips": clean_rows,
    }
    return dict(sorted(named.items()))
