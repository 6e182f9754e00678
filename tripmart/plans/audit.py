"""File and schema audits: what is on disk, is it complete, and does its schema drift?"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.functions.semantics import round_to
from tripmart.operators.profile import type_name
from tripmart.operators.shaping import distinct_sorted, ordered
from tripmart.session import small_table
from tripmart.sources.catalogue import default_catalogue, footer_metadata, footer_schema, footers, readable
from tripmart.sources.files import NAME_PATTERN, TYPE_FOLDER_PATTERN, YEAR_FOLDER_PATTERN, file_listing
from tripmart.sources.raw import read_trips, scan_raw
from tripmart.sources.schema import TAXI_TYPES

PROBLEM_STATES = ("FALTA", "FALTA?", "TAMANO_DISTINTO", "ILEGIBLE")
MANIFEST_SCHEMA = "tipo string, periodo string, publicado boolean, bytes_remoto bigint"


def _folder(path: Column, pattern: str) -> Column:
    return F.regexp_extract(path, pattern, 1)


def _sources(spark: SparkSession, root: str) -> DataFrame:
    return file_listing(spark, root).select(F.col("source").alias("file_name")).distinct()


def files_by_type_year(spark: SparkSession, root: str) -> DataFrame:
    name = F.col("file_name")
    return _sources(spark, root).groupBy(
        _folder(name, TYPE_FOLDER_PATTERN).alias("taxi_type"), _folder(name, YEAR_FOLDER_PATTERN).alias("anio")
    ).agg(F.count("*").alias("archivos"))


def total_files(spark: SparkSession, root: str) -> DataFrame:
    return _sources(spark, root).agg(F.count("*").alias("total_archivos"))


def rows_footer_vs_scan(spark: SparkSession, root: str) -> DataFrame:
    now = default_catalogue(spark).snapshot(root)
    in_footers = readable(now.files).agg(F.sum("num_rows").alias("filas_segun_metadatos"))
    scanned = read_trips(spark, root, snapshot=now).agg(F.count("*").alias("filas_segun_conteo"))
    # One row on each side.
    return in_footers.crossJoin(scanned).withColumn(
        "coinciden", F.col("filas_segun_metadatos") == F.col("filas_segun_conteo")
    )


def rows_per_file(spark: SparkSession, root: str) -> DataFrame:
    name = F.col("file_name")
    return footer_metadata(spark, root).select(
        F.regexp_extract(name, NAME_PATTERN, 1).alias("taxi_type"),
        F.regexp_extract(name, NAME_PATTERN, 2).alias("periodo"),
        "num_rows",
        "num_row_groups",
        round_to(F.col("file_size_bytes") / 1048576.0, 1).alias("mib"),
    )


def raw_columns(spark: SparkSession, root: str, taxi_type: str) -> DataFrame:
    """Columns of the united raw files; all may be NULL."""
    fields = scan_raw(spark, root, taxi_type).drop("filename", "src_year", "src_month").schema.fields
    return small_table(
        spark,
        column_name=[field.name for field in fields],
        column_type=[type_name(field.dataType) for field in fields],
        nullable=["YES" for _ in fields],
    )


def schema_drift(spark: SparkSession, root: str) -> DataFrame:
    """Columns with several spellings, several physical types, or missing from some file."""
    columns = footer_schema(spark, root).withColumn("taxi_type", _folder(F.col("file_name"), TYPE_FOLDER_PATTERN))
    totals = columns.groupBy("taxi_type").agg(F.count_distinct("file_name").alias("archivos_totales"))
    per_column = columns.groupBy("taxi_type", F.lower("name").alias("columna")).agg(
        distinct_sorted(F.col("name")).alias("variantes_de_nombre"),
        distinct_sorted(F.col("type")).alias("tipos_fisicos"),
        F.count_distinct("file_name").alias("archivos_con_la_columna"),
    )
    # One row of totals per taxi type.
    compared = per_column.join(F.broadcast(totals), "taxi_type")
    return compared.where(
        (F.size("variantes_de_nombre") > 1)
        | (F.size("tipos_fisicos") > 1)
        | (F.col("archivos_con_la_columna") < F.col("archivos_totales"))
    )


def files_and_rows_by_year(spark: SparkSession, root: str) -> DataFrame:
    name = F.col("file_name")
    return footer_metadata(spark, root).groupBy(
        _folder(name, TYPE_FOLDER_PATTERN).alias("taxi_type"), _folder(name, YEAR_FOLDER_PATTERN).alias("anio")
    ).agg(F.count("*").alias("archivos"), F.sum("num_rows").alias("filas"))


def schema_by_year(spark: SparkSession, root: str) -> DataFrame:
    """Number of columns per type and year, and the charge columns among them."""
    path, column = F.col("file_name"), F.lower("name")
    is_charge = column.like("%fee") | column.like("%surcharge")
    return footer_schema(spark, root).groupBy(
        _folder(path, TYPE_FOLDER_PATTERN).alias("taxi_type"), _folder(path, YEAR_FOLDER_PATTERN).alias("anio")
    ).agg(
        F.count_distinct(column).alias("columnas"),
        distinct_sorted(column, when=is_charge).alias("columnas_de_cargos"),
    )


def expected_calendar(spark: SparkSession, years: list[int], today: date, types: tuple[str, ...] = TAXI_TYPES) -> DataFrame:
    """Every (type, month) of the years up to the current month."""
    months = small_table(spark, y=sorted(set(years))).select("y", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"))
    past = months.where(F.make_date(F.col("y").cast("int"), "m", F.lit(1)) <= F.lit(today))
    period = F.format_string("%d-%02d", "y", "m").alias("periodo")
    return past.select(F.explode(F.array(*[F.lit(t) for t in types])).alias("tipo"), period)


def completeness_audit(
    spark: SparkSession, root: str, manifest: DataFrame, years: list[int], today: date,
    types: tuple[str, ...] = TAXI_TYPES,
) -> DataFrame:
    """State of every expected monthly dataset.

    ``manifest`` (MANIFEST_SCHEMA) says what was published and how large it is; a period without a
    manifest row, or with a NULL, is unknown. Files of zero bytes count as absent.
    """
    name = F.col("source")
    present = (
        footers(spark, root)
        .where("file_size_bytes > 0")
        .groupBy(F.regexp_extract(name, NAME_PATTERN, 1).alias("tipo"), F.regexp_extract(name, NAME_PATTERN, 2).alias("periodo"))
        .agg(
            F.sum("file_size_bytes").alias("bytes_local"),
            F.every(F.col("readable")).alias("legible"),
            F.sum("num_rows").alias("num_rows"),
        )
    )
    # Both sides have at most one row per expected month.
    expected = expected_calendar(spark, years, today, types)
    joined = expected.join(present, ["tipo", "periodo"], "left").join(manifest, ["tipo", "periodo"], "left")
    exists, published = F.col("bytes_local").isNotNull(), F.col("publicado")
    other_size = published & (F.col("bytes_remoto") > 0) & (F.col("bytes_local") != F.col("bytes_remoto"))
    state = (
        F.when(exists & ~F.col("legible"), "ILEGIBLE")
        .when(exists & other_size, "TAMANO_DISTINTO")
        .when(exists & published.isNull(), "SOLO_LOCAL")
        .when(exists, "OK")
        .when(~published, "NO_PUBLICADO")
        .when(published, "FALTA")
        .otherwise("FALTA?")
    )
    rows = F.when(F.col("legible"), F.col("num_rows")).alias("filas")
    return joined.select("tipo", "periodo", state.alias("estado"), "bytes_local", "bytes_remoto", rows)


def audit_summary(audit: DataFrame) -> DataFrame:
    """Datasets and rows per state, and whether the state is a problem."""
    return audit.groupBy("estado").agg(
        F.count("*").alias("periodos"), F.coalesce(F.sum("filas"), F.lit(0)).alias("filas")
    ).withColumn("problema", F.col("estado").isin(*PROBLEM_STATES))


AUDIT = {
    "q3_1_archivos_por_tipo_anio": ordered(files_by_type_year, "taxi_type", "anio", "archivos"),
    "q3_1b_total_archivos": total_files,
    "q3_2b_registros_metadatos": rows_footer_vs_scan,
    "q3_2c_filas_por_archivo": ordered(rows_per_file, "taxi_type", "periodo"),
    "q3_3_columnas_yellow": lambda spark, root: raw_columns(spark, root, "yellow"),
    "q3_3_columnas_green": lambda spark, root: raw_columns(spark, root, "green"),
    "q3_4_deriva_de_esquema": ordered(schema_drift, "taxi_type", "columna"),
    "q5_1_archivos_por_anio": ordered(files_and_rows_by_year, "taxi_type", "anio", "archivos", "filas"),
    "q5_5_consistencia_esquema_por_anio": ordered(schema_by_year, "taxi_type", "anio", "columnas"),
}
