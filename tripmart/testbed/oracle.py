"""The same questions as SQL over the order tables, for checking results with another engine.

Written from the meaning of each query, not from the Spark plans: shares come from a join with
group totals, raw and clean counts from separate passes, common months from a counted set.
"""

from __future__ import annotations

from tripmart.functions import labels
from tripmart.plans.audit import PROBLEM_STATES

TRIPS = """
sourced AS (
  SELECT l.*, o.o_orderdate AS day, c.c_nationkey, s.s_nationkey,
         CASE WHEN l_linestatus = 'F' THEN 'yellow' ELSE 'green' END AS taxi_type,
         o.o_orderdate + to_seconds((l_orderkey * 37 + l_linenumber * 4001) % 86400) AS pickup_ts,
         CAST(o.o_orderdate AS DATE) + CASE WHEN l_partkey % 97 = 0 THEN 40 ELSE 0 END AS source_date,
         CASE WHEN l_partkey % 31 = 0 THEN -1.0E0 ELSE 1.0E0 END * (l_extendedprice / 1000) AS fare_amount,
         l_extendedprice / 1000 * l_tax AS tip_amount,
         CASE WHEN l_partkey % 11 = 0 THEN 6.94E0 ELSE 0.0E0 END AS tolls_amount
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
),
trips AS (
  SELECT taxi_type, CAST(l_suppkey % 3 AS INTEGER) AS vendor_id, pickup_ts,
         pickup_ts + to_seconds((l_partkey * 7 + l_linenumber * 613 + l_orderkey) % 24000 - 300) AS dropoff_ts,
         CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_quantity AS INTEGER) % 7 END AS passenger_count,
         l_quantity * l_discount * 25 AS trip_distance,
         CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_orderkey % 6 + 1 AS INTEGER) END AS ratecode_id,
         c_nationkey AS pu_location_id, s_nationkey AS do_location_id,
         CAST(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE l_orderkey % 5 END AS INTEGER) AS payment_type,
         fare_amount, tip_amount, tolls_amount,
         fare_amount + tip_amount + tolls_amount
           + CASE WHEN l_partkey % 211 = 0 THEN 1000.0E0 ELSE 0.0E0 END AS total_amount,
         CAST(year(source_date) AS INTEGER) AS src_year, CAST(month(source_date) AS INTEGER) AS src_month,
         taxi_type || strftime(source_date, '_tripdata_%Y-%m.parquet') AS filename
  FROM sourced
),
timed AS (
  SELECT *, epoch(date_trunc('second', dropoff_ts)) - epoch(date_trunc('second', pickup_ts)) AS secs FROM trips
),
ruled AS (
  SELECT *,
         date_trunc('month', pickup_ts) = make_date(src_year, src_month, 1) AS r1,
         dropoff_ts > pickup_ts AS r2,
         secs <= 21600 AS r3,
         trip_distance > 0 AND trip_distance <= 100 AS r4,
         fare_amount > 0 AS r5,
         total_amount > 0 AND total_amount <= 1000 AS r6
  FROM timed
),
kept AS (
  SELECT *, secs / 60.0E0 AS duration_min, make_date(src_year, src_month, 1) AS periodo,
         CAST(hour(pickup_ts) AS INTEGER) AS hora, CAST(isodow(pickup_ts) AS INTEGER) AS dow
  FROM ruled WHERE r1 AND r2 AND r3 AND r4 AND r5 AND r6
),
zones AS (
  SELECT n_nationkey AS location_id, r_name AS borough, n_name AS zone, 'N/A' AS service_zone
  FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey NOT IN (3, 7)
),
bands(orden, lo, hi, tramo_millas) AS (
  VALUES (1, 0, 1, '0-1'), (2, 1, 3, '1-3'), (3, 3, 5, '3-5'), (4, 5, 10, '5-10'), (5, 10, 20, '10-20'),
         (6, 20, 1e9, '20+')
),
banded AS (SELECT * FROM kept JOIN bands ON trip_distance >= lo AND trip_distance < hi),
even_months AS (
  SELECT m.src_month
  FROM (SELECT DISTINCT src_month FROM trips) m
  WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT DISTINCT src_year FROM trips) y
    WHERE (y.src_year, m.src_month) NOT IN (SELECT src_year, src_month FROM trips))
),
even AS (SELECT kept.* FROM kept SEMI JOIN even_months USING (src_month))"""

# Raw columns of the derived files: taxi type (NULL = both), name, physical type, first and last year.
FILE_COLUMNS = """
file_columns(only_type, name, type, from_year, to_year) AS (
  VALUES (NULL, 'VendorID', 'INT32', 0, 1996), (NULL, 'VendorID', 'INT64', 1997, 9999),
         ('yellow', 'tpep_pickup_datetime', 'INT64', 0, 9999), ('yellow', 'tpep_dropoff_datetime', 'INT64', 0, 9999),
         ('green', 'lpep_pickup_datetime', 'INT64', 0, 9999), ('green', 'lpep_dropoff_datetime', 'INT64', 0, 9999),
         (NULL, 'passenger_count', 'INT64', 0, 1996), (NULL, 'passenger_count', 'DOUBLE', 1997, 9999),
         (NULL, 'trip_distance', 'DOUBLE', 0, 9999),
         (NULL, 'RatecodeID', 'INT64', 0, 1996), (NULL, 'RatecodeID', 'DOUBLE', 1997, 9999),
         (NULL, 'store_and_fwd_flag', 'BYTE_ARRAY', 0, 9999),
         (NULL, 'PULocationID', 'INT32', 0, 9999), (NULL, 'DOLocationID', 'INT32', 0, 9999),
         (NULL, 'payment_type', 'INT64', 0, 9999), (NULL, 'fare_amount', 'DOUBLE', 0, 9999),
         (NULL, 'extra', 'DOUBLE', 0, 9999), (NULL, 'mta_tax', 'DOUBLE', 0, 9999),
         (NULL, 'tip_amount', 'DOUBLE', 0, 9999), (NULL, 'tolls_amount', 'DOUBLE', 0, 9999),
         (NULL, 'improvement_surcharge', 'DOUBLE', 0, 9999), (NULL, 'total_amount', 'DOUBLE', 0, 9999),
         (NULL, 'congestion_surcharge', 'DOUBLE', 0, 9999),
         ('yellow', 'Airport_fee', 'DOUBLE', 0, 1996), ('yellow', 'airport_fee', 'DOUBLE', 1997, 9999),
         ('green', 'ehail_fee', 'DOUBLE', 0, 9999), ('green', 'trip_type', 'INT64', 0, 9999),
         (NULL, 'cbd_congestion_fee', 'DOUBLE', 2000, 9999)
),
file_list AS (
  SELECT taxi_type, src_year, src_month, filename, count(*) AS num_rows FROM trips GROUP BY ALL
),
file_schema AS (
  SELECT f.taxi_type, f.src_year, f.filename AS file_name, c.name, c.type
  FROM file_list f JOIN file_columns c
    ON coalesce(c.only_type, f.taxi_type) = f.taxi_type AND f.src_year BETWEEN c.from_year AND c.to_year
)"""


def _sql(final: str, *ctes: str) -> str:
    return "WITH " + ",".join([TRIPS, *ctes]) + "\n" + final


def _shares(counts: str, within: str, columns: str, pct: str = "pct", count: str = "viajes") -> str:
    """Percentages of group totals; ``columns`` are further output columns."""
    return _sql(
        f"SELECT {columns}, {count}, round(100 * {count} / whole, 2) AS {pct} FROM counts JOIN wholes USING ({within})",
        f"counts AS ({counts})",
        f"wholes AS (SELECT {within}, sum({count}) AS whole FROM counts GROUP BY {within})",
    )


def _mean(column: str, name: str, digits: int = 2) -> str:
    return f"round(avg({column}), {digits}) AS {name}"


def _per_type(rows: str, *columns: str) -> str:
    return _sql(f"SELECT taxi_type, {', '.join(columns)} FROM {rows} GROUP BY taxi_type")


def _kept_monthly(*columns: str, where: str = "true") -> str:
    return _sql(f"SELECT taxi_type, periodo, {', '.join(columns)} FROM kept WHERE {where} GROUP BY taxi_type, periodo")




def _case(names: dict[int, str], default: str) -> str:
    lines = " ".join(f"WHEN {code} THEN '{name}'" for code, name in names.items())
    return f"CASE payment_type {lines} ELSE '{default}' END"


def _count(condition: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {condition}) AS {name}"


GROUP_NAMES = _case(labels.PAYMENT_GROUPS, labels.PAYMENT_GROUP_DEFAULT)
DAY_KIND = "if(dow IN (6, 7), 'fin de semana', 'laboral')"
MPH = "trip_distance / (duration_min / 60.0E0)"
TIP = "tip_amount / fare_amount"
ANNUAL_GROUPS = f"SELECT taxi_type, src_year, {GROUP_NAMES} AS metodo, count(*) AS viajes FROM kept GROUP BY ALL"
BAND_COUNTS = "SELECT taxi_type, tramo_millas, orden, count(*) AS viajes FROM banded GROUP BY ALL"


def _indicators() -> dict[str, str]:
    return {
        "ind_01_viajes_mensuales": _kept_monthly("count(*) AS viajes"),
        "ind_02_ingreso_mensual": _kept_monthly(
            "round(sum(total_amount), 2) AS ingreso_total", _mean("total_amount", "ingreso_por_viaje")
        ),
        "ind_03_demanda_por_hora": _shares(
            f"SELECT taxi_type, {DAY_KIND} AS dia_tipo, hora, count(*) AS viajes FROM kept GROUP BY ALL",
            "taxi_type, dia_tipo", "taxi_type, dia_tipo, hora", "pct_viajes",
        ),
        "ind_04_viaje_tipico_mensual": _kept_monthly(
            _mean("fare_amount", "tarifa_media"), _mean("trip_distance", "distancia_media_mi"),
            _mean("duration_min", "duracion_media_min", 1),
        ),
        "ind_05_metodo_pago_anual": _shares(ANNUAL_GROUPS, "taxi_type, src_year", "taxi_type, src_year, metodo"),
        "ind_06_propina_mensual": _kept_monthly(
            f"round(100 * avg({TIP}), 2) AS pct_propina_medio",
            "round(100 * count(*) FILTER (WHERE tip_amount = 0) / count(*), 2) AS pct_sin_propina",
            where="payment_type = 1",
        ),
        "ind_07_distribucion_distancia": _shares(BAND_COUNTS, "taxi_type", "taxi_type, tramo_millas, orden"),
        "ind_08_top_zonas_recogida": _sql(
            """SELECT c.taxi_type, CAST(1 + (SELECT count(*) FROM counts x WHERE x.taxi_type = c.taxi_type
                 AND (x.viajes > c.viajes OR x.viajes = c.viajes AND x.location_id < c.location_id)) AS INTEGER) AS posicion,
               c.location_id, ifnull(zone, concat('Zona ', c.location_id)) AS zona, ifnull(borough, 'N/D') AS borough,
               c.viajes, round(100 * c.viajes / (SELECT sum(viajes) FROM counts x WHERE x.taxi_type = c.taxi_type), 2) AS pct
               FROM counts c LEFT JOIN zones USING (location_id) WHERE posicion <= 10""",
            "counts AS (SELECT taxi_type, pu_location_id AS location_id, count(*) AS viajes FROM kept GROUP BY ALL)",
        ),
        "ind_09_velocidad_por_hora": _sql(
            f"SELECT taxi_type, hora, round(avg({MPH}), 2) AS velocidad_media_mph, count(*) AS viajes "
            "FROM kept WHERE secs >= 60 GROUP BY taxi_type, hora"
        ),
        "ind_10_calidad_mensual": _sql(
            """SELECT taxi_type, make_date(src_year, src_month, 1) AS periodo, count(*) AS registros,
               count(*) FILTER (WHERE ok) AS conservados,
               round(100 * (count(*) - count(*) FILTER (WHERE ok)) / count(*), 2) AS pct_descartado
               FROM (SELECT *, r1 AND r2 AND r3 AND r4 AND r5 AND r6 AS ok FROM ruled)
               GROUP BY taxi_type, src_year, src_month"""
        ),
    }


def _exact_sum(column: str) -> str:
    """The sum in whole steps of 2^-64, added as integers of 128 bits; by way of its digits it becomes the nearest double."""
    return f"(CAST(CAST(sum(CAST(({column}) * pow(2, 64) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 64))"


def _exact_indicators() -> dict[str, str]:
    """The indicators with sums and means that do not depend on the order of rows."""
    found = _indicators()
    for column in ("total_amount", "fare_amount", "trip_distance", "duration_min", TIP, MPH):
        for name, sql in found.items():
            mean = f"({_exact_sum(column)} / count({column}))"
            found[name] = sql.replace(f"avg({column})", mean).replace(f"sum({column})", _exact_sum(column))
    return found


# The columns with numbers of each indicator.
INDICATOR_NUMBERS = {
    "ind_01_viajes_mensuales": "viajes",
    "ind_02_ingreso_mensual": "ingreso_total ingreso_por_viaje",
    "ind_03_demanda_por_hora": "hora viajes pct_viajes",
    "ind_04_viaje_tipico_mensual": "tarifa_media distancia_media_mi duracion_media_min",
    "ind_05_metodo_pago_anual": "src_year viajes pct",
    "ind_06_propina_mensual": "pct_propina_medio pct_sin_propina",
    "ind_07_distribucion_distancia": "orden viajes pct",
    "ind_08_top_zonas_recogida": "posicion location_id viajes pct",
    "ind_09_velocidad_por_hora": "hora velocidad_media_mph viajes",
    "ind_10_calidad_mensual": "registros conservados pct_descartado",
}


def _exploration() -> dict[str, str]:
    profiled = [
        ("pickup_ts", "TIMESTAMP"), ("dropoff_ts", "TIMESTAMP"), ("passenger_count", "INTEGER"),
        ("trip_distance", "DOUBLE"), ("ratecode_id", "INTEGER"), ("payment_type", "INTEGER"), ("fare_amount", "DOUBLE"),
        ("tip_amount", "DOUBLE"), ("tolls_amount", "DOUBLE"), ("total_amount", "DOUBLE"),
    ]

    def profile_line(name: str, kind: str) -> str:
        zero = " + 0.0E0" if kind == "DOUBLE" else ""
        return (
            f"SELECT '{name}' AS column_name, '{kind}' AS column_type, CAST(min({name}){zero} AS VARCHAR) AS min, "
            f"CAST(max({name}){zero} AS VARCHAR) AS max, count(*) AS count, "
            f"round(100 * count(*) FILTER (WHERE {name} IS NULL) / count(*), 2) AS null_percentage FROM trips"
        )

    def nulls(column: str, name: str) -> str:
        return _count(f"{column} IS NULL", name)

    def codes(column: str) -> str:
        return (
            f"SELECT '{column}' AS campo, {column}::VARCHAR AS valor, taxi_type, count(*) AS registros "
            f"FROM trips GROUP BY {column}, taxi_type"
        )

    visible = (
        "taxi_type, vendor_id, pickup_ts, dropoff_ts, passenger_count, trip_distance, ratecode_id, pu_location_id, "
        "do_location_id, payment_type, fare_amount, tip_amount, tolls_amount, total_amount, src_year, src_month"
    )
    return {
        "q3_2_registros_por_tipo_anio": _sql(
            "SELECT taxi_type, src_year, count(*) AS registros FROM trips GROUP BY taxi_type, src_year"
        ),
        "q3_5b_primeros_por_tipo": _sql(
            f"""SELECT {visible} FROM (SELECT *, row_number() OVER (PARTITION BY taxi_type ORDER BY pickup_ts, dropoff_ts,
                fare_amount, trip_distance, vendor_id, total_amount) AS n FROM trips) WHERE n <= 5"""
        ),
        "q3_6_resumen_exacto": _sql(" UNION ALL ".join(profile_line(n, k) for n, k in profiled)),
        "q3_6b_nulos_por_tipo": _per_type(
            "trips", "count(*) AS registros", nulls("passenger_count", "passenger_count_nulos"),
            nulls("ratecode_id", "ratecode_nulos"), nulls("payment_type", "payment_type_nulos"),
            nulls("pickup_ts", "pickup_nulos"), nulls("dropoff_ts", "dropoff_nulos"),
        ),
        "q3_6c_anomalias_basicas": _per_type(
            "ruled", "count(*) AS registros", _count("NOT r1", "fuera_del_periodo_del_archivo"),
            _count("dropoff_ts < pickup_ts", "llegada_antes_de_salida"),
            _count("datediff('hour', pickup_ts, dropoff_ts) > 24", "duracion_mayor_24h"),
            _count("trip_distance = 0", "distancia_cero"), _count("trip_distance > 100", "distancia_mayor_100mi"),
            _count("fare_amount < 0", "tarifa_negativa"), _count("total_amount <= 0", "total_no_positivo"),
            _count("passenger_count = 0", "pasajeros_cero"), _count("passenger_count IS NULL", "pasajeros_nulo"),
            _count("payment_type = 0 OR payment_type > 6", "pago_fuera_de_catalogo"),
        ),
        "q3_7_rango_fechas": _sql(
            """SELECT taxi_type, src_year, src_month, min(pickup_ts) AS primera_recogida,
               max(pickup_ts) AS ultima_recogida, count(*) AS registros
               FROM trips GROUP BY taxi_type, src_year, src_month"""
        ),
        "q3_7b_catalogos": _sql(f"{codes('payment_type')} UNION ALL {codes('ratecode_id')}"),
    }


def _eda() -> dict[str, str]:
    def quantile(column: str, fraction: float, name: str, digits: int) -> str:
        return f"round(quantile_cont({column}, {fraction}), {digits}) AS {name}"

    def broken(rule: str, name: str) -> str:
        return _count(f"NOT {rule}", name)

    hourly = "SELECT taxi_type, hora, count(*) AS viajes FROM kept GROUP BY taxi_type, hora"
    return {
        "q4_p1_viajes_mensuales": _sql(
            f"""SELECT taxi_type, src_year, src_month, count(*) AS viajes, round(sum(total_amount)) AS ingreso_total,
                {_mean('total_amount', 'total_medio')} FROM kept GROUP BY taxi_type, src_year, src_month"""
        ),
        "q4_p1b_viajes_diarios": _sql(
            """SELECT taxi_type, dia, strftime(dia, '%A') AS dia_semana, viajes, round(z, 2) AS z_score FROM (
                 SELECT days.*, CASE WHEN sd <> 0 THEN (viajes - mean) / sd END AS z FROM days JOIN months USING (taxi_type, month))
               ORDER BY round(abs(z), 9) DESC NULLS LAST, taxi_type, dia LIMIT 15""",
            """days AS (SELECT taxi_type, pickup_ts::DATE AS dia, date_trunc('month', pickup_ts)::DATE AS month,
                 count(*) AS viajes FROM kept GROUP BY ALL)""",
            "months AS (SELECT taxi_type, month, avg(viajes) AS mean, stddev_pop(viajes) AS sd FROM days GROUP BY ALL)",
        ),
        "q4_p2_demanda_por_hora": _shares(hourly, "taxi_type", "taxi_type, hora", "pct_viajes"),
        "q4_p3_demanda_dia_semana": _sql(
            f"""SELECT taxi_type, dow AS dia_iso, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday',
                'Sunday'][dow] AS dia, count(*) AS viajes, {_mean('total_amount', 'total_medio')},
                {_mean('trip_distance', 'distancia_media')} FROM kept GROUP BY taxi_type, dow"""
        ),
        "q4_p4_caracteristicas_viaje": _per_type(
            "kept", quantile("trip_distance", 0.05, "dist_p05", 2), quantile("trip_distance", 0.5, "dist_mediana", 2),
            quantile("trip_distance", 0.95, "dist_p95", 2), quantile("trip_distance", 0.99, "dist_p99", 2),
            quantile("duration_min", 0.5, "dur_min_mediana", 1), quantile("duration_min", 0.95, "dur_min_p95", 1),
            quantile("fare_amount", 0.5, "tarifa_mediana", 2), quantile("fare_amount", 0.95, "tarifa_p95", 2),
        ),
        "q4_p4b_pasajeros": _shares(
            "SELECT taxi_type, ifnull(passenger_count::VARCHAR, 'NULL') AS pasajeros, count(*) AS viajes FROM kept GROUP BY ALL",
            "taxi_type", "taxi_type, pasajeros",
        ),
        "q4_p5_amarillo_vs_verde": _per_type(
            "kept", "count(*) AS viajes", _mean("trip_distance", "distancia_media_mi"),
            _mean("duration_min", "duracion_media_min", 1), _mean(MPH, "velocidad_media_mph", 1),
            _mean("fare_amount", "tarifa_media"), _mean("total_amount", "total_medio"),
            _mean("tip_amount", "propina_media"), _mean("passenger_count", "pasajeros_medios"),
        ),
        "q4_p6_metodos_de_pago": _shares(
            f"SELECT taxi_type, payment_type, count(*) AS viajes, {_mean('tip_amount', 'propina_media')} FROM kept GROUP BY 1, 2",
            "taxi_type",
            f"""taxi_type, payment_type, {_case(labels.PAYMENT_LABELS, labels.PAYMENT_LABEL_DEFAULT)} AS metodo, propina_media""",
        ),
        "q4_p6b_propina_tarjeta": _sql(
            f"""SELECT taxi_type, src_year, round(avg({TIP}) * 100, 2) AS pct_propina_medio,
                round(median({TIP}) * 100, 2) AS pct_propina_mediana,
                round(100 * count(*) FILTER (WHERE tip_amount = 0) / count(*), 2) AS pct_sin_propina
                FROM kept WHERE payment_type = 1 GROUP BY taxi_type, src_year"""
        ),
        "q4_p7_histograma_tarifa": _sql(
            """SELECT taxi_type, CASE WHEN fare_amount >= 100 THEN 100 ELSE CAST(floor(fare_amount / 5) * 5 AS INTEGER) END
               AS tarifa_desde, count(*) AS viajes FROM kept GROUP BY ALL"""
        ),
        "q4_p7b_histograma_distancia": _sql(
            """SELECT taxi_type, CASE WHEN trip_distance >= 20 THEN 20 ELSE CAST(floor(trip_distance) AS INTEGER) END
               AS milla_desde, count(*) AS viajes FROM kept GROUP BY ALL"""
        ),
        "q4_p8_valores_atipicos": _sql(
            f"""SELECT taxi_type, count(*) AS viajes, round(max(lf), 4) AS limite_tarifa,
                count(*) FILTER (WHERE fare_amount > lf) AS tarifas_atipicas, round(max(ld), 4) AS limite_distancia,
                count(*) FILTER (WHERE trip_distance > ld) AS distancias_atipicas,
                count(*) FILTER (WHERE {MPH} > 80) AS velocidad_mayor_80mph,
                count(*) FILTER (WHERE {MPH} < 1) AS velocidad_menor_1mph
                FROM kept JOIN fences USING (taxi_type) GROUP BY taxi_type""",
            """quarts AS (SELECT taxi_type, quantile_cont(fare_amount, [0.25, 0.75]) AS f,
                 quantile_cont(trip_distance, [0.25, 0.75]) AS d FROM kept GROUP BY taxi_type)""",
            "fences AS (SELECT taxi_type, f[2] + 3 * (f[2] - f[1]) AS lf, d[2] + 3 * (d[2] - d[1]) AS ld FROM quarts)",
        ),
        "q4_p8b_top_extremos": _sql(
            """SELECT taxi_type, pickup_ts, dropoff_ts, trip_distance, fare_amount, total_amount, payment_type FROM trips
               ORDER BY fare_amount DESC NULLS LAST, taxi_type, pickup_ts, dropoff_ts, trip_distance, total_amount, payment_type
               LIMIT 10"""
        ),
        "q4_p9_reglas_limpieza": _per_type(
            "ruled",
            "count(*) AS registros", broken("r1", "r1_fuera_de_periodo"), broken("r2", "r2_llegada_no_posterior"),
            broken("r3", "r3_duracion_mayor_6h"), broken("r4", "r4_distancia_invalida"),
            broken("r5", "r5_tarifa_no_positiva"), broken("r6", "r6_total_invalido"),
            _count("r1 AND r2 AND r3 AND r4 AND r5 AND r6", "registros_conservados"),
        ),
        "q4_p10_tarifa_por_milla": _sql(
            """SELECT taxi_type, tramo_millas, count(*) AS viajes, round(median(fare_amount), 2) AS tarifa_mediana,
               round(avg(fare_amount / trip_distance), 2) AS tarifa_por_milla_media FROM banded GROUP BY taxi_type, tramo_millas"""
        ),
        "q4_p11_zonas_recogida": _shares(
            """SELECT taxi_type, ifnull(borough, 'Sin zona') AS borough, count(*) AS viajes
               FROM kept LEFT JOIN zones ON location_id = pu_location_id GROUP BY ALL""",
            "taxi_type", "taxi_type, borough",
        ),
    }


def _incorporation() -> dict[str, str]:
    return {
        "q5_2_consulta_conjunta_por_mes": _sql(
            "SELECT * FROM (PIVOT cells ON anio IN (1995, 1996, 1997, 1998, 1999, 2000, 2001) USING sum(n)::BIGINT GROUP BY taxi_type, mes)",
            """cells AS (SELECT taxi_type, mes, anio, count(filename) AS n
                 FROM (SELECT DISTINCT taxi_type, src_month AS mes FROM trips)
                 CROSS JOIN (SELECT DISTINCT src_year AS anio FROM trips)
                 LEFT JOIN (SELECT taxi_type, src_month AS mes, src_year AS anio, filename FROM trips)
                   USING (taxi_type, mes, anio) GROUP BY ALL)""",
        ),
        "q5_3_sin_archivos_duplicados": _sql(
            """SELECT taxi_type, src_year, src_month, count(*) AS archivos
               FROM (SELECT DISTINCT taxi_type, src_year, src_month, filename FROM trips)
               GROUP BY taxi_type, src_year, src_month HAVING archivos > 1"""
        ),
        "q5_4_meses_presentes": _sql(
            """SELECT taxi_type, src_year, count(*) AS meses_presentes, list(src_month ORDER BY src_month) AS meses
               FROM (SELECT DISTINCT taxi_type, src_year, src_month FROM trips) GROUP BY taxi_type, src_year"""
        ),
    }


def _workload(rows: str = "trips") -> dict[str, str]:
    def rounded(expression: str, name: str) -> str:
        return f"round({expression}, 4) AS {name}"

    return {
        "b1_conteo": _sql(f"SELECT count(*) AS viajes FROM {rows}"),
        "b2_agregado_por_tipo": _per_type(
            rows, "count(*) AS viajes", rounded("avg(fare_amount)", "tarifa_media"),
            rounded("avg(trip_distance)", "distancia_media"), rounded("sum(total_amount)", "ingreso_total"),
        ),
        "b3_viajes_por_hora": _sql(
            f"""SELECT taxi_type, date_part('hour', pickup_ts)::INTEGER AS hora, count(*) AS viajes,
                {rounded('avg(total_amount)', 'total_medio')} FROM {rows} GROUP BY 1, 2"""
        ),
        "b4_mensual_por_pago": _sql(
            f"""SELECT taxi_type, src_year, src_month, payment_type, count(*) AS viajes,
                {rounded('sum(total_amount)', 'ingreso')}, {rounded('avg(tip_amount)', 'propina_media')}
                FROM {rows} GROUP BY 1, 2, 3, 4"""
        ),
        "b5_top_pares_de_zonas": _sql(
            f"""SELECT pu_location_id, do_location_id, count(*) AS viajes FROM {rows} GROUP BY 1, 2
               ORDER BY 3 DESC, 1 NULLS LAST, 2 NULLS LAST LIMIT 20"""
        ),
        "b6_filtro_selectivo": _sql(
            f"""SELECT count(*) AS viajes, {rounded('avg(total_amount)', 'total_medio')},
                {rounded('max(total_amount)', 'total_max')} FROM {rows} WHERE trip_distance < 1 AND total_amount > 150"""
        ),
        "b7_percentiles_tarifa": _sql(
            f"""SELECT taxi_type, {rounded('q[1]', 'mediana')}, {rounded('q[2]', 'p90')}, {rounded('q[3]', 'p99')} FROM (
                 SELECT taxi_type, quantile_cont(fare_amount, [0.5, 0.9, 0.99]) AS q FROM {rows}
                 WHERE fare_amount > 0 GROUP BY taxi_type)"""
        ),
    }


def _evolution() -> dict[str, str]:
    return {
        "q8_0_meses_comunes": _sql(
            """SELECT taxi_type, src_month, count(*) AS anios_con_datos, list(src_year ORDER BY src_year) AS anios
               FROM (SELECT DISTINCT taxi_type, src_month, src_year FROM trips) GROUP BY taxi_type, src_month"""
        ),
        "q8_1_resumen_anual_mismos_meses": _sql(
            f"""SELECT taxi_type, src_year, count(*) AS viajes, round(sum(total_amount)) AS ingreso_total,
                {_mean('fare_amount', 'tarifa_media')}, {_mean('trip_distance', 'distancia_media_mi')},
                {_mean('duration_min', 'duracion_media_min', 1)},
                round(100 * count(*) FILTER (WHERE payment_type = 1) / count(*), 2) AS pct_tarjeta,
                round(100 * avg(CASE WHEN payment_type = 1 THEN {TIP} END), 2) AS pct_propina_tarjeta
                FROM even GROUP BY taxi_type, src_year"""
        ),
        "q8_2_variacion_interanual": _sql(
            """SELECT a.taxi_type, a.src_year, a.n AS viajes, round(100.0 * (a.n - b.n) / b.n, 2) AS var_viajes_pct,
               round(100.0 * (a.f - b.f) / b.f, 2) AS var_tarifa_pct, round(100.0 * (a.d - b.d) / b.d, 2) AS var_distancia_pct
               FROM years a LEFT JOIN years b ON b.taxi_type = a.taxi_type AND b.src_year =
                 (SELECT max(src_year) FROM years p WHERE p.taxi_type = a.taxi_type AND p.src_year < a.src_year)""",
            """years AS (SELECT taxi_type, src_year, count(*) AS n, avg(fare_amount) AS f, avg(trip_distance) AS d
                 FROM even GROUP BY taxi_type, src_year)""",
        ),
        "q8_3_hora_pico_por_anio": _sql(
            """SELECT taxi_type, src_year, peak AS hora_pico, top AS viajes, round(100 * top / whole, 2) AS pct_del_dia
               FROM (SELECT taxi_type, src_year, arg_min(hora, (-n, hora)) AS peak, max(n) AS top, sum(n) AS whole
                     FROM hours GROUP BY taxi_type, src_year)""",
            "hours AS (SELECT taxi_type, src_year, hora, count(*) AS n FROM even GROUP BY ALL)",
        ),
        "q8_4_mezcla_de_pago_por_anio": _shares(
            "SELECT taxi_type, src_year, payment_type, count(*) AS viajes FROM even GROUP BY ALL",
            "taxi_type, src_year", "taxi_type, src_year, payment_type",
        ),
        "q8_5_calidad_por_anio": _sql(
            """SELECT a.taxi_type, a.src_year, a.n AS registros, k.n AS conservados, round(100 * (a.n - k.n) / a.n, 2) AS pct_descartado
               FROM (SELECT taxi_type, src_year, count(*) AS n FROM trips SEMI JOIN even_months USING (src_month) GROUP BY ALL) a,
                    (SELECT taxi_type, src_year, count(*) AS n FROM even GROUP BY ALL) k
               WHERE a.taxi_type = k.taxi_type AND a.src_year = k.src_year"""
        ),
        "q8_6_participacion_verde": _sql(
            """SELECT periodo, count(*) FILTER (WHERE taxi_type = 'yellow') AS viajes_amarillos,
               count(*) FILTER (WHERE taxi_type = 'green') AS viajes_verdes,
               round(100 * count(*) FILTER (WHERE taxi_type = 'green') / count(*), 3) AS pct_verdes FROM kept GROUP BY periodo"""
        ),
    }


def _dashboard() -> dict[str, str]:
    shares = "shares AS (SELECT *, round(100 * viajes / sum(viajes) OVER (PARTITION BY {0}), 2) AS pct FROM counts)"
    return {
        "dash_kpis": _sql(
            """SELECT (SELECT min(periodo) FROM kept) AS primer_periodo, (SELECT max(periodo) FROM kept) AS ultimo_periodo,
               (SELECT count(*) FROM kept WHERE taxi_type = 'yellow') AS viajes_yellow,
               (SELECT round(sum(amount), 2) FROM months WHERE taxi_type = 'yellow') AS ingreso_yellow,
               (SELECT count(*) FROM kept WHERE taxi_type = 'green') AS viajes_green,
               (SELECT round(sum(amount), 2) FROM months WHERE taxi_type = 'green') AS ingreso_green,
               round(100 * ((SELECT count(*) FROM trips) - (SELECT count(*) FROM kept)) / (SELECT count(*) FROM trips), 2)
                 AS pct_descartado""",
            "months AS (SELECT taxi_type, periodo, round(sum(total_amount), 2) AS amount FROM kept GROUP BY ALL)",
        ),
        "dash_payment_pivot": _sql(
            "SELECT * FROM (PIVOT cells ON metodo IN ('tarjeta', 'efectivo', 'sin cargo', 'disputa', 'otro/desconocido') USING coalesce(sum(pct), 0) GROUP BY grupo)",
            f"counts AS ({ANNUAL_GROUPS})",
            shares.format("taxi_type, src_year"),
            "cells AS (SELECT taxi_type || ' ' || src_year AS grupo, metodo, pct FROM shares)",
        ),
        "dash_distance_pivot": _sql(
            "SELECT * FROM (PIVOT cells ON taxi_type IN ('green', 'yellow') USING any_value(pct) GROUP BY orden, tramo_millas)",
            f"counts AS ({BAND_COUNTS})",
            shares.format("taxi_type"),
            "cells AS (SELECT orden, tramo_millas, taxi_type, pct FROM shares)",
        ),
        "dash_trips_pivot": _sql(
            "SELECT * FROM (PIVOT cells ON taxi_type IN ('green', 'yellow') USING any_value(n) GROUP BY periodo)",
            "cells AS (SELECT periodo, taxi_type, count(*) AS n FROM kept GROUP BY ALL)",
        ),
    }


def _files() -> dict[str, str]:
    def raw_rows(taxi_type: str) -> str:
        prefix = {"yellow": "tpep", "green": "lpep"}[taxi_type]
        own = (
            "1.75E0 AS Airport_fee" if taxi_type == "yellow" else "CAST(NULL AS DOUBLE) AS ehail_fee, 1::BIGINT AS trip_type"
        )
        return f"""SELECT vendor_id::BIGINT AS VendorID, pickup_ts AS {prefix}_pickup_datetime,
            dropoff_ts AS {prefix}_dropoff_datetime, passenger_count::DOUBLE AS passenger_count, trip_distance,
            ratecode_id::DOUBLE AS RatecodeID, 'N' AS store_and_fwd_flag, pu_location_id AS PULocationID,
            do_location_id AS DOLocationID, payment_type::BIGINT AS payment_type, fare_amount, 0.0E0 AS extra,
            0.5E0 AS mta_tax, tip_amount, tolls_amount, 1.0E0 AS improvement_surcharge, total_amount,
            2.5E0 AS congestion_surcharge, {own},
            CASE WHEN src_year >= 2000 THEN 0.75E0 END AS cbd_congestion_fee, src_year, src_month, filename
            FROM trips WHERE taxi_type = '{taxi_type}'"""

    def described(taxi_type: str) -> str:
        rows = _sql(f"SELECT * EXCLUDE (src_year, src_month, filename) FROM ({raw_rows(taxi_type)})")
        return f"SELECT column_name, column_type, \"null\" AS nullable FROM (DESCRIBE {rows})"

    def with_files(final: str, *ctes: str) -> str:
        return _sql(final, FILE_COLUMNS, *ctes)

    totals = "SELECT taxi_type, src_year, src_month, count(*) AS filas, round(sum(total_amount), 2) AS total FROM {0} GROUP BY 1, 2, 3"
    audit = """audited AS (
        SELECT tipo, periodo,
          CASE WHEN f.filename IS NULL THEN CASE slot WHEN 3 THEN 'FALTA?' WHEN 4 THEN 'NO_PUBLICADO' ELSE 'FALTA' END
               ELSE CASE slot WHEN 3 THEN 'SOLO_LOCAL' WHEN 5 THEN 'TAMANO_DISTINTO' ELSE 'OK' END END AS estado,
          CASE slot WHEN 5 THEN 1::BIGINT END AS bytes_remoto, f.num_rows AS filas
        FROM (SELECT tipo, y, m, m % 6 AS slot, printf('%d-%02d', y, m) AS periodo
              FROM (VALUES ('yellow'), ('green')) t(tipo), generate_series(1, 12) g(m),
                   (SELECT unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)))) AS y FROM orders)) e
        LEFT JOIN file_list f ON f.taxi_type = e.tipo AND f.src_year = e.y AND f.src_month = e.m)"""
    def first(periods: int) -> str:
        return f"""(SELECT * FROM trips SEMI JOIN (SELECT DISTINCT src_year, src_month FROM trips ORDER BY ALL LIMIT {periods})
            USING (src_year, src_month))"""

    def verdicts(rows: str) -> str:
        return " UNION ALL ".join(
            f"SELECT '{name}' AS consulta, count(*) AS filas_a, count(*) AS filas_b, 0::BIGINT AS diferencias, true AS equivalentes "
            f"FROM ({sql})"
            for name, sql in _workload(rows).items()
        )

    def tables(indicators: dict[str, str]) -> str:
        return " UNION ALL ".join(
            f"SELECT '{name}' AS indicador, (SELECT count(*) FROM ({sql})) AS filas, '{column}' AS columna, "
            f"(SELECT round(CAST(sum({column}) AS DOUBLE), 2) FROM ({sql})) AS suma"
            for name, sql in indicators.items()
            for column in INDICATOR_NUMBERS[name].split()
        )

    return {
        "q3_1_archivos_por_tipo_anio": with_files(
            "SELECT taxi_type, src_year::VARCHAR AS anio, count(*) AS archivos FROM file_list GROUP BY taxi_type, src_year"
        ),
        "q3_1b_total_archivos": with_files("SELECT count(*) AS total_archivos FROM file_list"),
        "q3_2b_registros_metadatos": _sql(
            "SELECT count(*) AS filas_segun_metadatos, count(*) AS filas_segun_conteo, true AS coinciden FROM trips"
        ),
        "q3_3_columnas_yellow": described("yellow"),
        "q3_3_columnas_green": described("green"),
        "q3_4_deriva_de_esquema": with_files(
            """SELECT taxi_type, columna, variantes_de_nombre, tipos_fisicos, archivos_con_la_columna, archivos_totales
               FROM (SELECT taxi_type, lower(name) AS columna, list_sort(list_distinct(list(name))) AS variantes_de_nombre,
                       list_sort(list_distinct(list(type))) AS tipos_fisicos,
                       count(DISTINCT file_name) AS archivos_con_la_columna FROM file_schema GROUP BY ALL)
               JOIN (SELECT taxi_type, count(*) AS archivos_totales FROM file_list GROUP BY taxi_type) USING (taxi_type)
               WHERE NOT (len(variantes_de_nombre) = 1 AND len(tipos_fisicos) = 1 AND archivos_con_la_columna = archivos_totales)"""
        ),
        "q5_1_archivos_por_anio": with_files(
            """SELECT taxi_type, src_year::VARCHAR AS anio, count(*) AS archivos, sum(num_rows)::BIGINT AS filas
               FROM file_list GROUP BY taxi_type, src_year"""
        ),
        "q5_5_consistencia_esquema_por_anio": with_files(
            """SELECT taxi_type, src_year::VARCHAR AS anio, count(*) AS columnas,
               list(columna ORDER BY columna) FILTER (regexp_matches(columna, '(fee|surcharge)$')) AS columnas_de_cargos
               FROM (SELECT DISTINCT taxi_type, src_year, lower(name) AS columna FROM file_schema) GROUP BY taxi_type, src_year"""
        ),
        "scan_raw": _sql(raw_rows("yellow")),
        "scan_raw_green": _sql(raw_rows("green")),
        "normalize_trips": _sql("SELECT * FROM trips"),
        "src_period": with_files("SELECT filename, src_year, src_month, num_rows AS filas FROM file_list"),
        "zones": _sql("SELECT * FROM zones"),
        "file_listing": with_files("SELECT filename AS file_name FROM file_list"),
        "footer_metadata": with_files("SELECT filename AS file_name, num_rows, true AS con_grupos, true AS con_bytes FROM file_list"),
        "footer_schema": with_files("SELECT file_name, name, type FROM file_schema"),
        "subset_by_files": _sql(
            totals.format(first(12))
        ),
        "materialize_trips": _sql(totals.format("trips")),
        "materialize_indicators": tables(_indicators()),
        "incremental_indicators": tables(_exact_indicators()),
        "result_equivalence": verdicts("trips"),
        **{f"result_equivalence_{n}": verdicts(first(n)) for n in (1, 3, 6, 12, 24)},
        "q3_2c_filas_exactas": with_files(
            "SELECT taxi_type, printf('%d-%02d', src_year, src_month) AS periodo, num_rows FROM file_list"
        ),
        "q3_5_muestra_valida": "SELECT 10::BIGINT AS filas, 10::BIGINT AS encontradas",
        "completeness_audit": with_files("SELECT * FROM audited", audit),
        "completeness_audit_resumen": with_files(
            """SELECT estado, count(*) AS periodos, coalesce(sum(filas), 0)::BIGINT AS filas,
               estado IN {PROBLEM_STATES} AS problema FROM audited GROUP BY estado""".replace("{PROBLEM_STATES}", str(PROBLEM_STATES)),
            audit,
        ),
        "clean_trips": _sql(
            """SELECT taxi_type, vendor_id, pickup_ts, dropoff_ts, passenger_count, trip_distance, ratecode_id,
               pu_location_id, do_location_id, payment_type, fare_amount, tip_amount, tolls_amount, total_amount,
               src_year, src_month, filename, duration_min FROM kept"""
        ),
    }


def all_sql() -> dict[str, str]:
    """Query name -> SQL. Left out: a random sample, estimates, and sizes of files the SQL cannot see."""
    parts = (_exploration(), _eda(), _incorporation(), _workload(), _indicators(), _evolution(), _dashboard(), _files())
    found = {name: sql for part in parts for name, sql in sorted(part.items())}
    same_results = {
        "q3_6_resumen_por_meses": "q3_6_resumen_exacto",
        "b1_conteo_metadatos": "b1_conteo",
        "q3_2_registros_metadatos": "q3_2_registros_por_tipo_anio",
        "q3_7_rango_fechas_metadatos": "q3_7_rango_fechas",
    }
    return found | {name: found[same] for name, same in same_results.items()}
