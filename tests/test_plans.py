"""How often do the queries read the trips, and what do they read?"""

import re

import pytest

from tests.conftest import SMALL
from tripmart.operators.shaping import ordered
from tripmart.operators.sinks import materialize_trips
from tripmart.testbed import tables
from tripmart.testbed.layout import trips_table
from tripmart.testbed.registry import OVER_TRIPS, all_queries

# Two branches by design: a limit per taxi type; exact statistics beside sketches; values beyond limits from quantiles.
TWO_SCANS = {"q3_5b_primeros_por_tipo", "q3_6_resumen_estadistico", "q4_p8_valores_atipicos"}
# Aggregated first; the last step reads the small result only.
HELD = {"q5_2_consulta_conjunta_por_mes", "dash_payment_pivot", "dash_distance_pivot", "dash_trips_pivot"}
# How each ordered result is sorted; "-" means from high to low.
ORDERS = {
    "q3_2_registros_por_tipo_anio": "taxi_type src_year", "q3_7_rango_fechas": "taxi_type src_year src_month",
    "q3_7b_catalogos": "campo taxi_type -registros", "q4_p1_viajes_mensuales": "taxi_type src_year src_month",
    "q4_p2_demanda_por_hora": "taxi_type hora", "q4_p3_demanda_dia_semana": "taxi_type dia_iso",
    "q4_p4b_pasajeros": "taxi_type -viajes", "q4_p6_metodos_de_pago": "taxi_type -viajes",
    "q4_p6b_propina_tarjeta": "taxi_type src_year", "q4_p7_histograma_tarifa": "taxi_type tarifa_desde",
    "q4_p7b_histograma_distancia": "taxi_type milla_desde", "q4_p8b_top_extremos": "-fare_amount",
    "q4_p11_zonas_recogida": "taxi_type -viajes", "q5_2_consulta_conjunta_por_mes": "taxi_type mes",
    "q5_4_meses_presentes": "taxi_type src_year", "b2_agregado_por_tipo": "taxi_type", "b3_viajes_por_hora": "taxi_type hora",
    "b4_mensual_por_pago": "taxi_type src_year src_month payment_type",
    "b5_top_pares_de_zonas": "-viajes pu_location_id do_location_id", "b7_percentiles_tarifa": "taxi_type",
    "ind_01_viajes_mensuales": "taxi_type periodo", "ind_02_ingreso_mensual": "taxi_type periodo",
    "ind_03_demanda_por_hora": "taxi_type dia_tipo hora", "ind_04_viaje_tipico_mensual": "taxi_type periodo",
    "ind_05_metodo_pago_anual": "taxi_type src_year -viajes", "ind_06_propina_mensual": "taxi_type periodo",
    "ind_07_distribucion_distancia": "taxi_type orden", "ind_08_top_zonas_recogida": "taxi_type posicion",
    "ind_09_velocidad_por_hora": "taxi_type hora", "ind_10_calidad_mensual": "taxi_type periodo",
    "q8_0_meses_comunes": "taxi_type src_month", "q8_1_resumen_anual_mismos_meses": "taxi_type src_year",
    "q8_2_variacion_interanual": "taxi_type src_year", "q8_3_hora_pico_por_anio": "taxi_type src_year",
    "q8_4_mezcla_de_pago_por_anio": "taxi_type src_year -viajes", "q8_5_calidad_por_anio": "taxi_type src_year",
    "q8_6_participacion_verde": "periodo", "q3_1_archivos_por_tipo_anio": "taxi_type anio",
    "q3_2c_filas_por_archivo": "taxi_type periodo", "q3_4_deriva_de_esquema": "taxi_type columna",
    "q5_1_archivos_por_anio": "taxi_type anio", "q5_5_consistencia_esquema_por_anio": "taxi_type anio",
}


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(OVER_TRIPS))
def test_trips_are_scanned_once(spark, name):
    plan = final_plan(OVER_TRIPS[name](trips_table(spark, SMALL), tables.zones(spark, SMALL)))
    scans = sum("trips_tbl" in line for line in plan.splitlines() if "FileScan" in line)
    assert scans == (2 if name in TWO_SCANS else 0 if name in HELD else 1)
    assert "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = final_plan(OVER_TRIPS["b6_filtro_selectivo"](trips_table(spark, SMALL)))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert re.search(r"PushedFilters: \[.*GreaterThan\(total_amount,150.0\)", scan)
    assert re.search(r"ReadSchema: struct<trip_distance:double,total_amount:double>", scan)


def test_period_filter_prunes_folders(spark):
    trips = trips_table(spark, SMALL)
    plan = final_plan(trips.where("src_year = 1996 AND taxi_type = 'green'").select("fare_amount"))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "src_year" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(trips.where("src_year = 1996 AND taxi_type = 'green' AND src_month = 2").inputFiles()) >= 1


def sort_key(row, order: str) -> list:
    """NULLs last in both directions."""
    key = []
    for name in order.split():
        value, down = row[name.lstrip("-")], name.startswith("-")
        key.append((value is None, 0 if value is None else -value if down else value))
    return key


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_results_are_ordered(spark, name):
    keys = [sort_key(row, ORDERS[name]) for row in all_queries()[name](spark, SMALL).collect()]
    assert keys == sorted(keys) and len(keys) > 1


def test_bands_are_ordered(spark):
    rows = all_queries()["q4_p10_tarifa_por_milla"](spark, SMALL).collect()
    bands = ["0-1", "1-3", "3-5", "5-10", "10-20", "20+"]
    keys = [(r["taxi_type"], bands.index(r["tramo_millas"])) for r in rows]
    assert keys == sorted(keys)


def test_nulls_come_last_either_way(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (1, 5)], "a int, b int")
    assert [tuple(r) for r in ordered(lambda x: x, "a", "-b")(df).collect()] == [(1, 5), (1, None), (None, 2)]


def test_months_are_written_without_a_shuffle(spark, tmp_path):
    trips = trips_table(spark, SMALL).where("src_year = 1996")
    rows = trips.count()
    written = materialize_trips(trips, str(tmp_path / "t"), by_period=True)
    assert written.count() == rows == materialize_trips(trips, str(tmp_path / "u")).count()
    plan = trips.hint("rebalance", "src_year")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in trips._jdf.queryExecution().executedPlan().toString()
