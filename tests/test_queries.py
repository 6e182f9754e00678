"""Every registered query runs, has SQL where SQL can express it, and results agree with each other."""

import pytest

import __spark_entry__ as contract
from tests.builders import trip, trips
from tests.conftest import SMALL
from tripmart.plans.incorporation import duplicated_periods
from tripmart.testbed.oracle import all_sql
from tripmart.testbed.registry import all_queries

QUERIES, SQL = all_queries(), all_sql()
# Not expressible over the tables: a random draw, estimates, sizes of derived files.
ROWS_ONLY = {"q3_5_muestra_aleatoria": 10, "q3_6_resumen_estadistico": 10, "q3_2c_filas_por_archivo": None}
# A check that finds nothing: each period of the tables is one file.
EMPTY = {"q5_3_sin_archivos_duplicados"}


def test_all_queries_have_sql():
    assert set(QUERIES) - set(SQL) == set(ROWS_ONLY) and set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert len(rows) == (ROWS_ONLY.get(name) or len(rows)) and bool(rows) != (name in EMPTY)


def test_period_of_two_files_is_reported(spark):
    data = trips(spark, [trip(), trip(), trip(filename="again.parquet"), trip(src_month=2)])
    assert [tuple(r) for r in duplicated_periods(data).collect()] == [("yellow", 2024, 1, 2)]


def test_results_add_up(spark):
    def run(name):
        return QUERIES[name](spark, SMALL)

    kept = run("ind_10_calidad_mensual").selectExpr("sum(registros)", "sum(conservados)").first()
    assert run("ind_01_viajes_mensuales").selectExpr("sum(viajes)").first()[0] == kept[1]
    assert run("ind_07_distribucion_distancia").selectExpr("sum(viajes)").first()[0] == kept[1]
    assert run("q3_2_registros_por_tipo_anio").selectExpr("sum(registros)").first()[0] == kept[0]
    assert run("completeness_audit").selectExpr("sum(filas)").first()[0] == kept[0]
    kpis = run("dash_kpis").first()
    assert kpis["viajes_yellow"] + kpis["viajes_green"] == kept[1]
    for total in run("q4_p2_demanda_por_hora").groupBy("taxi_type").sum("pct_viajes").collect():
        assert total[1] == pytest.approx(100, abs=0.2)
