from functools import partial

from pyspark.sql import functions as F

from tests.builders import trip, trips
from tripmart.operators.equivalence import result_equivalence
from tripmart.operators.sinks import materialize_indicators
from tripmart.plans.eda import unusual_days
from tripmart.plans.exploration import basic_anomalies, code_lists
from tripmart.plans.indicators import monthly_trips, yearly_payment


def verdict(spark, left, right, keys=("k",)):
    schema = "k int, x double, s string"
    row = result_equivalence(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), keys and list(keys))
    return row.first().asDict()


def test_tolerance_and_nulls(spark):
    base = [(1, 100.0, "a"), (None, 5.0, "b")]
    assert verdict(spark, base, [(1, 100.00001, "a"), (None, 5.0, "b")])["equivalentes"]
    assert not verdict(spark, base, [(1, 100.1, "a"), (None, 5.0, "b")])["equivalentes"]
    assert not verdict(spark, [(1, None, "a")], [(1, 0.0, "a")])["equivalentes"]
    assert verdict(spark, [(1, None, "a")], [(1, None, "a")])["equivalentes"]
    assert not verdict(spark, base, [(1, 100.0, "A"), (None, 5.0, "b")])["equivalentes"]
    missing = verdict(spark, base, base[:1])
    assert (missing["filas_a"], missing["filas_b"], missing["diferencias"]) == (2, 1, 1)


def test_without_keys_rows_are_counted(spark):
    twice = [(1, 1.0, "a"), (1, 1.0, "a")]
    assert verdict(spark, twice, twice, None)["equivalentes"]
    assert not verdict(spark, twice, twice[:1], None)["equivalentes"]


def test_failing_indicator_does_not_stop_the_others(spark, tmp_path):
    data = trips(spark, [trip()])

    def broken():
        raise ValueError("no such column")

    written, failed = materialize_indicators({"good": partial(monthly_trips, data), "bad": broken}, str(tmp_path))
    assert set(written) == {"good"} and failed == {"bad": "no such column"}
    assert spark.read.parquet(written["good"]).first()["viajes"] == 1


def test_payment_codes_outside_the_catalogue(spark):
    data = trips(spark, [trip(payment_type=code) for code in (None, 0, 6, 7, 1)])
    assert {(r["metodo"], r["viajes"], r["pct"]) for r in yearly_payment(data).collect()} == {
        ("otro/desconocido", 4, 80.0), ("tarjeta", 1, 20.0),
    }
    codes = {(r["valor"], r["registros"]) for r in code_lists(data).where("campo = 'payment_type'").collect()}
    assert codes == {(None, 1), ("0", 1), ("6", 1), ("7", 1), ("1", 1)}


def test_day_without_spread_sorts_last(spark):
    from datetime import datetime

    lone = trip(pickup_ts=datetime(2024, 2, 3, 8), dropoff_ts=datetime(2024, 2, 3, 9), src_month=2)
    busy = [trip(pickup_ts=datetime(2024, 1, d, 8), dropoff_ts=datetime(2024, 1, d, 9)) for d in (1, 1, 2)]
    scores = [r["z_score"] for r in unusual_days(trips(spark, [lone, *busy])).collect()]
    assert scores == [1.0, -1.0, None]


def test_tolerance_holds_for_finite_values_only(spark):
    inf, nan = float("inf"), float("nan")
    for x, y, same in ((5.0, inf, False), (5.0, nan, False), (inf, -inf, False), (inf, inf, True), (nan, nan, True), (1.0, 1.0 + 1e-9, True)):
        a, b = (spark.createDataFrame([(1, v)], "k int, x double") for v in (x, y))
        assert (result_equivalence(a, b, ["k"]).first()["diferencias"] == 0) == same


def test_other_columns_are_never_equivalent(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    for keys in (["k"], None):
        for other in (a.withColumn("y", F.lit(1)), a.withColumn("x", F.col("x").cast("float")), a.withColumnRenamed("x", "z")):
            for left, right in ((a, other), (other, a)):
                row = result_equivalence(left, right, keys).first()
                assert (row["filas_a"], row["filas_b"], row["diferencias"], row["equivalentes"]) == (1, 1, 1, False)
        assert result_equivalence(a, a.select("x", "k"), keys).first()["equivalentes"]


def test_without_keys_floats_are_tolerated(spark):
    base = [(1, 1.0, "a"), (1, 2.0, "a"), (None, None, None), (2, float("nan"), "b")]
    near = [(1, 2.0 + 1e-9, "a"), (None, None, None), (2, float("nan"), "b"), (1, 1.0 + 1e-9, "a")]
    assert verdict(spark, base, near, None)["equivalentes"]
    assert verdict(spark, base, [*near[:3], (1, 1.1, "a")], None)["diferencias"] == 1
    assert verdict(spark, base, [*near[:3], (3, 1.0, "a")], None)["diferencias"] >= 2
    assert verdict(spark, base[:1], [(1, float("inf"), "a")], None)["diferencias"] == 1
    assert verdict(spark, [], [], None) == {"filas_a": 0, "filas_b": 0, "diferencias": 0, "equivalentes": True}


def test_the_oracle_and_the_plan_agree_on_edges(spark):
    """A negative code is in no catalogue limit, and an arrival within the second before the departure is early."""
    from datetime import datetime

    early = trip(payment_type=-1, pickup_ts=datetime(2024, 1, 10, 8, 0, 0, 500000), dropoff_ts=datetime(2024, 1, 10, 8, 0, 0, 400000))
    row = basic_anomalies(trips(spark, [early])).first()
    assert (row["pago_fuera_de_catalogo"], row["llegada_antes_de_salida"]) == (0, 1)
