import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmart.operators.quantiles import _located, exact_quantiles

FRACTIONS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def _groups():
    rng = random.Random(3)
    return {
        "spread": [rng.lognormvariate(2, 2) for _ in range(3000)],
        "negative": [rng.uniform(-500, 500) for _ in range(999)],
        "one hot value": [7.25] * 4000 + [rng.uniform(0, 100) for _ in range(100)],
        "single": [3.5],
        "two": [1.0, 2.0],
        "zero": [0.0, -0.0, 0.0],
    }


@pytest.mark.parametrize("measures", [1, 3])
def test_against_brute_force(spark, measures):
    groups = _groups()
    rows = [(k, v, -v, v * 2) for k, values in groups.items() for v in values]
    rows += [("spread", None, None, None)] * 50 + [("nulls only", None, None, None)] * 5
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, a double, b double, c double").repartition(5)
    names = ["a", "b", "c"][:measures]
    wanted = {f"{m}_{i}": (m, p) for m in names for i, p in enumerate(FRACTIONS)}
    result = exact_quantiles(
        df, ["k"], {m: F.col(m) for m in names}, wanted,
        sums={"rows": F.lit(1), "a_sum": F.coalesce("a", F.lit(0.0))},
    )
    got = {r["k"]: r.asDict() for r in result.collect()}
    assert set(got) == {*groups, "nulls only"}
    sign = {"a": 1, "b": -1, "c": 2}
    for key, values in groups.items():
        for name, (measure, fraction) in wanted.items():
            expected = np.quantile([sign[measure] * v for v in values], fraction)
            assert got[key][name] == pytest.approx(expected, rel=1e-12, abs=1e-12), (key, name)
    assert got["spread"]["rows"] == 3050
    assert got["negative"]["a_sum"] == pytest.approx(sum(groups["negative"]))
    assert all(got["nulls only"][name] is None for name in wanted)
    assert got["nulls only"]["rows"] == 5


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "k int, a double")
    rows = exact_quantiles(df, ["k"], {"a": F.col("a")}, {"m": ("a", 0.5)}).collect()
    assert {(r["k"], r["m"]) for r in rows} == {(None, 2.0), (1, 5.0)}


def test_not_finite_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in (-inf, -1.0, 2.0, inf, inf, nan)], "a double")
    row = exact_quantiles(df.withColumn("k", F.lit(1)), ["k"], {"a": F.col("a")}, {"low": ("a", 0.2), "mid": ("a", 0.4), "top": ("a", 0.8)}).first()
    assert (row["low"], row["mid"], row["top"]) == (-1.0, 2.0, inf)


def test_second_pass_reads_held_buckets(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("a")).write.parquet(
        str(tmp_path / "t")
    )
    df = exact_quantiles(spark.read.parquet(str(tmp_path / "t")), ["k"], {"a": F.col("a")}, {"m": ("a", 0.5)})
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "LocalTableScan" in plan and "ReusedExchange" in plan


def test_without_held_buckets_the_result_is_the_same(spark, monkeypatch):
    from tripmart import session

    df = spark.range(3000).select((F.col("id") % 5).alias("k"), F.sin("id").alias("a"))
    ask = lambda: sorted(exact_quantiles(df, ["k"], {"a": F.col("a")}, {"m": ("a", 0.3)}).collect())
    want = ask()
    monkeypatch.setattr(session, "HELD_ROWS", 1)
    assert ask() == want


@pytest.mark.parametrize("value", ["1700000000 + id * 26", "id / 1e8"])
def test_narrow_ranges_are_spread(spark, value):
    """A month of epoch seconds, and values from 0 to 0.001: few buckets, yet no step holds more than a small share."""
    df = spark.range(100_000).selectExpr("1 AS k", f"CAST({value} AS double) AS a")
    located = _located(df, ["k"], {"a": F.col("a")}, {"m": ("a", 0.5)}, {})
    sorted_rows = located.groupBy("bucket", "step").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    assert sorted_rows <= 100_000 / 200
    got = exact_quantiles(df, ["k"], {"a": F.col("a")}, {"m": ("a", 0.5)}).first()["m"]
    assert got == pytest.approx(df.agg(F.percentile("a", F.lit(0.5))).first()[0], rel=1e-14)
