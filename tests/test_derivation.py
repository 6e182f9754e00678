"""Deriving trips from the order tables moves line items as little as the job allows."""

import re
from datetime import datetime

from tripmart.session import configure
from tripmart.testbed import tables

DAY = datetime(1996, 3, 5)


def write_tables(spark, folder):
    """Keys that repeat, lack a partner or are null keep all rows that the joins give."""
    lines = [(o, 10 + n, s, n, 5.0 + n, 1000.0, 0.05, 0.02, "N", "F", DAY) for n, (o, s) in enumerate([(1, 1), (1, 2), (2, None), (3, 9), (None, 1)])]
    lines_schema = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    )
    orders = [(1, 5, "F", 1.0, DAY, "x"), (2, None, "F", 1.0, None, "x"), (3, 8, "F", 1.0, DAY, "x"), (3, 5, "F", 1.0, DAY, "x")]
    orders_schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(lines, lines_schema).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, orders_schema).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(5, 20), (5, 21)], "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(1, 7), (2, 8), (2, 9)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")


def test_line_items_are_shuffled_by_order_and_period_only(spark, tmp_path):
    configure(spark)
    write_tables(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        trips = tables.trips(spark, str(tmp_path), by_period=True)
        plan = trips._jdf.queryExecution().executedPlan().toString()
        rows = trips.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert sorted(dealt) == ["c_custkey", "l_orderkey", "o_custkey", "o_orderkey", "taxi_type"]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") != "0"
    zones = sorted((r["pu_location_id"] or -1, r["do_location_id"] or -1, r["src_year"] or -1) for r in rows)
    # order 1 has two customers, line 2 two suppliers; order 2 has no date; order 3 is there twice, once without and once with two customers
    assert zones == sorted(
        [(c, s, 1996) for c in (20, 21) for s in (7, 8, 9)] + [(-1, -1, -1)] + [(c, -1, 1996) for c in (-1, 20, 21)]
    )
