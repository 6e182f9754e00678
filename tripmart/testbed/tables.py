"""A trips relation derived from the order tables (``lineitem``, ``orders``, ``customer``, ``supplier``).

Numbers in this module define the mapping; the SQL in ``testbed.oracle`` states the same mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.operators.sinks import PARTITIONS
from tripmart.sources.schema import TRIPS_COLUMNS, TRIPS_SCHEMA

WITHOUT_ZONE = (3, 7)
BROADCAST_ROWS = 1_000_000  # of two numbers each: some 60 MB as a hash table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), ts)


def _bounded(df: DataFrame) -> DataFrame:
    """A dimension of at most BROADCAST_ROWS narrow rows goes to the executors, so that what it joins is not shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def trips(spark: SparkSession, sf_dir: str, locations: bool = True, by_period: bool = False) -> DataFrame:
    """Line items as trips.

    Orders and line items both grow with the input and join by key at every size; Spark splits a skewed key at run
    time. Pickup and drop-off zones come from two more joins, each on a primary key and each
    keeping every row, so a query that does not use zones leaves them out (``locations=False``,
    both columns NULL) with the same result and two joins less. Customers join the orders, which are fewer and
    narrower than line items; suppliers are broadcast while they are few. So line items are shuffled once, and, ``by_period``, once more
    to gather each period, as source columns before the longer rows of trips are made of them.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pickup_zone = dropoff_zone = F.lit(None)
    if locations:
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    base = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    if locations:
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        base = base.join(_bounded(suppliers), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        pickup_zone, dropoff_zone = F.col("c_nationkey"), F.col("s_nationkey")

    order, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    zero = F.lit(0.0)
    taxi_type = F.when(F.col("l_linestatus") == "F", "yellow").otherwise("green")
    pickup = _plus_seconds(F.col("o_orderdate"), (order * 37 + line * 4001) % 86400)
    dropoff = _plus_seconds(F.col("pickup_ts"), (part * 7 + line * 613 + order) % 24000 - 300)
    price = F.col("l_extendedprice") / 1000
    source_date = F.when(part % 97 == 0, F.date_add("o_orderdate", 40)).otherwise(F.col("o_orderdate").cast("date"))
    month = F.lpad(F.col("src_month").cast("string"), 2, "0")
    base = base.withColumns({"taxi_type": taxi_type, "source_date": source_date})
    base = base.withColumns({"src_year": F.year("source_date"), "src_month": F.month("source_date")})
    if by_period:
        base = base.hint("rebalance", *PARTITIONS)
    columns = base.withColumn("pickup_ts", pickup).withColumns(
        {
            "vendor_id": F.col("l_suppkey") % 3,
            "dropoff_ts": dropoff,
            "passenger_count": F.when(part % 5 != 0, F.col("l_quantity").cast("int") % 7),
            "trip_distance": F.col("l_quantity") * F.col("l_discount") * 25,
            "ratecode_id": F.when(part % 5 != 0, order % 6 + 1),
            "pu_location_id": pickup_zone,
            "do_location_id": dropoff_zone,
            "payment_type": F.when(F.col("l_returnflag") == "N", 1)
            .when(F.col("l_returnflag") == "R", 2)
            .otherwise(order % 5),
            "fare_amount": F.when(part % 31 == 0, -1.0).otherwise(1.0) * price,
            "tip_amount": price * F.col("l_tax"),
            "tolls_amount": F.when(part % 11 == 0, 6.94).otherwise(zero),
        }
    )
    extra = F.when(part % 211 == 0, 1000.0).otherwise(zero)
    columns = columns.withColumns(
        {
            "total_amount": F.col("fare_amount") + F.col("tip_amount") + F.col("tolls_amount") + extra,
            "filename": F.concat(F.col("taxi_type"), F.lit("_tripdata_"), F.col("src_year").cast("string"),
                                 F.lit("-"), month, F.lit(".parquet")),
        }
    )
    return columns.select(*[F.col(n).cast(TRIPS_SCHEMA[n].dataType).alias(n) for n in TRIPS_COLUMNS])


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as zones and regions as boroughs; two nations are left out so that defaults occur."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nations.where(~F.col("n_nationkey").isin(*WITHOUT_ZONE))
    return named.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("int").alias("location_id"),
        F.col("r_name").alias("borough"),
        F.col("n_name").alias("zone"),
        F.lit("N/A").alias("service_zone"),
    )
