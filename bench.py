"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_COPIES (every trip that many
times, to measure throughput on larger data), BENCH_MEMORY (driver heap), BENCH_ONLY (names, comma separated).

Setting up writes the trips once as a partitioned table and as monthly raw files; it is timed apart.
Every query then runs over the table (``queries``) and the indicators also over the raw files
(``raw_files``). Each time is the best of two runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.operators.sinks import materialize_trips
from tripmart.plans import audit
from tripmart.plans.indicators import INDICATORS
from tripmart.session import STATIC_SETTINGS, configure, new_folder
from tripmart.sources.raw import read_trips
from tripmart.testbed import tables
from tripmart.testbed.layout import raw_layout, trips_table
from tripmart.testbed.registry import OVER_TRIPS

OVER_FILES = [
    "q3_1_archivos_por_tipo_anio", "q3_1b_total_archivos", "q3_2b_registros_metadatos", "q3_2c_filas_por_archivo",
    "q3_3_columnas_yellow", "q3_3_columnas_green", "q3_4_deriva_de_esquema",
]
RUNS = 2


def session(cpus: str, memory: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tripmart-bench")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
    )
    for key, value in STATIC_SETTINGS.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def best_time(build: Callable[[], DataFrame]) -> float:
    """Seconds to build and fully run a query, its result rows fetched."""
    times = []
    for _ in range(1 + RUNS):
        start = time.perf_counter()
        build().collect()
        times.append(time.perf_counter() - start)
    return round(min(times[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    spark = session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "12g"))

    start = time.perf_counter()
    trips = trips_table(spark, sf_dir)
    if copies > 1:
        many = trips.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")
        trips = materialize_trips(many, new_folder(spark, "copies"))
    zones = tables.zones(spark, sf_dir)
    setup = {"table": round(time.perf_counter() - start, 3)}

    def wanted(name: str) -> bool:
        return not only or name in only

    queries = {
        name: best_time(lambda build=build: build(trips, zones)) for name, build in OVER_TRIPS.items() if wanted(name)
    }
    raw_times: dict[str, float] = {}
    if copies == 1 and not only:
        start = time.perf_counter()
        raw = raw_layout(spark, sf_dir).raw
        setup["raw_files"] = round(time.perf_counter() - start, 3)
        queries |= {name: best_time(lambda name=name: audit.AUDIT[name](spark, raw)) for name in OVER_FILES}
        from_files = read_trips(spark, raw)
        raw_times = {
            name: best_time(lambda build=build: build(from_files, zones)) for name, build in INDICATORS.items()
        }
    result = {
        "metric": "total_query_time",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "rows": trips.count(),
        "indicators_total": round(sum(queries.get(name, 0.0) for name in INDICATORS), 3),
        "raw_files": raw_times,
        "setup": setup,
    }
    print(json.dumps(result))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
