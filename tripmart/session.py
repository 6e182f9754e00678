"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# For the builder of an own session; these cannot be set on a running one.
STATIC_SETTINGS = {
    # Recording the Python line of every Column call triples the time to build a query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

HELD_ROWS = 20_000

_SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A task that writes to folders keeps so many files open before it sorts its rows by folder, which spills.
    "spark.sql.maxConcurrentOutputFileWriters": "100",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the jobs rely on; safe on any running session."""
    for key, value in _SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python in Arrow batches of a few MB; their number alone (10,000) leaves wide rows without a bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where the session names none (tests on one machine) is a fresh local folder chosen.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tripmart-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path, never used before, for data that one job writes and others read."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{app}-{uuid.uuid4().hex[:8]}"


def small_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A DataFrame over a few driver-side values; planned as a local relation, without tasks."""
    return spark.createDataFrame(pa.table(columns))


def held(df: DataFrame) -> DataFrame:
    """An aggregated result as rows known to the planner, so that it is computed once and may be broadcast.

    At most HELD_ROWS rows pass through the driver. A larger result stays a plan like any other: it is computed
    where it is used, and joins with it are shuffled.
    """
    rows = df.limit(HELD_ROWS + 1).toArrow()
    return df if rows.num_rows > HELD_ROWS else df.sparkSession.createDataFrame(rows, df.schema)
