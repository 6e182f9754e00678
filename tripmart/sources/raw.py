"""Monthly raw files whose columns and types drift, read as one relation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.functions.semantics import to_int_half_even
from tripmart.sources.catalogue import (
    ATTEMPTS,
    Dataset,
    FooterCatalogue,
    ReadGroup,
    Snapshot,
    default_catalogue,
    read_groups,
)
from tripmart.sources.files import PERIOD_PATTERN, below
from tripmart.sources.schema import TAXI_TYPES, TRIPS_COLUMNS

# Fixed value: the end of a dated name, YYYY-MM.parquet.
DATED_END = 15


def is_dated(source: str) -> bool:
    """Whether a dataset's name carries a period, a year and a month between 00 and 99."""
    return re.search(PERIOD_PATTERN, source) is not None


def period_of(source: str) -> tuple[int, int]:
    """Year and month in the name of a dated dataset."""
    return int(source[-DATED_END:][:4]), int(source[-DATED_END:][5:7])


def src_period(filename: Column) -> tuple[Column, Column]:
    """Year and month at the end of a dated file name."""
    year = F.substring(filename, -DATED_END, 4).cast("int")
    month = F.substring(filename, 5 - DATED_END, 2).cast("int")
    return year, month


def _read_group(catalogue: FooterCatalogue, group: ReadGroup, sample: str) -> DataFrame:
    """Rows of a group with filename, src_year and src_month, cut from the path at fixed places, so that filters on them prune files."""
    rows = catalogue.read(group, sample)
    if rows is None:
        raise _Changed
    path = F.col("_metadata.file_path")
    named = rows.withColumn("filename", path if group.slashes is None else F.substring_index(path, "/", group.slashes + 1))
    none = F.lit(None).cast("int")
    year, month = src_period(F.col("filename")) if group.dated else (none, none)
    return named.withColumns({"src_year": year, "src_month": month})


def _datasets(snapshot: Snapshot, root: str, taxi_type: str) -> list[Dataset]:
    """The datasets in one taxi type's folder."""
    return [d for d in snapshot.datasets if below(d.source, root).startswith(f"{taxi_type}/")]


def scan_raw(
    spark: SparkSession, root: str, taxi_type: str, sources: Collection[str] | None = None,
    catalogue: FooterCatalogue | None = None,
) -> DataFrame:
    """All raw rows of one taxi type plus ``filename``, ``src_year`` and ``src_month``.

    Columns are matched by name without regard to case, a missing column is NULL, and numeric
    types widen. Spark cannot merge such files in one read, so files are grouped by layout
    (few groups), each group is read natively, and the groups are united by name. With
    ``sources`` only those datasets are opened. Footers come from the catalogue; a file that is not readable as Parquet
    fails the call, by name.
    """
    return _read(catalogue or default_catalogue(spark), root, lambda snapshot, c: _scan(c, snapshot, root, taxi_type, sources))


class _Changed(Exception):
    """A folder holds other files than the snapshot says."""


def _read(catalogue: FooterCatalogue, root: str, build: Callable[[Snapshot, FooterCatalogue], DataFrame], snapshot: Snapshot | None = None) -> DataFrame:
    """What ``build`` makes of a snapshot; of a new one if files came or went since it was taken."""
    for _ in range(ATTEMPTS):
        try:
            return build(snapshot or catalogue.snapshot(root), catalogue)
        except _Changed:
            snapshot = None
    raise OSError(f"files below {root} change while they are read")


def _scan(catalogue: FooterCatalogue, snapshot: Snapshot, root: str, taxi_type: str, sources: Collection[str] | None) -> DataFrame:
    datasets = _datasets(snapshot, root, taxi_type)
    named = [d for d in datasets if sources is None or d.source in set(sources)]
    if not named:
        raise FileNotFoundError(f"no readable Parquet file below {root}/{taxi_type}")
    broken = [d.path for d in named if d.layout is None]
    if broken:
        raise OSError(f"not readable as Parquet: {', '.join(broken[:10])}")
    times = Counter(d.source for d in named)
    mixed = [source for source, n in times.items() if n > 1]  # datasets of several layouts are read by single files
    chosen = [d for d in named if times[d.source] == 1] + (snapshot.paths_of(mixed) if mixed else [])
    samples = {d.layout: d.path for d in reversed(chosen)}
    parts = [_read_group(catalogue, group, samples[group.layout]) for group in read_groups(datasets, chosen, is_dated)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# Raw column behind each integer and floating column of the trips relation.
_INTEGERS = {
    "vendor_id": "VendorID",
    "passenger_count": "passenger_count",
    "ratecode_id": "RatecodeID",
    "pu_location_id": "PULocationID",
    "do_location_id": "DOLocationID",
    "payment_type": "payment_type",
}
_DOUBLES = ("trip_distance", "fare_amount", "tip_amount", "tolls_amount", "total_amount")
TIME_PREFIX = {"yellow": "tpep", "green": "lpep"}


def normalize_trips(raw: DataFrame, taxi_type: str) -> DataFrame:
    """The 17 columns of the trips relation from one taxi type's raw rows."""
    types = {field.name.lower(): field.dataType for field in raw.schema.fields}

    def integer(name: str) -> Column:
        fractional = isinstance(types[name.lower()], (T.DoubleType, T.FloatType))
        return to_int_half_even(F.col(name)) if fractional else F.col(name).cast("int")

    prefix = TIME_PREFIX[taxi_type]
    columns = {
        "taxi_type": F.lit(taxi_type),
        "pickup_ts": F.col(f"{prefix}_pickup_datetime").cast("timestamp_ntz"),
        "dropoff_ts": F.col(f"{prefix}_dropoff_datetime").cast("timestamp_ntz"),
        **{name: integer(raw_name) for name, raw_name in _INTEGERS.items()},
        **{name: F.col(name).cast("double") for name in _DOUBLES},
        "src_year": F.col("src_year"),
        "src_month": F.col("src_month"),
        "filename": F.col("filename"),
    }
    return raw.select(*[columns[name].alias(name) for name in TRIPS_COLUMNS])


def read_trips(
    spark: SparkSession, root: str, sources: Collection[str] | None = None,
    catalogue: FooterCatalogue | None = None, snapshot: Snapshot | None = None,
) -> DataFrame:
    """The trips relation over all raw files below a folder with one sub-folder per taxi type.

    Files are listed anew at each call (unless a ``snapshot`` taken before is given), so a period added to the folder is part of
    the next result. A taxi type with none of the asked ``sources`` contributes nothing.
    """

    def build(now: Snapshot, catalogue: FooterCatalogue) -> DataFrame:
        parts = []
        for taxi_type in TAXI_TYPES:
            try:
                parts.append(normalize_trips(_scan(catalogue, now, root, taxi_type, sources), taxi_type))
            except FileNotFoundError:
                if sources is None:
                    raise
        if not parts:
            raise FileNotFoundError(f"none of the asked sources is below {root}")
        return reduce(DataFrame.unionByName, parts)

    return _read(catalogue or default_catalogue(spark), root, build, snapshot)


def sources_of_first_periods(spark: SparkSession, root: str, periods: int) -> list[str]:
    """Monthly datasets of the earliest ``periods`` months: a name per dataset, whatever its size."""
    names = {d.source for d in default_catalogue(spark).snapshot(root).datasets if is_dated(d.source)}
    first = sorted({name[-DATED_END:] for name in names})[:periods]
    return sorted(name for name in names if name[-DATED_END:] in first)
