"""A table of Parquet footers, so that each file is opened once however many queries need its footer.

A file is known by path, length and modification time (a file replaced within a millisecond by another of the same length is not
noticed). Every call lists the folder, in one job that gives a digest of the listing. While the digest is that of the last
snapshot, the snapshot is current. Otherwise the listing is compared with the table by an anti-join; tasks open only the files that are
new or changed and append their footers, and the snapshot is the part of the table that the listing names.

The driver keeps what reading Parquet needs there anyway: a row for each monthly dataset and layout. Layouts
(column names and types) are few; Spark's schema of each is inferred from one file, once, and kept beside the footers.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.session import new_folder, small_table
from tripmart.sources.files import _open, file_listing

COLUMN = "struct<name: string, type: string, logical: string, nulls: bigint, low: string, high: string>"
FOOTERS = (
    "path string, source string, file_size_bytes bigint, modified bigint, readable boolean, "
    f"num_rows bigint, num_row_groups bigint, layout string, columns array<{COLUMN}>"
)
LAYOUTS = "layout string, schema string"
KEY = ["path", "file_size_bytes", "modified"]
ATTEMPTS = 3  # to find the folder unchanged between listing and reading


def _statistics(meta, column: int) -> tuple[int | None, str | None, str | None]:
    """NULLs, least and greatest value of a column as text; what some row group does not say is NULL."""
    found = [meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups)]
    if any(s is None for s in found):
        return None, None, None
    nulls = sum(s.null_count for s in found) if all(s.has_null_count for s in found) else None
    # a group of NULLs only has neither bound
    bounded = [s for s in found if s.has_min_max]
    if not bounded or not all(s.has_min_max or s.num_values == 0 for s in found):
        return nulls, None, None
    return nulls, str(min(s.min for s in bounded)), str(max(s.max for s in bounded))


def _read_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    import pyarrow as pa
    import pyarrow.parquet as pq

    for batch in batches:
        lines = []
        for path, source, length, modified in zip(batch["path"], batch["source"], batch["length"], batch["modified"], strict=True):
            line = [path, source, length, modified, False, None, None, None, None]
            with _open(path) as handle:  # a file that cannot be opened fails the job
                try:
                    meta = pq.ParquetFile(handle).metadata
                except (pa.ArrowInvalid, OSError):  # no Parquet file, or cut short
                    meta = None
            if meta is not None:
                columns = []
                for i in range(meta.num_columns):
                    leaf, (nulls, low, high) = meta.schema.column(i), _statistics(meta, i)
                    kind = {"name": leaf.name, "type": leaf.physical_type, "logical": str(leaf.logical_type)}
                    columns.append({**kind, "nulls": nulls, "low": low, "high": high})
                names = "\n".join(f"{c['name']}\t{c['type']}\t{c['logical']}" for c in columns)
                layout = hashlib.sha256(names.encode()).hexdigest()[:32]
                line[4:] = [True, meta.num_rows, meta.num_row_groups, layout, columns]
            lines.append(line)
        names = [*KEY[:1], "source", *KEY[1:], "readable", "num_rows", "num_row_groups", "layout", "columns"]
        yield pd.DataFrame(lines, columns=names).astype({"num_rows": "Int64", "num_row_groups": "Int64"})


@dataclass(frozen=True)
class Dataset:
    """A monthly dataset in one layout: ``source`` is its folder or file, ``path`` one of its files."""

    source: str
    layout: str | None
    path: str
    files: int


@dataclass(frozen=True)
class ReadGroup:
    """Folders and files that one Parquet read takes together: their layout, whether names carry a period, and how
    many slashes a dataset's name has (None: datasets are single files)."""

    layout: str
    dated: bool
    slashes: int | None
    paths: tuple[str, ...]
    files: int


class Snapshot:
    """The files below a folder at one listing."""

    def __init__(self, files: DataFrame, mark: Row):
        self.files, self.mark = files, mark

    @cached_property
    def datasets(self) -> list[Dataset]:
        rows = self.files.groupBy("source", "layout").agg(F.min("path").alias("path"), F.count("*").alias("files")).collect()
        return sorted((Dataset(*row) for row in rows), key=lambda d: d.path)

    def paths_of(self, sources: Collection[str]) -> list[Dataset]:
        """A dataset entry for every single file of some datasets."""
        rows = self.files.where(F.col("source").isin(list(sources))).select("source", "layout", "path")
        return [Dataset(row["source"], row["layout"], row["path"], 1) for row in rows.toLocalIterator()]


class FooterCatalogue:
    """Footers of all folders that are asked for, in tables below ``folder``.

    The folder must be one that driver and executors share; it may be kept from session to session, and sessions
    may use it side by side (a file that two of them open at once has two equal rows).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._snapshots: dict[str, Snapshot] = {}
        self._schemas: dict[str, T.StructType] = {}

    def _table(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def snapshot(self, root: str) -> Snapshot:
        """The files below ``root`` now; only files that are new or changed since the last call are opened."""
        listing = file_listing(self.spark, root)
        digest = F.xxhash64("path", "length", "modified")
        other = F.xxhash64("modified", "path", "length")
        mark = listing.agg(F.count("*"), F.bit_xor(digest), F.bit_xor(other)).first()
        last = self._snapshots.get(root)
        if last is None or last.mark != mark:
            last = self._snapshots[root] = Snapshot(self._update(listing), mark)
        return last

    def _update(self, listing: DataFrame) -> DataFrame:
        listed = listing.withColumnRenamed("length", "file_size_bytes")
        known = self._table("footers", FOOTERS)
        fresh = listed if known is None else listed.join(known, KEY, "left_anti")
        opened = fresh.withColumnRenamed("file_size_bytes", "length").mapInPandas(_read_footers, FOOTERS)
        opened.write.mode("append").parquet(f"{self.folder}/footers")
        current = self._table("footers", FOOTERS).join(listed.select(*KEY), KEY, "left_semi").dropDuplicates(KEY)
        path = new_folder(self.spark, "files-now")
        current.hint("rebalance").write.parquet(path)
        return self.spark.read.schema(FOOTERS).parquet(path)

    def schema(self, layout: str, path: str) -> T.StructType:
        """Spark's schema of a layout, inferred from the file at ``path`` at the first request and kept."""
        if not self._schemas:
            table = self._table("layouts", LAYOUTS)
            for row in table.collect() if table is not None else []:
                self._schemas[row["layout"]] = T.StructType.fromJson(json.loads(row["schema"]))
        if layout not in self._schemas:
            schema = self.spark.read.parquet(unquote(path)).schema
            small_table(self.spark, layout=[layout], schema=[schema.json()]).write.mode("append").parquet(f"{self.folder}/layouts")
            self._schemas[layout] = schema
        return self._schemas[layout]

    def read(self, group: ReadGroup, sample: str) -> DataFrame | None:
        """The rows of a group in one native read; None if its folders hold other files by now than the snapshot."""
        reader = self.spark.read.schema(self.schema(group.layout, sample)).option("recursiveFileLookup", "true")
        rows = reader.option("pathGlobFilter", "*.parquet").parquet(*[unquote(path) for path in group.paths])
        return rows if len(rows.inputFiles()) == group.files else None


_of_application: dict[str, FooterCatalogue] = {}


def default_catalogue(spark: SparkSession) -> FooterCatalogue:
    """The catalogue that readers use where none is given: one for each application, in the shared folder."""
    name = spark.sparkContext.applicationId
    if name not in _of_application:
        _of_application[name] = FooterCatalogue(spark, new_folder(spark, "footers"))
    return _of_application[name]


def read_groups(datasets: list[Dataset], chosen: list[Dataset], dated: Callable[[str], bool]) -> list[ReadGroup]:
    """Chosen datasets by layout and form of name, each group with as few paths as name all of its files and no other.

    A folder stands for its datasets if all ``datasets`` below it belong to the group. Few paths matter: Spark
    lists more than 32 of them by a job of its own.
    """
    wanted = {(d.source, d.path) for d in chosen}

    def key(d: Dataset) -> tuple:
        return d.layout, dated(d.source), None if d.source == d.path else d.source.count("/")

    owners: dict[str, set] = defaultdict(set)
    top = _common_folder([d.source for d in datasets])
    for d in [*datasets, *chosen]:
        owner = key(d) if (d.source, d.path) in wanted else None
        for folder in _folders(d.source, top):
            owners[folder].add(owner)
    groups: dict[tuple, list[Dataset]] = defaultdict(list)
    for d in chosen:
        groups[key(d)].append(d)

    def standing(d: Dataset, group: tuple) -> str:
        return next((folder for folder in _folders(d.source, top) if owners[folder] == {group}), d.path)

    found = [
        ReadGroup(*group, tuple(sorted({standing(d, group) for d in members})), sum(d.files for d in members))
        for group, members in groups.items()
    ]
    return sorted(found, key=lambda g: g.paths)


def _common_folder(sources: list[str]) -> str:
    """The lowest folder that holds all of them."""
    low, high = min(sources), max(sources)
    same = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    return low[:same].rpartition("/")[0]


def _folders(source: str, top: str) -> Iterator[str]:
    """The folders from ``top`` down to the one that holds ``source``, and the source itself."""
    at = len(top)
    while at >= 0:
        yield source[:at]
        at = source.find("/", at + 1)
    yield source


def footers(spark: SparkSession, root: str) -> DataFrame:
    """One row per file below ``root``, as it is now, with its footer's counts and columns."""
    return default_catalogue(spark).snapshot(root).files


def readable(files: DataFrame) -> DataFrame:
    """The files; one that is no whole Parquet file fails the job, by name. Only the audit tolerates such files."""
    named = F.raise_error(F.concat(F.lit("not readable as Parquet: "), "path"))
    return files.where(F.when(F.col("readable"), F.lit(True)).otherwise(named.cast("boolean")))


def footer_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Per monthly dataset: rows, row groups and bytes."""
    sources = readable(footers(spark, root)).groupBy(F.col("source").alias("file_name"))
    return sources.agg(
        F.sum("num_rows").alias("num_rows"),
        F.sum("num_row_groups").alias("num_row_groups"),
        F.sum("file_size_bytes").alias("file_size_bytes"),
    )


def footer_schema(spark: SparkSession, root: str) -> DataFrame:
    """Per monthly dataset and column: name and physical type."""
    columns = readable(footers(spark, root)).select(F.col("source").alias("file_name"), F.explode("columns").alias("c"))
    return columns.select("file_name", "c.name", "c.type").distinct()
