"""A table kept by taxi type and month, of which a run replaces only the months that changed.

Each run writes its months into a folder of its own and then publishes a manifest, one row in one file, that says
for every month which run holds it. Readers look at the newest manifest and at nothing else, so until it is there they see the old
state whole, whatever a failed or unfinished run has left. Folders that no manifest in use names may be deleted at any time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


MONTH = ["taxi_type", "src_year", "src_month"]
Month = tuple[str, int | None, int | None]

_ENTRY = "struct<taxi_type: string, src_year: int, src_month: int, digest: string, run: string>"
_MANIFEST = f"version bigint, run string, entries array<{_ENTRY}>"


class PublishedElsewhere(RuntimeError):
    """Another run published from the same state first; its state stands, and the run may be repeated."""


@dataclass(frozen=True)
class Entry:
    """What a month was made of, and the run that holds its rows."""

    digest: str
    run: str


@dataclass(frozen=True)
class State:
    version: int = 0
    months: Mapping[Month, Entry] = field(default_factory=dict)


def _name(taxi_type: Column, year: Column, month: Column, run: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in (run, taxi_type, year, month)]
    return F.concat_ws("|", *parts)


class MonthTable:
    """``path`` is a folder in storage that driver and executors share; ``schema`` has the three columns of MONTH.

    Large tables have a folder for each month of a run. Small ones, such as sums by month, do without (``folders=False``): a run is
    then a few files, and rows of months that later runs replaced are filtered as they are read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, folders: bool = True):
        self.spark, self.path, self.schema, self.folders = spark, path.rstrip("/"), schema, folders

    def _newest(self) -> Row | None:
        try:
            manifests = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return manifests.orderBy(F.col("version").desc(), "run").first()

    def state(self) -> State:
        """The published months; nothing has been published at version 0."""
        newest = self._newest()
        if newest is None:
            return State()
        months = {(e["taxi_type"], e["src_year"], e["src_month"]): Entry(e["digest"], e["run"]) for e in newest["entries"]}
        return State(newest["version"], months)

    def read(self, months: Collection[Month] | None = None, state: State | None = None) -> DataFrame:
        """The published rows, or those of some months; only their folders are opened."""
        entries = (state or self.state()).months
        chosen = {m: e for m, e in entries.items() if months is None or m in months}
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        data = f"{self.path}/data"
        runs = [f"{data}/run={run}" for run in sorted({e.run for e in chosen.values()})]
        stored = T.StructType([*self.schema.fields, T.StructField("run", T.StringType())])
        rows = self.spark.read.schema(stored).option("basePath", data).parquet(*runs)
        # with folders these are partition columns only, so that other months are pruned when the scan is planned
        names = ["|".join("-" if v is None else str(v) for v in (e.run, *m)) for m, e in chosen.items()]
        held = _name(*[F.col(c) for c in (*MONTH, "run")]).isin(names)
        return rows.where(held).select(*self.schema.fieldNames())

    def replace(self, wanted: Mapping[Month, str], build: Callable[[list[Month]], DataFrame]) -> list[Month]:
        """Make the table hold the ``wanted`` months, given with a digest of what each is made of.

        ``build`` gives the rows of the months whose digest is new; months that are no longer wanted go. Returns the months
        that were built; nothing is written if all is as before.
        """
        before = self.state()
        changed = sorted((m for m, digest in wanted.items() if m not in before.months or before.months[m].digest != digest), key=str)
        if not changed and set(before.months) == set(wanted):
            return []
        run = uuid.uuid4().hex
        if changed:
            # an empty result still leaves the run's folder
            rows, path = build(changed).select(*self.schema.fieldNames()), f"{self.path}/data/run={run}"
            if self.folders:
                rows.hint("rebalance", *MONTH).write.partitionBy(*MONTH).parquet(path)
            else:
                rows.hint("rebalance").write.parquet(path)
        after = {m: before.months[m] for m in wanted if m not in changed} | {m: Entry(wanted[m], run) for m in changed}
        self._publish(before.version + 1, run, after)
        return changed

    def _publish(self, version: int, run: str, months: Mapping[Month, Entry]) -> None:
        """Append the manifest; of two runs that publish the same version, the one with the smaller name counts."""
        entries = [(*m, e.digest, e.run) for m, e in months.items()]
        row = self.spark.createDataFrame([(version, run, entries)], _MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifests")
        newest = self._newest()
        if newest["version"] == version and newest["run"] != run:
            raise PublishedElsewhere(f"{self.path}: version {version} is run {newest['run']}")
