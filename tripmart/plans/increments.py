"""Keeping the trips table and the indicators up to date as monthly files come, change or go.

A run compares the footer catalogue's listing with the digests in the table's manifest, reads the files of new and
changed months only, adds up cells of those months only, and derives the indicators from the cells of all months.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.operators.month_table import Month, MonthTable
from tripmart.plans.cells import indicators_of, trip_cells, zone_cells
from tripmart.plans.month_profiles import merged_profile, month_profiles
from tripmart.sources.catalogue import FooterCatalogue, Snapshot, default_catalogue
from tripmart.sources.files import below
from tripmart.sources.raw import is_dated, period_of, read_trips
from tripmart.sources.schema import TRIPS_SCHEMA


def month_of(source: str, root: str) -> Month:
    """Taxi type and period of a dataset; files without a period in their name are a month of their own, without numbers."""
    return (below(source, root).split("/")[0], *(period_of(source) if is_dated(source) else (None, None)))


def month_sources(snapshot: Snapshot, root: str) -> tuple[dict[Month, list[str]], dict[Month, str]]:
    """The datasets of each month, and a digest of their files: any file that is added, replaced or removed changes it."""
    file = F.xxhash64("path", "file_size_bytes", "modified")
    rows = snapshot.files.groupBy("source").agg(F.count("*").alias("files"), F.bit_xor(file).alias("mark")).collect()
    sources, marks = defaultdict(list), defaultdict(list)
    for row in sorted(rows):
        month = month_of(row["source"], root)
        sources[month].append(row["source"])
        marks[month].append(tuple(row))
    return dict(sources), {m: hashlib.sha256(repr(found).encode()).hexdigest() for m, found in marks.items()}


@dataclass(frozen=True)
class Warehouse:
    """Trips by month, the cells that indicators are made of, and column profiles, below one folder."""

    trips: MonthTable
    cells: MonthTable
    zones: MonthTable
    profiles: MonthTable

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Warehouse:
        none = spark.createDataFrame([], TRIPS_SCHEMA)
        root = path.rstrip("/")
        return cls(
            MonthTable(spark, f"{root}/trips", TRIPS_SCHEMA),
            MonthTable(spark, f"{root}/cells", trip_cells(none).schema, folders=False),
            MonthTable(spark, f"{root}/zones", zone_cells(none).schema, folders=False),
            MonthTable(spark, f"{root}/profiles", month_profiles(none).schema, folders=False),
        )

    def update(
        self, root: str, sources: Collection[str] | None = None, catalogue: FooterCatalogue | None = None
    ) -> dict[str, list[Month]]:
        """Take over the raw files below ``root`` as they are now (or only some ``sources``), and add up what changed.

        Returns the months that each table wrote anew. A run that fails leaves the published states; the
        next one goes on from them, so a table that was published before the failure is not written again.
        """
        spark = self.trips.spark
        snapshot = (catalogue or default_catalogue(spark)).snapshot(root)
        by_month, digests = month_sources(snapshot, root)
        if sources is not None:
            chosen = {m: [name for name in names if name in set(sources)] for m, names in by_month.items()}
            digests = {m: digests[m] if names == by_month[m] else f"{digests[m]} {names}" for m, names in chosen.items() if names}
            by_month = chosen

        def rows(months: list[Month]) -> DataFrame:
            return read_trips(spark, root, [name for m in months for name in by_month[m]], catalogue, snapshot)

        written = {"trips": self.trips.replace(digests, rows)}
        return written | self.add_up()

    def add_up(self) -> dict[str, list[Month]]:
        """Bring the cells in line with the published trips."""
        state = self.trips.state()
        digests = {m: f"{entry.run}:{entry.digest}" for m, entry in state.months.items()}
        return {
            "cells": self.cells.replace(digests, lambda months: trip_cells(self.trips.read(months, state))),
            "zones": self.zones.replace(digests, lambda months: zone_cells(self.trips.read(months, state))),
        }

    def add_profiles(self) -> list[Month]:
        """Bring the column profiles in line with the published trips; apart from ``add_up``, as sketches cost more."""
        state = self.trips.state()
        digests = {m: f"{entry.run}:{entry.digest}" for m, entry in state.months.items()}
        return self.profiles.replace(digests, lambda months: month_profiles(self.trips.read(months, state)))

    def profile(self, months: Collection[Month] | None = None) -> DataFrame:
        """Profile of all months or some, merged from stored ones; the trips are not read."""
        return merged_profile(self.profiles.read(months))

    def indicators(self, zones: DataFrame) -> dict[str, Callable[[], DataFrame]]:
        """Builders of the ten indicators from the published cells; the trips are not read."""
        return indicators_of(self.cells.read(), self.zones.read(), zones)
