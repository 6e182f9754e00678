"""The footer catalogue: files are opened once, and what is read is what was listed."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.builders import raw_table, write_month
from tests.test_raw import _write_years
from tripmart.plans.indicators import INDICATORS
from tripmart.sources import catalogue as module
from tripmart.sources.catalogue import Dataset, FooterCatalogue, default_catalogue, read_groups
from tripmart.sources.files import below
from tripmart.sources.raw import is_dated, read_trips, scan_raw
from tripmart.sources.zones import read_zones


def opened(catalogue, spark) -> int:
    """Footers opened since the catalogue began."""
    return spark.read.schema(module.FOOTERS).parquet(f"{catalogue.folder}/footers").count()


def spoil(path):
    """Other bytes under the same name, length and time: who opens the file again fails."""
    status = path.stat()
    path.write_bytes(b"x" * status.st_size)
    os.utime(path, ns=(status.st_atime_ns, status.st_mtime_ns))


def test_unchanged_files_are_not_opened_again(spark, tmp_path):
    paths = [write_month(tmp_path / "raw", "yellow", 2024, month) for month in (1, 2, 3)]
    root, catalogue = str(tmp_path / "raw"), FooterCatalogue(spark, str(tmp_path / "footers"))
    first = catalogue.snapshot(root)
    assert first.files.count() == opened(catalogue, spark) == 3
    for path in paths:
        spoil(path)
    assert catalogue.snapshot(root) is first
    # another session finds the stored table
    again = FooterCatalogue(spark, catalogue.folder).snapshot(root)
    assert {r["num_rows"] for r in again.files.collect()} == {3}
    assert opened(catalogue, spark) == 3


def test_only_new_and_changed_files_are_opened(spark, tmp_path):
    root = tmp_path / "raw"
    first, second, third = (write_month(root, "yellow", 2024, month) for month in (1, 2, 3))
    catalogue = FooterCatalogue(spark, str(tmp_path / "footers"))
    catalogue.snapshot(str(root))
    spoil(first)
    pq.write_table(raw_table("yellow", 2024, 2, rows=7), second)
    third.unlink()
    write_month(root, "green", 2024, 1)
    rows = {os.path.basename(r["path"]): r["num_rows"] for r in catalogue.snapshot(str(root)).files.collect()}
    assert rows == {"yellow_tripdata_2024-01.parquet": 3, "yellow_tripdata_2024-02.parquet": 7, "green_tripdata_2024-01.parquet": 3}
    assert opened(catalogue, spark) == 5
    assert catalogue.snapshot(str(root / "green")).files.count() == 1 and opened(catalogue, spark) == 5


def test_statistics_of_columns(spark, tmp_path):
    table = pa.table({"n": [3, None, 1], "s": ["b", "a", None], "empty": pa.array([None] * 3, pa.float64())})
    path = write_month(tmp_path, "yellow", 2024, 1, table)
    pq.write_table(table, path, row_group_size=2)
    bare = write_month(tmp_path, "yellow", 2024, 2, table)
    pq.write_table(table, bare, write_statistics=False)
    files = FooterCatalogue(spark, str(tmp_path / "footers")).snapshot(str(tmp_path / "yellow")).files
    found = {(r["path"][-10:-8], c["name"]): (c["nulls"], c["low"], c["high"]) for r in files.collect() for c in r["columns"]}
    assert found["01", "n"] == (1, "1", "3") and found["01", "s"] == (1, "a", "b") and found["01", "empty"] == (3, None, None)
    assert found["02", "n"] == (None, None, None)


def test_plan_has_no_regular_expression_and_prunes_months(spark, tmp_path):
    _write_years(tmp_path, {2024: (1, 2, 3, 4, 5, 6)})
    trips = read_trips(spark, str(tmp_path))
    plan = INDICATORS["ind_01_viajes_mensuales"](trips, read_zones(spark, None))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()
    month = scan_raw(spark, str(tmp_path), "yellow").where("src_month = 2")
    assert [r["src_year"] for r in month.collect()] == [2024] * 3
    leaves = month._jdf.queryExecution().executedPlan().collectLeaves()
    assert sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())) == 1


def test_layouts_that_differ_in_logical_types_only(spark, tmp_path):
    write_month(tmp_path, "yellow", 2024, 1, raw_table("yellow", 2024, 1))
    plain = raw_table("yellow", 2024, 2, store_and_fwd_flag=(["N"] * 3, pa.string()))
    write_month(tmp_path, "yellow", 2024, 2, plain)
    write_month(tmp_path, "yellow", 2024, 3, raw_table("yellow", 2024, 3, store_and_fwd_flag=([b"N"] * 3, pa.binary())))
    snapshot = default_catalogue(spark).snapshot(str(tmp_path))
    assert len({d.layout for d in snapshot.datasets}) == 3
    rows = scan_raw(spark, str(tmp_path), "yellow").select("src_month", "store_and_fwd_flag").distinct().collect()
    assert {(r[0], r[1] and bytes(r[1])) for r in rows} == {(1, None), (2, b"N"), (3, b"N")}


def test_names_with_blanks_and_percent_signs(spark, tmp_path):
    root = tmp_path / "raw data %20"
    _write_years(root, {2024: (1, 2)})
    trips = read_trips(spark, str(root))
    assert trips.count() == 12 and {r[0] for r in trips.select("src_month").distinct().collect()} == {1, 2}


def test_files_that_come_while_reading_are_noticed(spark, tmp_path, monkeypatch):
    _write_years(tmp_path, {2024: (1, 2)})
    catalogue = FooterCatalogue(spark, str(tmp_path / "footers"))
    root, read = str(tmp_path), FooterCatalogue.read

    def late(self, group, sample):
        if not (tmp_path / "yellow" / "2024" / "yellow_tripdata_2024-03.parquet").exists():
            write_month(tmp_path, "yellow", 2024, 3)
        return read(self, group, sample)

    monkeypatch.setattr(FooterCatalogue, "read", late)
    assert scan_raw(spark, root, "yellow", catalogue=catalogue).count() == 9
    monkeypatch.setattr(FooterCatalogue, "read", lambda self, group, sample: None)
    with pytest.raises(OSError, match="change"):
        scan_raw(spark, root, "yellow", catalogue=catalogue)


def _file(path, layout="a"):
    return Dataset(path, layout, path, 1)


def test_folders_stand_for_all_their_files():
    months = [_file(f"file:/r/yellow/{y}/y_{y}-{m:02d}.parquet", "a" if y < 2026 else "b") for y in (2024, 2025, 2026) for m in (1, 2)]
    first, last = read_groups(months, months, is_dated)
    assert first.paths == ("file:/r/yellow/2024", "file:/r/yellow/2025") and first.files == 4 and first.dated
    assert last.paths == ("file:/r/yellow/2026",)
    [some] = read_groups(months, months[1:4], is_dated)
    assert some.paths == (months[1].path, "file:/r/yellow/2025")
    [one] = read_groups(months, months[:1], is_dated)
    assert one.paths == (months[0].path,) and one.slashes is None
    odd = [*months, _file("file:/r/yellow/2024/latest.parquet")]
    assert [g.dated for g in read_groups(odd, odd, is_dated)] == [True, False, True] or len(read_groups(odd, odd, is_dated)) == 3
    parts = [Dataset("file:/r/x_2024-01.parquet", "a", "file:/r/x_2024-01.parquet/p0.parquet", 3)]
    [whole] = read_groups(parts, parts, is_dated)
    assert whole.files == 3 and whole.slashes == 2


def test_below():
    assert below("file:/data/raw/yellow/a.parquet", "/data/raw/") == "yellow/a.parquet"
    assert below("viewfs:/in/raw/green/a.parquet", "viewfs:///in/raw") == "green/a.parquet"
    assert below("file:/home/x/raw/green/a%20b.parquet", "raw") == "green/a b.parquet"
    with pytest.raises(ValueError, match="below"):
        below("file:/data/raw/a.parquet", "/other")
