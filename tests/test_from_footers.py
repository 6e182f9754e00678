"""Answers from footers equal those of a scan, and files are scanned only where footers do not say."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.builders import raw_table, write_month
from tripmart.plans import from_footers
from tripmart.plans.exploration import date_range_by_period, rows_by_type_year
from tripmart.sources.raw import read_trips


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def root(tmp_path):
    for taxi_type in ("yellow", "green"):
        for month in (1, 2):
            path = write_month(tmp_path, taxi_type, 2024, month, raw_table(taxi_type, 2024, month, rows=9 + month))
            pq.write_table(pq.read_table(path), path, row_group_size=4)
    return tmp_path


def agree(spark, root):
    trips = read_trips(spark, str(root))
    assert rows(from_footers.date_range(spark, str(root))) == rows(date_range_by_period(trips))
    assert rows(from_footers.rows_by_type_year(spark, str(root))) == rows(rows_by_type_year(trips))
    assert from_footers.count_rows(spark, str(root)).first()[0] == trips.count()


def scanned(result) -> int:
    """Raw files in the plan."""
    return sum("tripdata" in path for path in result.inputFiles())


def test_clean_files_are_not_scanned(spark, root):
    agree(spark, root)
    assert scanned(from_footers.date_range(spark, str(root))) == 0


def test_files_without_statistics_are_scanned_and_no_others(spark, root):
    path = root / "green" / "2024" / "green_tripdata_2024-02.parquet"
    pq.write_table(pq.read_table(path), path, write_statistics=False)
    assert scanned(from_footers.date_range(spark, str(root))) == 1
    agree(spark, root)


def test_nulls_empty_files_and_names_without_period(spark, root):
    none = pa.array([None] * 4, pa.timestamp("us"))
    write_month(root, "yellow", 2024, 3, raw_table("yellow", 2024, 3, rows=4, tpep_pickup_datetime=(none, pa.timestamp("us"))))
    write_month(root, "yellow", 2024, 4, raw_table("yellow", 2024, 4, rows=0))
    odd = root / "green" / "2024" / "green_tripdata_latest.parquet"
    odd.write_bytes((root / "green" / "2024" / "green_tripdata_2024-01.parquet").read_bytes())
    assert scanned(from_footers.date_range(spark, str(root))) == 0
    got = rows(from_footers.date_range(spark, str(root)))
    # a month without rows has no row in a scan
    assert got == rows(date_range_by_period(read_trips(spark, str(root))))


def test_unreadable_file_is_an_error(spark, root):
    (root / "green" / "2024" / "green_tripdata_2024-03.parquet").write_bytes(b"cut")
    with pytest.raises(OSError, match="2024-03"):
        from_footers.date_range(spark, str(root))
