import pyarrow as pa
import pytest

from tests.builders import raw_table, write_month
from tripmart.operators.sinks import materialize_trips, subset_by_files
from tripmart.plans import audit, evolution, incorporation
from tripmart.plans.eda import pickup_boroughs
from tripmart.plans.indicators import top_pickup_zones
from tripmart.sources.catalogue import footer_metadata, footer_schema
from tripmart.sources.files import _open
from tripmart.sources.raw import read_trips, scan_raw, sources_of_first_periods
from tripmart.sources.schema import TRIPS_COLUMNS, TRIPS_SCHEMA
from tripmart.sources.zones import read_zones


def test_types_widen_and_names_ignore_case(spark, tmp_path):
    write_month(tmp_path, "yellow", 2024, 1, raw_table("yellow", 2024, 1, VendorID=pa.int64(), passenger_count=([1.0, 2.5, None], pa.float64())))
    changed = raw_table("yellow", 2024, 2, Airport_fee=None, airport_fee=([2.0] * 3, pa.float64()))
    write_month(tmp_path, "yellow", 2024, 2, changed)
    added = raw_table("yellow", 2025, 1, cbd_congestion_fee=([0.75] * 3, pa.float64()))
    write_month(tmp_path, "yellow", 2025, 1, added)
    raw = scan_raw(spark, str(tmp_path), "yellow")
    types = {f.name: f.dataType.simpleString() for f in raw.schema.fields}
    assert types["VendorID"] == "bigint" and types["passenger_count"] == "double"
    assert types["Airport_fee"] == "double" and "airport_fee" not in types
    rows = {(r["src_year"], r["src_month"]): r for r in raw.collect()}
    assert rows[2024, 1]["cbd_congestion_fee"] is None and rows[2025, 1]["cbd_congestion_fee"] == 0.75
    assert rows[2024, 1]["Airport_fee"] == 1.75 and rows[2024, 2]["Airport_fee"] == 2.0


def test_normalized_schema_and_half_even_counts(spark, tmp_path):
    fractional = raw_table("yellow", 2024, 1, passenger_count=([1.5, 2.5, None], pa.float64()))
    write_month(tmp_path, "yellow", 2024, 1, fractional)
    write_month(tmp_path, "green", 2024, 1, raw_table("green", 2024, 1))
    trips = read_trips(spark, str(tmp_path))
    assert trips.columns == TRIPS_COLUMNS
    assert [f.dataType for f in trips.schema.fields] == [f.dataType for f in TRIPS_SCHEMA.fields]
    counts = [r["passenger_count"] for r in trips.where("taxi_type = 'yellow'").orderBy("pickup_ts").collect()]
    assert counts == [2, 2, None]


def test_name_without_period_is_kept_but_never_clean(spark, tmp_path):
    good = write_month(tmp_path, "green", 2024, 1)
    odd = good.with_name("green_tripdata_latest.parquet")
    odd.write_bytes(good.read_bytes())
    raw = scan_raw(spark, str(tmp_path), "green")
    assert {(r["src_year"], r["src_month"]): r["count"] for r in raw.groupBy("src_year", "src_month").count().collect()} == {
        (2024, 1): 3, (None, None): 3,
    }


def test_folder_of_parts_and_mixed_schemas_are_one_source(spark, tmp_path):
    import pyarrow.parquet as pq

    folder = tmp_path / "yellow" / "2024" / "yellow_tripdata_2024-03.parquet"
    folder.mkdir(parents=True)
    pq.write_table(raw_table("yellow", 2024, 3, rows=2), folder / "part-0.parquet")
    pq.write_table(raw_table("yellow", 2024, 3, rows=3, VendorID=pa.int64()), folder / "part-1.parquet")
    other = tmp_path / "yellow" / "2024" / "yellow_tripdata_2024-04.parquet"
    other.mkdir()
    pq.write_table(raw_table("yellow", 2024, 4, rows=4), other / "part-0.parquet")
    raw = scan_raw(spark, str(tmp_path), "yellow")
    assert {r["filename"] for r in raw.collect()} == {f"file:{folder}", f"file:{other}"}
    assert sorted((r["src_month"], r["count"]) for r in raw.groupBy("src_month").count().collect()) == [(3, 5), (4, 4)]
    assert audit.total_files(spark, str(tmp_path)).first()[0] == 2


def test_duplicated_period_is_found(spark, tmp_path):
    write_month(tmp_path, "yellow", 2024, 1)
    write_month(tmp_path, "green", 2024, 1)
    copy = tmp_path / "yellow" / "2025" / "yellow_tripdata_2024-01.parquet"
    copy.parent.mkdir()
    copy.write_bytes((tmp_path / "yellow" / "2024" / "yellow_tripdata_2024-01.parquet").read_bytes())
    found = incorporation.duplicated_periods(read_trips(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in found] == [("yellow", 2024, 1, 2)]


def _write_years(root, years):
    for year, months in years.items():
        for month in months:
            for taxi_type in ("yellow", "green"):
                write_month(root, taxi_type, year, month)


def test_new_year_is_part_of_the_next_result(spark, tmp_path):
    _write_years(tmp_path, {2024: (1, 2, 3)})
    root = str(tmp_path)
    one = incorporation.months_by_year(read_trips(spark, root))
    assert one.columns == ["taxi_type", "mes", "2024"]
    _write_years(tmp_path, {2025: (1, 2, 3), 2026: (1, 2)})
    trips = read_trips(spark, root)
    three = incorporation.months_by_year(trips)
    assert three.columns == ["taxi_type", "mes", "2024", "2025", "2026"]
    assert {r["2026"] for r in three.where("mes = 3").collect()} == {0}
    assert {r["meses_presentes"] for r in incorporation.months_present(trips).where("src_year = 2026").collect()} == {2}
    years = evolution.yearly_summary(trips).orderBy("taxi_type", "src_year").collect()
    assert [(r["src_year"], r["viajes"]) for r in years[:3]] == [(2024, 6), (2025, 6), (2026, 6)]
    assert {r["archivos"] for r in audit.files_by_type_year(spark, root).where("anio = '2026'").collect()} == {2}


def test_first_periods_open_only_their_files(spark, tmp_path):
    _write_years(tmp_path, {2024: (1, 2, 3)})
    root = str(tmp_path)
    sources = sources_of_first_periods(spark, root, 2)
    assert len(sources) == 4
    part = read_trips(spark, root, sources)
    assert len(part.inputFiles()) == 4
    assert part.exceptAll(subset_by_files(read_trips(spark, root), sources)).count() == 0
    assert part.count() == 12
    table = materialize_trips(read_trips(spark, root), f"{root}/table", sources)
    assert table.count() == 12 and table.columns == TRIPS_COLUMNS


def test_no_zone_file_gives_defaults(spark, tmp_path):
    _write_years(tmp_path, {2024: (1,)})
    trips, zones = read_trips(spark, str(tmp_path)), read_zones(spark, None)
    assert read_zones(spark, str(tmp_path / "no such.csv")).schema == zones.schema
    assert read_zones(spark, str(tmp_path / "no such.csv")).count() == 0
    assert {r["borough"] for r in pickup_boroughs(trips, zones).collect()} == {"Sin zona"}
    assert {(r["zona"], r["borough"]) for r in top_pickup_zones(trips, zones).collect()} == {("Zona 10", "N/D")}


def test_missing_folder_is_an_error(spark, tmp_path):
    (tmp_path / "yellow").mkdir()
    with pytest.raises(FileNotFoundError):
        scan_raw(spark, str(tmp_path), "yellow")


def test_unreadable_file_is_an_error_for_all_but_the_audit(spark, tmp_path):
    _write_years(tmp_path, {2024: (1, 2)})
    broken = tmp_path / "yellow" / "2024" / "yellow_tripdata_2024-03.parquet"
    broken.write_bytes(b"PAR1 cut short")
    root = str(tmp_path)
    for read in (read_trips, audit.rows_footer_vs_scan):
        with pytest.raises(Exception, match="2024-03"):
            read(spark, root).collect()
    for read in (footer_metadata, footer_schema):
        with pytest.raises(Exception, match="2024-03"):
            read(spark, root).collect()


def test_period_filters_prune_files(spark, tmp_path):
    _write_years(tmp_path, {2024: (1, 2, 3)})
    month = scan_raw(spark, str(tmp_path), "yellow").where("src_month = 2")
    month.collect()
    plan = month._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    assert sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())) == 1


def test_unknown_scheme_is_an_error():
    with pytest.raises(ValueError, match="odd://host"):
        _open("odd://host/yellow_tripdata_2024-01.parquet")


def test_corrupt_part_fails_with_one_layout_and_with_two(spark, tmp_path):
    import pyarrow.parquet as pq

    _write_years(tmp_path, {2024: (1,)})
    folder = tmp_path / "yellow" / "2024" / "yellow_tripdata_2024-03.parquet"
    folder.mkdir()
    pq.write_table(raw_table("yellow", 2024, 3), folder / "part-0.parquet")
    (folder / "part-1.parquet").write_bytes(b"no parquet")
    with pytest.raises(OSError, match="part-1"):
        read_trips(spark, str(tmp_path))
    pq.write_table(raw_table("yellow", 2024, 3, VendorID=pa.int64()), folder / "part-2.parquet")
    with pytest.raises(OSError, match="part-1"):
        read_trips(spark, str(tmp_path))
