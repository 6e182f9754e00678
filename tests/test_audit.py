from datetime import date

import pyarrow.parquet as pq

from tests.builders import raw_table, write_month
from tripmart.plans import audit
from tripmart.sources.catalogue import footer_metadata, footer_schema


def test_footers_equal_a_direct_read(spark, tmp_path):
    path = write_month(tmp_path, "yellow", 2024, 1)
    pq.write_table(raw_table("yellow", 2024, 1, rows=10), path, row_group_size=4)
    row = footer_metadata(spark, str(tmp_path)).first()
    assert (row["num_rows"], row["num_row_groups"], row["file_size_bytes"]) == (10, 3, path.stat().st_size)
    meta = pq.ParquetFile(path).metadata
    expected = {(meta.schema.column(i).name, meta.schema.column(i).physical_type) for i in range(meta.num_columns)}
    assert {(r["name"], r["type"]) for r in footer_schema(spark, str(tmp_path)).collect()} == expected
    shown = audit.rows_per_file(spark, str(tmp_path)).first()
    assert (shown["taxi_type"], shown["periodo"], shown["num_row_groups"]) == ("yellow", "2024-01", 3)
    assert shown["mib"] == round(path.stat().st_size / 1048576, 1)


def test_every_audit_state(spark, tmp_path):
    ok, small, local, unpublished = (write_month(tmp_path, "yellow", 2024, m) for m in (1, 2, 3, 4))
    (ok.parent / "yellow_tripdata_2024-05.parquet").write_bytes(b"not parquet")
    (ok.parent / "yellow_tripdata_2024-06.parquet").write_bytes(b"")
    size = ok.stat().st_size
    published = [
        ("yellow", "2024-01", True, size), ("yellow", "2024-02", True, size + 1), ("yellow", "2024-04", False, None),
        ("yellow", "2024-05", True, None), ("yellow", "2024-06", True, 100), ("yellow", "2024-07", False, None),
    ]
    manifest = spark.createDataFrame(published, audit.MANIFEST_SCHEMA)
    result = audit.completeness_audit(spark, str(tmp_path), manifest, [2024], date(2024, 8, 15), ("yellow",))
    states = {r["periodo"]: (r["estado"], r["filas"]) for r in result.collect()}
    assert states == {
        "2024-01": ("OK", 3), "2024-02": ("TAMANO_DISTINTO", 3), "2024-03": ("SOLO_LOCAL", 3), "2024-04": ("OK", 3),
        "2024-05": ("ILEGIBLE", None), "2024-06": ("FALTA", None), "2024-07": ("NO_PUBLICADO", None), "2024-08": ("FALTA?", None),
    }
    summary = {r["estado"]: (r["periodos"], r["filas"], r["problema"]) for r in audit.audit_summary(result).collect()}
    assert summary["OK"] == (2, 6, False) and summary["ILEGIBLE"] == (1, 0, True) and summary["FALTA?"][2]
