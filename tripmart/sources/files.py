"""File listing, and access to single files from tasks.

A *source* is one monthly dataset, ``.../<type>_tripdata_YYYY-MM.parquet``. It may be a single
file or, as Spark writes it, a directory of part files; counts per source are the same for both.
"""

from __future__ import annotations

from functools import lru_cache
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How file names carry the taxi type and the period.
SOURCE_PATTERN = r"^(.*_\d{4}-\d{2}\.parquet)(?:/.*)?$"
PERIOD_PATTERN = r"_(\d{4})-(\d{2})\.parquet(?:/[^/]*)?$"
NAME_PATTERN = r"(yellow|green)_tripdata_(\d{4}-\d{2})"
TYPE_FOLDER_PATTERN = r"/(yellow|green)/"
YEAR_FOLDER_PATTERN = r"/(?:anio=)?(\d{4})/"

def source_of(path: Column) -> Column:
    """The monthly dataset a file belongs to; the file itself if its name carries no period."""
    found = F.regexp_extract(path, SOURCE_PATTERN, 1)
    return F.when(found != "", found).otherwise(path)


def below(path: str, root: str) -> str:
    """The part of a listed path that comes after the folder ``root``."""
    inner, folder = unquote(urlparse(path).path), (urlparse(root).path if ":" in root else root).rstrip("/") + "/"
    at = inner.find(folder if folder.startswith("/") else f"/{folder}")
    if at < 0:
        raise ValueError(f"{path} is not below {root}")
    return inner[inner.index(folder, at) + len(folder) :]


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """All Parquet files below a folder: (path, source, length, modified in milliseconds). File contents are not read.

    Spark plans a task per block of data; as none of it is read, tasks are merged to the number of shuffle
    partitions, which does not depend on how many executors have started.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(root)
    )
    path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    modified = F.unix_millis(F.col("_metadata.file_modification_time"))
    listed = files.select(path.alias("path"), source_of(path).alias("source"), size.alias("length"), modified.alias("modified"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return listed.coalesce(tasks)


# Address schemes of object stores, as Spark names them, and the names of their file systems.
_SCHEMES = {"s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs"}


@lru_cache(maxsize=64)
def _file_system(scheme: str, host: str):
    """One handle for each store and Python worker; an unknown scheme is an error."""
    from pyarrow import fs

    if scheme in ("", "file"):
        return fs.LocalFileSystem()
    if scheme not in _SCHEMES:
        raise ValueError(f"no file system for {scheme}://{host}")
    return fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}://{host}/")[0]


def _open(path: str):
    """Open a file by the address Spark lists it under."""
    url = urlparse(path)
    inner = unquote(url.path)
    # Object stores address files as bucket/key, HDFS and local disks by absolute path.
    whole = inner if url.scheme in ("", "file", "hdfs", "viewfs") else url.netloc.split("@")[0] + inner
    return _file_system(url.scheme, url.netloc).open_input_file(whole)
