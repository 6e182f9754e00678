"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.session import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table.

    Cuts lineage: a lost executor costs a re-read, not a recomputation, and Spark knows the real
    size when it decides whether to broadcast.
    """
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; the fast path is for texts of ASCII characters only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def quoted(name: str) -> str:
    """A column name as Spark parses it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def named(df: DataFrame, name: str) -> Column:
    """The column of ``df`` with exactly that name."""
    return df[quoted(name)]


def row_of(df: DataFrame, name: str = "row") -> Column:
    """All columns of a row as one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*[named(df, c) for c in df.columns]).alias(name)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Yield the rows of each key, one table at a time, from batches sorted by ``keys``."""
    rest: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        table = table.combine_chunks()
        changed = None
        for key in keys:
            column = table.column(key).to_numpy()
            step = column[1:] != column[:-1]
            changed = step if changed is None else changed | step
        cuts = [0, *(changed.nonzero()[0] + 1).tolist()]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield table.slice(start, end - start)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest
