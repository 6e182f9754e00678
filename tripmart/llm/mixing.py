"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled queue, once for each permitted repeat. A document's
virtual finish time is the number of tokens its source has sent when it is done, divided by the
source's target. Serving all queues by finish time and stopping at the total budget gives each
source its target to within about a document.

Both cumulative sums (over a source's queue, over all finish times) are taken in two steps so that no
source and no range is one task: rows are put in range buckets whose number follows the table,
sums of whole buckets give each bucket its offset, and a window runs inside a bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.llm.common import named, row_of, stored

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_TAKES = 2
BUCKET_ROWS = 20_000  # rows a range bucket holds on average
_SPAN = 1 << 32


def count_words(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, line and page breaks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, takes: int = MAX_TAKES) -> DataFrame:
    """``source_key, source_size, target`` from rows of ``source_key, source, size``.

    Sources in code-point order, null last, get the weights in turn. Targets share the budget by weight
    but stop at ``takes`` times the source's size. Sorted by cap per weight, the level at which the
    others stand is the greatest of (budget left) / (weight left). Works on one row a source.
    """
    per_source = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    )
    ranked = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * takes)
    everything = Window.partitionBy()
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(
        F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )) / F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        ranked.withColumn("level", level)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight")))
        .select("source_key", "source_size", "target")
    )


def _offsets(df: DataFrame, within: list[str], bucket: str, name: str) -> DataFrame:
    """For each bucket the sum of ``size`` over all earlier buckets (of the same ``within``)."""
    sums = df.groupBy(*within, bucket).agg(F.sum("size").alias("s"))
    earlier = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*within, bucket, F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias(name))


def fair_queue(
    docs: DataFrame, size: Column, source: str = "source", doc_id: str = "doc_id",
    weights=WEIGHTS, share: float = BUDGET_SHARE, takes: int = MAX_TAKES,
) -> DataFrame:
    """All turns of all documents: ``row`` (the document's columns), ``size, source_size, target, turn,
    finish, start, taken`` and ``queue, slot, place``, which together name a document's row.

    ``start`` is the number of tokens served before the turn in the global order; turns that end within the budget
    are ``taken``. Order: finish time, then source, turn, MD5 of the id (the shuffle), id, size.
    Reruns give the same order; rows that agree in all of these are alike. Null sources form a
    source of their own, null ids count as the empty text, documents without tokens cost nothing and
    are taken with their neighbours. Empty tables give no rows.
    """
    key = F.md5(F.coalesce(named(docs, doc_id).cast("string"), F.lit("")).cast("binary"))
    base = docs.select(
        row_of(docs), F.coalesce(size, F.lit(0)).cast("long").alias("size"), named(docs, source).alias("source"),
        named(docs, doc_id).alias("id"), key.alias("key"),
    ).withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    light = stored(base.select("source_key", "source", "size", "key"), "sizes")
    targets = stored(source_targets(light, weights, share, takes), "targets")
    rows, budget = light.count(), targets.agg(F.coalesce(F.sum("source_size") * F.lit(share), F.lit(0.0))).first()[0]
    buckets = 1 + rows // BUCKET_ROWS

    hashed = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    slot = F.floor(hashed * F.lit(buckets) / F.lit(_SPAN)).alias("slot")
    in_slot = Window.partitionBy("source_key", "slot").orderBy("key", F.col("id").asc_nulls_first(), "size")
    offsets = _offsets(light.select("source_key", slot, "size"), ["source_key"], "slot", "before")
    queued = (
        base.withColumn("slot", slot)
        .withColumn("done", F.sum("size").over(in_slot.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("place", F.row_number().over(in_slot))
        .join(offsets, ["source_key", "slot"])
        .join(targets, "source_key")
    )
    sent = F.col("turn") * F.col("source_size") + F.col("before") + F.col("done")
    finish = F.when(F.col("target") > 0, sent / F.col("target")).otherwise(hashed / F.lit(float(_SPAN)))
    turns = queued.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(takes - 1)))).withColumn("finish", finish)
    turns = turns.withColumn("range", F.floor(F.col("finish") * F.lit(buckets)))

    # The offset of each range needs the light columns only.
    ranges = _offsets(turns.select("range", "size"), [], "range", "served")
    in_range = Window.partitionBy("range").orderBy(
        "finish", F.col("source").asc_nulls_last(), "turn", "key", F.col("id").asc_nulls_first(), "size"
    )
    end = F.col("served") + F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0))
    return (
        turns.join(stored(ranges, "ranges"), "range")
        .withColumn("end", end)
        .select(
            "row", "size", "source_size", "target", (F.col("turn") + 1).alias("turn"), "finish", (F.col("end") - F.col("size")).alias("start"),
            (F.col("end") <= F.lit(budget)).alias("taken"), F.col("source_key").alias("queue"), "slot", "place",
        )
    )


def mix(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mixed documents: a row for each turn taken, with the document's own columns.

    Rows of one finish-time range are sorted in their partition; ``fair_queue`` gives the global
    position to readers that need it.
    """
    return fair_queue(docs, size, **options).where("taken").select("row.*")
