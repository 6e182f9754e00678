"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every child of ``parent`` moves to the smallest neighbour of ``parent``."""
    both = edges.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(
        edges.select(F.col("parent").alias("u"), F.col("child").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    moved = edges.join(least, edges["parent"] == least["u"]).select("child", F.col("low").alias("parent"))
    return moved.where(F.col("child") != F.col("parent")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """All parents of a node, and the node itself, move to its smallest parent."""
    least = edges.groupBy("child").agg(F.min("parent").alias("low"))
    others = (
        edges.join(least, "child")
        .where(F.col("parent") != F.col("low"))
        .select(F.col("parent").alias("child"), F.col("low").alias("parent"))
    )
    return others.unionByName(least.select("child", F.col("low").alias("parent"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node that has an edge.

    ``edges``: two columns of long values, one undirected edge a row; loops and repeats are allowed.
    Returns ``node, root``; nodes that are themselves roots have no row. Each round is two joins on
    nodes; hubs are combined before the shuffle, and a hub's rows on the other side of the join are
    left to adaptive skew splitting. The edges stay in tables; the driver sees only a count and a checksum.
    """
    a, b = edges.columns
    current = stored(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("child", "parent"))).first()
        if now == mark or now[0] == 0:
            return current.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        mark = now
        current = stored(_small_star(_large_star(current)), "edges")
