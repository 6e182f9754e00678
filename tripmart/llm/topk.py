"""Exact top-k search by distributed histogram selection.

All scores are computed block by block and never stored. Each pass counts, for every query, the scores in equal
bins of the interval that is known to hold its k-th highest score; the counts of all blocks are added and the
interval shrinks to one bin. When bins are one unit wide the k-th score is known; a last pass
emits the scores above it and, of those equal to it, the k smallest ids of each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.llm.common import named, stored

K = 10
SCALE = 1024
BINS = 2048
QUERY_BLOCK = 1024  # queries in a block
SHARD_ROWS = 32_768  # vectors in a shard, at most about
SLICE = 4096  # vectors scored at a time


def quantised(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` with v = floor(SCALE * x) of each component, x as double.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part. Rows that repeat an id count once (the smallest vector). Shorter vectors are
    treated as if they ended in zeros.
    """
    x = named(df, vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return (
        df.where(x.isNotNull() & named(df, vec_id).isNotNull() & ~F.coalesce(bad, F.lit(False)))
        .select(
            named(df, vec_id).cast("long").alias("vec_id"),
            F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v"),
        )
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def _matrix(lists: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _packer(dims: int, key: str, extra: tuple[str, ...] = ()):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        packed = {key: [rows[key].iloc[0]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()]}
        packed["m"] = [_matrix(rows["v"], dims).tobytes()]
        for name in extra:
            packed[name] = [rows[name].to_numpy(np.int64).tobytes()]
        return pd.DataFrame(packed)

    return pack


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while they hold them, else in 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if top < 2.0**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if top >= 2.0**63:
        raise ArithmeticError("inner products may leave the range of 64-bit integers")
    return q @ v.T


def _blocks(frames: Iterator[pd.DataFrame], dims: int):
    for frame in frames:
        for r in frame.itertuples():
            q = np.frombuffer(r.q_m, np.int64).reshape(-1, dims)
            v = np.frombuffer(r.v_m, np.int64).reshape(-1, dims)
            yield r, np.frombuffer(r.q_ids, np.int64), q, np.frombuffer(r.v_ids, np.int64), v


def _counter(dims: int, width: int, span: int, k: int):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, q_ids, q, v_ids, v in _blocks(frames, dims):
            low = np.frombuffer(r.low, np.int64)
            bins = np.zeros((len(q), BINS), np.int64)
            base = (np.arange(len(q)) * BINS)[:, None]
            for at in range(0, len(v), SLICE):
                scores = _scores(q, v[at : at + SLICE])
                above_low = scores - low[:, None]
                where = above_low // width
                ok = (above_low >= 0) & (above_low < span) & (q_ids[:, None] != v_ids[None, at : at + SLICE])
                bins += np.bincount((where + base)[ok], minlength=bins.size).reshape(bins.shape)
            # the global k-th score is no lower than this block's own, so lower bins are not needed
            above = bins[:, ::-1].cumsum(axis=1)[:, ::-1] - bins
            i, b = np.nonzero((bins > 0) & (above < k))
            yield pd.DataFrame({"query_id": q_ids[i], "bin": b.astype(np.int64), "n": bins[i, b]})

    return count


def _emitter(dims: int, k: int):
    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, q_ids, q, v_ids, v in _blocks(frames, dims):
            low = np.frombuffer(r.low, np.int64)
            ties = np.zeros(len(q), np.int64)
            for at in range(0, len(v), SLICE):
                ids = v_ids[at : at + SLICE]
                scores = _scores(q, v[at : at + SLICE])
                other = q_ids[:, None] != ids[None, :]
                tied = (scores == low[:, None]) & other
                order = tied.cumsum(axis=1) + ties[:, None]  # ids ascend, so the first k ties are the smallest
                i, j = np.nonzero((scores > low[:, None]) & other | tied & (order <= k))
                ties += tied.sum(axis=1)
                yield pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[j], "score": scores[i, j]})

    return emit


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products over all other rows.

    ``vectors``: ``vec_id, v`` as from ``quantised``; ``is_query`` selects the queries. Ties go to the
    smaller vec_id; fewer than ``k`` candidates give all of them. Queries in blocks meet the vectors
    in shards: block pairs are joined by number, both of bounded size, and results are
    combined from at most ``k`` bins or ties of each shard and query.
    """
    vectors = stored(vectors, "vectors")
    spark = vectors.sparkSession
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows, queries, dims, bound = vectors.agg(
        F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm2), F.lit(0.0))
    ).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not queries or rows < 2:
        return empty
    dims = max(1, dims)
    shards = max(-(-rows // SHARD_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-rows // 256)))
    blocks = -(-queries // QUERY_BLOCK)
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("long")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("long")
    packed = stored(
        vectors.withColumn("shard", shard)
        .groupBy("shard")
        .applyInPandas(_packer(dims, "shard"), "shard long, ids binary, m binary"),
        "shards",
    ).select("shard", F.col("ids").alias("v_ids"), F.col("m").alias("v_m"))
    asked = vectors.where(is_query).withColumn("block", block)

    def paired(low: DataFrame) -> DataFrame:
        """Every shard beside every block of queries with their lower ends."""
        q = (
            asked.join(low, asked["vec_id"] == low["query_id"])
            .select("block", "vec_id", "v", "low")
            .groupBy("block")
            .applyInPandas(_packer(dims, "block", ("low",)), "block long, ids binary, m binary, low binary")
            .select("block", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), "low")
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
        )
        v = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        return v.join(q, ["block", "shard"])

    limit = int(np.ceil(bound)) + 1
    span = 2 * limit + 1  # scores lie in [low, low + span)
    width = -(-span // BINS)
    low = asked.select(F.col("vec_id").alias("query_id"), F.lit(-limit).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    while True:
        counts = (
            paired(low)
            .mapInPandas(_counter(dims, width, span, k), "query_id long, bin long, n long")
            .groupBy("query_id", "bin")
            .agg(F.sum("n").alias("n"))
        )
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        reached = (
            counts.withColumn("upto", F.sum("n").over(down))
            .join(low, "query_id")
            .where(F.col("upto") >= F.col("need"))
            .groupBy("query_id")
            .agg(F.max(F.struct("bin", "n", "upto")).alias("top"))
            .select("query_id", "top.bin", (F.col("top.upto") - F.col("top.n")).alias("above"))
        )
        # a query with fewer than k candidates keeps its lower end: all of its scores pass
        low = stored(
            low.join(reached, "query_id", "left").select(
                "query_id",
                (F.col("low") + F.coalesce("bin", F.lit(0)) * F.lit(width)).alias("low"),
                (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"),
            ),
            "bounds",
        )
        if width == 1:
            break
        span, width = width, -(-width // BINS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        paired(low)
        .mapInPandas(_emitter(dims, k), "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
