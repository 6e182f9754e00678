"""Importance resampling towards a target distribution of hashed n-grams.

Separators are collapsed to single blanks, so that every run of n words is one span of the text: a regular expression with
boundary lookarounds, scanned with overlaps, gives the spans, and each span's CRC-32 its bucket. The buckets of a document
are written once. From them come the corpus counts, a small table of gains (the log ratio of target to corpus by bucket) and each
document's weight; Gumbel noise made from its id turns weights into a draw without replacement: the highest scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.llm.common import named, quoted, stored

MIN_N, MAX_N = 1, 1
BUCKETS = 10_000  # the table of gains, so many numbers, passes the driver
SEED = 2024
LEAST_WORDS = 20
DRAWN_PERCENT = 10
_UNSIGNED = 4294967296.0
_IN_PARTITION = 33  # bits of monotonically_increasing_id that count inside a partition

# Digits, letters in lower case and all bytes of other characters stay; the rest separates words.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def span_pattern(n: int) -> regex.Pattern:
    """Runs of ``n`` words; scanned with overlaps, one begins at each word that has enough successors."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def collapsed(text: bytes) -> bytes:
    """Words in lower case with one blank between two of them."""
    return b" ".join(text.translate(_NORMAL).split())


def text_buckets(text: bytes, patterns: list[regex.Pattern], buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every n-gram of the text, repeats included."""
    plain = collapsed(text)
    codes = [crc32(span.group()) for pattern in patterns for span in pattern.finditer(plain, overlapped=True)]
    return plain.count(b" ") + 1 if plain else 0, np.array(codes, np.uint32) % np.uint32(buckets)


def _feature_batches(min_n: int, max_n: int, buckets: int, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [span_pattern(n) for n in range(min_n, max_n + 1)]
        for batch in batches:
            texts, rows = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("row"))
            for at in range(0, batch.num_rows, 500):
                part = [text_buckets((t.as_py() or "").encode(), patterns, buckets) for t in texts.slice(at, 500)]
                offsets = np.concatenate([[0], np.cumsum([len(found) for _, found in part])])
                flat = np.concatenate([found for _, found in part]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                words = pa.array([n for n, _ in part], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.slice(at, 500), words, lists], names)

    return scan


def ngram_buckets(
    docs: DataFrame, text: str = "text", min_n: int = MIN_N, max_n: int = MAX_N, buckets: int = BUCKETS, keep_text: bool = False
) -> DataFrame:
    """``row`` (all columns, the text only on demand), ``n_words``, ``features``: the bucket of each n-gram, repeats included."""
    rest = [named(docs, c) for c in docs.columns if keep_text or c != text]
    inputs = docs.select(F.struct(*rest).alias("row"), named(docs, text).alias("text"))
    schema = T.StructType([
        inputs.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("features", T.ArrayType(T.IntegerType())),
    ])
    return inputs.mapInArrow(_feature_batches(min_n, max_n, buckets, schema.names), schema)


def bucket_counts(features: DataFrame) -> DataFrame:
    """``bucket, n``: how many features fall into each bucket; a task sends one row a bucket at most."""
    return features.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` for every bucket: thousandths of the log ratio of target to corpus, each with one added to all counts."""
    counts = (
        corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(corpus.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .na.fill(0, ["s", "t"])
    )
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    one, added = F.lit(1.0), F.lit(float(buckets))
    ratio = (F.col("t") + one) * (F.col("all_s") + added) / ((F.col("s") + one) * (F.col("all_t") + added))
    return counts.join(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def _weigh_batches(gains: np.ndarray, names: list[str]):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("features"))
            sums = np.concatenate([[0], np.cumsum(gains[lists.flatten().to_numpy()])])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            made = [pa.array(np.diff(ends)), pa.array(np.diff(sums[ends]))]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "n_words")]
            yield pa.RecordBatch.from_arrays([*kept, *made], names)

    return weigh


def gumbel_noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable that the id alone decides; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digits = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((digits + F.lit(0.5)) / F.lit(_UNSIGNED))))


def _ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """Number the rows by score, then id, from 1, as far as they are drawn.

    Rows are sorted over range partitions and written; the sizes of the partitions, as many rows as there are
    partitions, give each its offset. Rows that agree in score and id are spread by their place in the table.
    """
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("place")]
    places = stored(
        scored.withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()),
        "places",
    )
    part = F.shiftright("place", _IN_PARTITION)
    sizes = places.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("place").bitwiseAND((1 << _IN_PARTITION) - 1) + 1
    joined = places.join(F.broadcast(offsets), part == F.col("part"))
    return joined.withColumn("rank", F.when(rank <= drawn, rank)).drop("place", "part", "offset")


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", min_n: int = MIN_N, max_n: int = MAX_N,
    buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, keep_text: bool = False,
) -> DataFrame:
    """Every document: ``row`` (its columns, the text only on demand), ``n_words, n_features, weight, score, rank``.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn: the highest scores,
    ties to the smaller id (null first, in the order of its type), ranked from 1; the others have no rank. ``target`` has a column ``text`` too.
    Null and empty texts have no features and weight 0. Repeated rows are documents of their own and take neighbouring
    ranks. An empty corpus gives no rows; with an empty target all its counts are 0.
    """
    features = stored(ngram_buckets(docs, text, min_n, max_n, buckets, keep_text), "features")
    wanted = ngram_buckets(target.select(F.col(quoted(text)).alias("text")), "text", min_n, max_n, buckets)
    table = bucket_gains(bucket_counts(features), bucket_counts(wanted), buckets)
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in table.collect():
        gains[bucket] = gain
    schema = T.StructType([
        features.schema["row"], *[T.StructField(name, T.LongType()) for name in ("n_words", "n_features", "weight")],
    ])
    identity = F.col("row").getField(doc_id)
    weighed = features.mapInArrow(_weigh_batches(gains, schema.names), schema)
    scored = weighed.withColumn("score", F.col("weight") + gumbel_noise(identity, seed)).withColumn("id", identity)
    enough = F.col("n_words") >= least_words
    n_enough = features.where(enough).count()
    ranked = _ranked(scored.where(enough), n_enough * percent // 100)
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("id")
