"""Near copies of whole documents: wide SimHash fingerprints, compared by bit planes, and exact Jaccard similarity.

The pipeline's rule is five-word Jaccard similarity of 0.8 or more. Such texts differ in about 15 % of the bits of a SimHash over their
shingles, others in half of them; 64 bits cannot tell these apart, WIDE bits can. A key is a choice of the fingerprint's bits. There are as
many bits in a key as keep buckets at BUCKET members, and as many keys as bring a pair that differs in FLIPS of its bits
together EXPECTED times on average. In a bucket the first COMPARED bits are compared by ``simhash.near_lanes``; what is within RADIUS there is
compared by exact Jaccard similarity, and nothing is linked that this does not confirm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import row_of, sorted_runs, stored
from tripmart.llm.graph import components
from tripmart.llm.passage_dedup import SHINGLE, SIMILARITY, near_links, normal
from tripmart.llm.simhash import TILE, majority_bits, shingle_hashes, spanning_links

WIDE, COMPARED, RADIUS = 512, 128, 38  # bits
BUCKET = 512  # expected members; small buckets leave the planes of ``near_lanes`` mostly empty
FLIPS, EXPECTED = 0.16, 9.0
KEY_BITS = (4, 24)
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, WIDE // 64, dtype=np.uint64)
_WHOLE = "doc_id long, mark long, start int, end int, digest long, print binary"


def word_shingles(text: bytes) -> np.ndarray:
    """Hashes of all runs of five words, which blanks alone separate."""
    return np.array(shingle_hashes(normal(text), SHINGLE), np.uint64)


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WIDE bits, as words, for each set of shingle hashes (none empty): every word from another mix of the hashes."""
    flat, counts = np.concatenate(sets), np.array([len(s) for s in sets])
    prints = np.empty((len(sets), len(_SEEDS)), np.uint64)
    for i, seed in enumerate(_SEEDS):
        mixed = flat + seed
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        prints[:, i] = majority_bits(mixed ^ (mixed >> np.uint64(31)), counts)
    return prints


def key_plan(n: int) -> np.ndarray:
    """For ``n`` distinct texts: the positions of each key's bits, a row a key."""
    least, most = KEY_BITS
    bits = min(most, max(least, ceil(np.log2(max(n, 1) / BUCKET))))
    rng = np.random.default_rng(3)
    return np.array([rng.choice(WIDE, bits, replace=False) for _ in range(ceil(EXPECTED / (1 - FLIPS) ** bits))])


def _whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = [t or b"" for t in part.column(2).to_pylist()]
            pieces = [normal(t) for t in texts]
            sets = [np.unique(word_shingles(p)) for p in pieces]
            full = [s for s in sets if len(s)]
            prints = iter(wide_prints(full) if full else [])
            digests = [d - (1 << 64) if (d := xxhash.xxh3_64_intdigest(p)) >> 63 else d for p in pieces]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array([0] * len(texts), pa.int32()), pa.array(map(len, texts), pa.int32()),
                    pa.array(digests, pa.int64()), pa.array([next(prints).astype("<u8").tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "mark", "start", "end", "digest", "print"],
            )


def _words(prints: pa.Array) -> np.ndarray:
    """Prints as rows of words."""
    return np.frombuffer(b"".join(prints.to_pylist()), "<u8").reshape(len(prints), -1)


def _key_batches(plan: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``digest, print, band, value`` for every key of ``digest, print``; the print is cut to what is compared."""
    weights = 1 << np.arange(plan.shape[1])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words = _words(part.column(1))
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                values = np.stack([bits[:, places] @ weights for places in plan], axis=1)
                short = [row.tobytes() for row in words[:, : COMPARED // 64]]
                rows = pa.array(np.repeat(np.arange(len(words)), len(plan)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(rows), pa.array(short, pa.binary()).take(rows),
                        pa.array(np.tile(np.arange(len(plan), dtype=np.int32), len(words))), pa.array(values.ravel().astype(np.int32)),
                    ],
                    ["digest", "print", "band", "value"],
                )

    return make


def _lane_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in sorted_runs(batches, ["band", "value", "tile"]):
        if run.num_rows < 2:
            continue
        digests = run.column("digest").to_numpy()
        near, first = spanning_links(_words(run.column("print")), RADIUS)
        if len(near):
            heads = np.unique(first)
            members, roots = np.concatenate([near, heads]), np.concatenate([first, heads])
            bands = np.full(len(members), run.column("band")[0].as_py(), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests[members]), pa.array(bands), pa.array(digests[roots])], ["digest", "band", "value"]
            )


def near_lanes_of(distinct: DataFrame) -> DataFrame:
    """``digest, band, value``: texts with one band and value are connected by fingerprints within the radius.

    Buckets of more than TILE members are cut into tiles by hash, and each two tiles meet in a group of their own.
    """
    prints = distinct.where(F.col("print").isNotNull()).select("digest", "print")
    keyed = prints.mapInArrow(_key_batches(key_plan(prints.count())), "digest long, print binary, band int, value int")
    sizes = keyed.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    crowded = stored(sizes.select("band", "value", F.ceil(F.col("n") / F.lit(TILE)).cast("int").alias("tiles")), "crowded-keys")
    mine = F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int")
    other = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: x != F.col("mine"))
    )
    lanes = (
        keyed.join(crowded, ["band", "value"], "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(other))
        .withColumn("tile", F.least("mine", "other") * F.col("tiles") + F.greatest("mine", "other"))
        .select("band", "value", "tile", "digest", "print")
        .repartition("band", "value", "tile")
        .sortWithinPartitions("band", "value", "tile")
        .mapInArrow(_lane_batches, "digest long, band int, value long")
    )
    return stored(lanes.distinct(), "near-lanes")


def copy_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, mark, root`` for every row of ``doc_id, text``: rows with one ``root`` are connected by near copies.

    ``mark`` is the text's hash. Texts with the same words are equal, so null, empty and wordless texts are one group.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("bytes"))
    whole = stored(plain.mapInArrow(_whole_batches, _WHOLE), "whole-texts")
    distinct = stored(
        whole.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("doc_id", "mark", "start", "end", "print")]), "distinct-texts"
    )
    roots = components(near_links(distinct, plain, similarity, word_shingles, near_lanes_of(distinct)))
    return whole.join(roots, whole["digest"] == roots["node"], "left").select("doc_id", "mark", F.coalesce("root", "digest").alias("root"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id (ties: of text hashes); without an id only if all are."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    kept = copy_groups(docs, similarity).groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.mark")
    named = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"))
    same = named["id"].eqNullSafe(kept["doc_id"]) & (named["mark"] == kept["mark"])
    return named.join(kept, same, "left_semi").dropDuplicates(["id", "mark"]).select("row.*")
