"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within the radius agree on whole parts of the word: cut into ``radius + t`` parts, any
such pair agrees on at least ``t`` of them, so each choice of ``t`` parts is a bucket key. In a bucket the
fingerprints are stored as bit planes (plane j holds bit j of 64 fingerprints in each word). A
fingerprint is compared with all of them at once: the planes that differ are added into
carry-save counters, one bit of the count in each word, and a block of words is abandoned as soon as all its lanes
have passed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import quoted, sorted_runs, stored
from tripmart.llm.graph import components

RADIUS = 4
SHINGLE = 4
SEED = 42
BITS = 64
BUCKET = 256  # expected members of a bucket, which fixes the number of parts
TILE = 2048  # larger buckets are cut into tiles, compared two by two

_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of all runs of ``size`` words, A-Z lower-cased and joined by a blank; fewer words: of the whole sequence."""
    words = text.lower().split() if text else []
    if not words:
        return []
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(whole, seed)]
    starts = np.concatenate([[0], ends[:-size] + 1])
    return [digest(whole[s:e], seed) for s, e in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of ``counts`` hashes: the word whose bit is 1 where over half of the group has it.

    Each byte of a hash is spread to eight 8-bit counters; at most 255 words are added before
    the counters are widened.
    """
    result = np.zeros(len(counts), np.uint64)
    groups = np.flatnonzero(counts)
    if not len(groups):
        return result
    sizes = counts[groups].astype(np.int64)
    parts = -(-sizes // 255)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    cuts = np.repeat(begin - first * 255, parts) + np.arange(parts.sum()) * 255
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.empty((len(groups), BITS), np.int64)
    for j in range(8):
        sums = np.add.reduceat(_SPREAD[columns[:, j]], cuts)
        ones[:, 8 * j : 8 * j + 8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    bits = (ones * 2 > sizes[:, None]).astype(np.uint8)
    result[groups] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return result


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = batch.column(1), []
        for at in range(0, len(texts), 256):
            lists = [shingle_hashes(t.as_py()) for t in texts.slice(at, 256)]
            flat = np.fromiter((h for x in lists for h in x), np.uint64, sum(map(len, lists)))
            out.append(majority_bits(flat, np.array([len(x) for x in lists])))
        prints = np.concatenate(out) if out else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` (64 bits as a long) of ``doc_id, text``; null and wordless texts have print zero."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _fingerprint_batches, "doc_id long, print long"
    )


def part_plan(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """For ``n`` distinct fingerprints: the bucket keys, each a list of (first bit, width) of its parts."""
    t = 1
    while n / 2 ** (BITS * t // (radius + t)) > BUCKET and t < 8:
        t += 1
    edges = [BITS * i // (radius + t) for i in range(radius + t + 1)]
    parts = list(zip(edges, np.diff(edges).tolist(), strict=False))
    return [list(c) for c in combinations(parts, t)]


def near_lanes(prints: np.ndarray, radius: int = RADIUS, block: int = 16) -> np.ndarray:
    """Bit matrix (n x n bits, as bytes) of the pairs that differ in at most ``radius`` bits; a print is a word or a row of words."""
    n = len(prints)
    words = -(-n // 64)
    packed = np.ascontiguousarray(prints.astype("<u8")).view(np.uint8).reshape(n, -1)
    wide = 8 * packed.shape[1]
    bits = np.zeros((words * 64, wide), np.uint8)
    bits[:n] = np.unpackbits(packed, axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")  # a plane of `words` words for each bit
    flip = (np.uint64(0) - bits[:n].T.astype(np.uint64))  # all ones where the query's bit is 1
    width = max(1, radius.bit_length())
    near = np.zeros((n, words), np.uint64)
    for at in range(0, words, block):
        span = planes[:, at : at + block]
        live = np.arange(n)
        count = [np.zeros((n, span.shape[1]), np.uint64) for _ in range(width)]
        over = np.zeros((n, span.shape[1]), np.uint64)
        for j in range(wide):
            carry = span[j][None, :] ^ flip[j, live][:, None]
            for c in count:
                c ^= carry
                carry &= ~c
            over |= carry  # more than the counter holds
            if j % 8 == 7 and radius < j < wide - 1:
                past = over | _above(count, radius)
                over = past
                stay = ~(past == np.uint64(0xFFFFFFFFFFFFFFFF)).all(axis=1)
                if not stay.all():
                    live, over, count = live[stay], over[stay], [c[stay] for c in count]
                    if not len(live):
                        break
        if len(live):
            near[live, at : at + block] = ~(over | _above(count, radius))
    return near.view(np.uint8)


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, given bit by bit, is greater than ``radius``."""
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for i in reversed(range(len(count))):
        if radius >> i & 1:
            same &= count[i]
        else:
            more |= same & count[i]
            same &= ~count[i]
    return more


def spanning_links(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that is linked to others here, with the first of its group: no pair list is made."""
    n = len(prints)
    near = near_lanes(prints, radius)
    root, left = np.full(n, -1), np.ones(n, bool)
    alone = np.unpackbits(near, axis=1, bitorder="little")[:, :n].sum(axis=1) <= 1 if n <= 4 * TILE else np.zeros(n, bool)
    left[alone] = False
    while left.any():
        first = int(left.argmax())
        front = np.array([first])
        while len(front):
            root[front], left[front] = first, False
            reached = np.unpackbits(np.bitwise_or.reduce(near[front], axis=0), bitorder="little")[:n].astype(bool)
            front = np.flatnonzero(reached & left)
    linked = np.flatnonzero((root >= 0) & (root != np.arange(n)))
    return linked, root[linked]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in sorted_runs(batches, ["part", "value", "tile"]):
        if run.num_rows < 2:
            continue
        prints = run.column("print").to_numpy().view(np.uint64)
        a, b = spanning_links(prints)
        if len(a):
            values = prints.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values[a]), pa.array(values[b])], ["a", "b"])


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``print`` values within the radius, directly or by other links.

    Buckets of more than TILE members are cut into tiles by hash, and each two tiles meet in a group of their
    own, so a bucket of any size is spread over tasks.
    """
    plan = part_plan(prints.count(), radius)
    bits = lambda first, width: F.shiftrightunsigned("print", first).bitwiseAND(F.lit((1 << width) - 1))
    keys = []
    for i, parts in enumerate(plan):
        value, used = F.lit(0).cast("long"), 0
        for first, width in parts:
            value, used = value.bitwiseOR(F.shiftleft(bits(first, width), used)), used + width
        keys.append(F.struct(F.lit(i).alias("part"), value.alias("value")))
    spread = prints.select("print", F.explode(F.array(*keys)).alias("k")).select("print", "k.part", "k.value")
    sizes = spread.groupBy("part", "value").agg(F.count("*").alias("n")).where("n > 1")
    tiles = sizes.select("part", "value", F.ceil(F.col("n") / F.lit(TILE)).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")
    other = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: x != F.col("mine"))
    )
    pairs = (
        spread.join(tiles, ["part", "value"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(other))
        .select(
            "part", "value", "print",
            (F.least("mine", "other") * F.col("tiles") + F.greatest("mine", "other")).cast("int").alias("tile"),
        )
    )
    return (
        pairs.repartition("part", "value", "tile")
        .sortWithinPartitions("part", "value", "tile")
        .mapInArrow(_link_batches, "a long, b long")
    )


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, print, component_id`` for every row of ``doc_id, text``.

    ``component_id`` is the smallest doc_id reachable over links, itself included (null only if all
    ids of a group are null). Equal fingerprints are collapsed before any comparison; repeated rows stay in the result;
    null and empty texts share print zero and so form a group. Empty tables give no rows.
    """
    prints = stored(fingerprints(docs), "prints")
    distinct = stored(prints.groupBy("print").agg(F.min("doc_id").alias("low")), "distinct-prints")
    roots = components(near_links(distinct.select("print"), radius))
    grouped = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "low", F.coalesce("root", "print").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = stored(grouped.join(least, "root").select("print", "component_id"), "print-groups")
    return prints.join(of_print, "print").select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of each group; rows that repeat an id within a group count once.

    Documents without an id cannot be told apart in a group and stay.
    """
    groups = simhash_groups(docs, radius)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*[quoted(c) for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))


def bits_per_key(n: int, radius: int = RADIUS) -> int:
    """Width of the bucket keys that ``part_plan`` picks; for reports."""
    return sum(w for _, w in part_plan(n, radius)[0]) or ceil(BITS / (radius + 1))
