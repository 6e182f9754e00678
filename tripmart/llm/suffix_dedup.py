"""Removal of repeated byte strings by suffix arrays built in two stages.

**Which text must be sorted together.** Any string of MIN_LENGTH bytes has a smallest gram hash, and equal strings
have the same one. Each document is cut into segments: maximal runs of string starts with the same smallest hash. Two
equal strings therefore lie in segments of the same key, wherever they occur, and only keys that
occur more than once (or repeat inside one segment) go on. Equal segments are collapsed and counted first.

**Suffix arrays.** Segments of the same key, packed into blocks of bounded size, are sorted in two stages:
only suffixes smaller than their successors are sorted directly, by the first MIN_LENGTH bytes; the rest follow by one scan
over the buckets of first bytes, each bucket's entries placing their predecessors. Adjacent common prefixes
of MIN_LENGTH bytes mark the repeated strings.

A key with more than HOT_SEGMENTS different segments (a short line that a third of the documents share) is not
sorted in one task: its segments are cut again by longer grams, up to grams as long as the strings themselves, where
segments of one key are equal and collapse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.llm.common import named, sorted_runs, stored

MIN_LENGTH = 200
GRAMS = (32, 104, 168, 200)  # bytes; multiples of 8, the last as long as the strings
HOT_SEGMENTS = 2000
BLOCK_BYTES = 2_000_000
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]
_FULL = 1 << 40


# Segments ---------------------------------------------------------------------------------------


def gram_hashes(text: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each position."""
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    n = len(text) - gram + 1
    h = np.zeros(n, np.uint64)
    for i in range(gram // 8):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[-1]) + words[8 * i : 8 * i + n] * np.uint64(_MIX[i % 4])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x, size = op(x[:-size], x[size:]), size * 2
    return x if size == width else op(x[: len(x) - (width - size)], x[width - size :])


def segments(text: bytes, length: int = MIN_LENGTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``key, lo, hi, again``: strings that start at lo..hi share their smallest hash ``key``.

    ``again``: the smallest gram stands in the segment more than once, so the segment may repeat itself.
    """
    if len(text) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    h, width = gram_hashes(text, gram), length - gram + 1
    low = _sliding(np.minimum, h, width)
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(low) - 1]])
    key = low[lo]
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == _sliding(np.maximum, np.concatenate([edge, low, edge]), width))
    names = np.unique(key)
    spots = np.searchsorted(names, h[at]) * _FULL + at
    spots.sort()
    base = np.searchsorted(names, key) * _FULL
    times = np.searchsorted(spots, base + hi + width - 1, "right") - np.searchsorted(spots, base + lo)
    return key, lo, hi, times > 1


def _segment_batches(length: int, gram: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py() or b""
                key, lo, hi, again = segments(text, length, gram)
                digest = [
                    xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)
                ]
                rows.append((np.full(len(lo), i), key, np.array(digest, np.uint64), lo, hi, again))
            if rows:
                i, key, digest, lo, hi, again = (np.concatenate(x) for x in zip(*rows, strict=True))
                whole = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(key.view(np.int64)),
                        pa.array(digest.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(again),
                    ],
                    ["id", "mark", "key", "digest", "lo", "hi", "again"],
                )
                for at in range(0, whole.num_rows, 100_000):
                    yield whole.slice(at, 100_000)

    return cut


# Suffix arrays ----------------------------------------------------------------------------------


def _words_at(text: bytes) -> np.ndarray:
    """The 8 bytes at each position as a big-endian number; ``text`` is padded with at least 8 zeros."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))


def _sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` bytes, eight at a time; only ties go on."""
    key = words[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    for d in range(8, depth, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        index = np.flatnonzero(tied)
        if not len(index):
            break
        group = np.cumsum(~same[index])
        key = words[np.minimum(at[index] + d, len(words) - 1)].astype(np.uint64)
        order = np.lexsort((key, group))
        at[index], key = at[index][order], key[order]
        same[index[1:]] &= (key[1:] == key[:-1])
    return at


def suffix_array(text: bytes, depth: int = MIN_LENGTH) -> np.ndarray:
    """Suffixes of ``text`` sorted by at least their first ``depth`` bytes, in two stages."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    t = np.frombuffer(text, np.uint8)
    step = np.flatnonzero(t[1:] != t[:-1])  # a suffix equals its neighbour's byte up to the next step
    rising = np.zeros(n, bool)
    if len(step):
        upto = np.searchsorted(step, np.arange(step[-1] + 1))
        rising[: step[-1] + 1] = (t[step + 1] > t[step])[upto]
    direct = _sort_directly(_words_at(text + bytes(depth + 16)), np.flatnonzero(rising), depth)
    first = np.searchsorted(t[direct], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    queue[t[-1]].append(np.array([n - 1]))  # its successor is the empty suffix, the least of all
    result = []
    for c in range(256):
        induced = queue[c]
        wave = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        whole = [wave]
        while len(wave):  # predecessors with the same byte join the end of this bucket
            before = wave[wave > 0] - 1
            wave = before[t[before] == c]
            whole.append(wave)
        whole.append(direct[first[c] : first[c + 1]])
        bucket = np.concatenate(whole)
        if not len(bucket):
            continue
        result.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = t[before]
        larger = byte > c
        before, byte = before[larger], byte[larger]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        ends = np.flatnonzero(np.concatenate([byte[1:] != byte[:-1], [True]])) + 1 if len(byte) else []
        start = 0
        for end in ends:
            queue[byte[start]].append(before[start:end])
            start = end
    return np.concatenate(result)


def repeated_starts(parts: list[bytes], length: int = MIN_LENGTH) -> np.ndarray:
    """Sorted positions in the concatenated ``parts`` where a string of ``length`` bytes, inside one part, begins
    that also begins somewhere else in them."""
    text = b"".join(parts)
    ends = np.cumsum([len(p) for p in parts])
    sa = suffix_array(text, length)
    fits = np.zeros(len(text), bool)
    for end, part in zip(ends, parts, strict=True):
        fits[end - len(part) : max(end - length + 1, end - len(part))] = True
    sa = sa[fits[sa]]
    words = _words_at(text + bytes(8))
    pair = np.arange(max(len(sa) - 1, 0))
    for d in [*range(0, length - 7, 8), length - 8]:  # adjacent common prefixes, up to the length
        pair = pair[words[sa[pair] + d] == words[sa[pair + 1] + d]]
    return np.unique(np.concatenate([sa[pair], sa[pair + 1]]))


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]


def _sort_block(keys, digests, parts, length) -> pa.RecordBatch | None:
    starts = repeated_starts(parts, length)
    if not len(starts):
        return None
    ends = np.cumsum([len(p) for p in parts])
    part = np.searchsorted(ends, starts, "right")
    inside = starts - np.concatenate([[0], ends[:-1]])[part]
    a, b = _runs(part * _FULL + inside)
    part, lo, hi = a // _FULL, a % _FULL, b % _FULL
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(keys)[part]), pa.array(np.asarray(digests)[part]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
        ["key", "digest", "from", "to"],
    )


def _sorter(length: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole keys are packed until a block is full."""
        keys, digests, parts, size = [], [], [], 0
        for run in sorted_runs(batches, ["key"]):
            keys += run.column("key").to_pylist()
            digests += run.column("digest").to_pylist()
            parts += (new := run.column("bytes").to_pylist())
            size += sum(map(len, new))
            if size >= BLOCK_BYTES:
                if (found := _sort_block(keys, digests, parts, length)) is not None:
                    yield found
                keys, digests, parts, size = [], [], [], 0
        if parts and (found := _sort_block(keys, digests, parts, length)) is not None:
            yield found

    return sort


# Jobs -------------------------------------------------------------------------------------------


def _slice_batches(length: int):
    """The bytes of the segments that a document stands for; documents without any are passed over."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, texts = batch.column(batch.schema.get_field_index("wanted")), batch.column(batch.schema.get_field_index("bytes"))
            rows = []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                for w in wanted[i].as_py():
                    rows.append({"key": w["key"], "digest": w["digest"], "hot": w["hot"], "bytes": text[w["lo"] : w["hi"] + length]})
            if rows:
                yield pa.RecordBatch.from_pylist(
                    rows, pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("hot", pa.bool_()), ("bytes", pa.binary())])
                )

    return take


def repeated_ranges(
    keyed: DataFrame, length: int = MIN_LENGTH, hot_segments: int = HOT_SEGMENTS, grams: tuple[int, ...] = GRAMS
) -> DataFrame:
    """``id, mark, ranges``: for each document the ranges (from, to) of positions at which repeated strings begin.

    ``keyed``: ``id, mark, bytes`` and any more columns; id and mark name a document's text. Keys that are too
    crowded at the first of ``grams`` are solved by the next, their segments taken as documents.
    """
    gram, *longer = (g for g in grams if g <= length)
    found = stored(
        keyed.select("id", "mark", "bytes").mapInArrow(
            _segment_batches(length, gram), "id string, mark long, key long, digest long, lo int, hi int, again boolean"
        ),
        "segments",
    )
    keys = (
        found.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("digest").alias("d1"), F.max("digest").alias("d2"), F.max("again").alias("a"))
        .where("n > 1 OR a")
        .select("key", (F.col("d1") != F.col("d2")).alias("various"))
    )
    shared = stored(found.join(stored(keys, "keys"), "key"), "shared-segments")
    distinct = shared.groupBy("key", "digest").agg(
        F.count("*").alias("n"), F.max("again").alias("again"), F.max("various").alias("various"),
        *[F.first(c).alias(c) for c in ("id", "mark", "lo", "hi")],
    )
    distinct = stored(distinct, "distinct-segments")
    to_sort = distinct.where("various OR again")
    crowded = to_sort.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > hot_segments)
    crowded = stored(crowded.select("key", F.lit(True).alias("hot")), "crowded-keys")
    wanted = (
        to_sort.join(crowded, "key", "left")
        .groupBy("id", "mark")
        .agg(F.collect_list(F.struct("key", "digest", F.coalesce("hot", F.lit(False)).alias("hot"), "lo", "hi")).alias("wanted"))
    )
    # repeated rows share a name, and any one of them gives the bytes
    pieces = stored(
        keyed.join(wanted, ["id", "mark"])
        .mapInArrow(_slice_batches(length), "key long, digest long, hot boolean, bytes binary")
        .dropDuplicates(["key", "digest"]),
        "pieces",
    )
    sorted_ranges = (
        (pieces.where("NOT hot") if longer else pieces).select("key", "digest", "bytes")
        .repartition("key").sortWithinPartitions("key")
        .mapInArrow(_sorter(length), "key long, digest long, from int, to int")
    )
    copies = distinct.where("n > 1").select("key", "digest", F.lit(0).alias("from"), (F.col("hi") - F.col("lo")).alias("to"))
    ranges = copies.unionByName(sorted_ranges)
    if longer and not crowded.isEmpty():
        hot = pieces.where("hot").select(F.col("key").cast("string").alias("id"), F.col("digest").alias("mark"), "bytes")
        inner = repeated_ranges(hot, length, hot_segments, tuple(longer))
        ranges = ranges.unionByName(
            inner.select(F.col("id").cast("long").alias("key"), F.col("mark").alias("digest"), F.inline("ranges")).toDF(
                "key", "digest", "from", "to"
            )
        )
    ranges = stored(ranges, "ranges")
    return (
        shared.select("id", "mark", "key", "digest", "lo")
        .join(ranges, ["key", "digest"])
        .groupBy("id", "mark")
        .agg(F.collect_set(F.struct((F.col("lo") + F.col("from")).alias("a"), (F.col("lo") + F.col("to")).alias("b"))).alias("ranges"))
    )


def removed_spans(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal spans of bytes that the strings beginning in ``ranges`` cover."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"] + length) for r in ranges or ()):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _cut_batches(length: int, with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.schema.get_field_index
            out = []
            for text, ranges in zip(batch.column(index("bytes")), batch.column(index("ranges")), strict=True):
                text = text.as_py() or b""
                spans = removed_spans(ranges.as_py(), length)
                kept = _kept(text, spans)
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array(x, t) for x, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(index("row")), *made], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def cut_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = MIN_LENGTH,
    with_text: bool = True, hot_segments: int = HOT_SEGMENTS,
) -> DataFrame:
    """Every document with what remains when bytes in repeated strings of ``length`` bytes go.

    Returns ``row`` (the document's other columns), ``n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``: the remaining
    bytes as text, null unless ``with_text``; a character of which only a part remains is left out of ``kept``. All occurrences go, the
    first too; matches never cross documents; repeated rows are occurrences of each other. Null texts are empty.
    """
    body = named(docs, text)
    rest: list[Column] = [named(docs, c) for c in docs.columns if c != text]
    keyed = docs.select(
        F.coalesce(named(docs, doc_id).cast("string"), F.lit("")).alias("id"), F.xxhash64(body).alias("mark"),
        F.struct(*rest).alias("row"), body.cast("binary").alias("bytes"),
    )
    ranges = repeated_ranges(keyed, length, hot_segments)
    counts = [T.StructField(name, T.LongType()) for name in ("n_bytes", "n_removed", "n_spans")]
    texts = [T.StructField(name, T.StringType()) for name in ("kept_sha256", "kept")]
    schema = T.StructType([keyed.schema["row"], *counts, *texts])
    return keyed.join(ranges, ["id", "mark"], "left").mapInArrow(_cut_batches(length, with_text), schema)
