"""Substring dedup by paragraph MinHash banding.

Units are paragraphs (lines) of at least MIN_WORDS words, inside paragraphs of several sentences, sentences of as many
words, and windows of MIN_WORDS words over the whole text, which begin where their words say and so cover short lines, too. Equal units are collapsed by a digest. Paragraphs get BANDS x ROWS MinHash values of their word shingles: a pair at
the wanted similarity shares a band with probability 1 - (1 - 0.8^ROWS)^BANDS, about 0.9998. Paragraphs
that collide are compared by exact Jaccard similarity, and classes are connected components. Sentences and windows take part by
equality, which finds passages that stand in different surroundings: any 25 equal words in a row share a window. Two passages of
51 words or more at the wanted similarity that differ by changed words have such a run, so windows need no bands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import named, sorted_runs, stored
from tripmart.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
MIN_WORDS = 14
TILE = 512
SMALL_RUN = 500_000  # shingles of a run that are compared as sets; more stay arrays, a tenth of the memory
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 12  # of so many successive starts one begins a window
LONG_WORD = 128  # bytes; longer runs without blanks are cut into pieces that count as words
FEW_WORDS = 1000  # fewer are hashed one by one
PART = 1 << 20  # bytes of texts that a task looks at together
_BLANK = np.array([bytes([b]).isspace() for b in range(256)])
_STOP = np.array([b in b".!?" for b in range(256)])
_BASE = 0x9E3779B97F4A7C15  # of the digests' polynomials, odd
_PLACES = np.random.default_rng(7).integers(1, 1 << 63, MIN_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 7)], np.uint64)


def found_units(raw: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte positions of each unit and whether it is a paragraph; ``whole`` are the places where words begin."""
    last = np.append(np.flatnonzero(raw == 10), len(raw))
    first = np.append(0, last[:-1] + 1)
    before = np.searchsorted(whole, np.append(first, len(raw)))
    long = np.diff(before) >= MIN_WORDS
    first, last = first[long], last[long]
    # sentences end before blanks and tabs that follow a stop
    blank = (raw == 32) | (raw == 9)
    stops = np.flatnonzero(blank[1:] & _STOP[raw[:-1]]) + 1
    line = np.searchsorted(last, stops)
    stops = stops[(line < len(last)) & (np.append(first, len(raw))[line] <= stops)]
    past = np.append(np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, len(raw))
    begin = np.sort(np.concatenate([first, past[np.searchsorted(past, stops)]]))
    end = np.sort(np.concatenate([stops, last]))
    line = np.searchsorted(last, end)
    some = begin < end
    many = np.bincount(line[some], minlength=len(last)) > 1
    some &= many[line]
    begin, end = begin[some], end[some]
    some = np.searchsorted(whole, end) - np.searchsorted(whole, begin) >= MIN_WORDS
    paragraph = np.arange(len(first) + int(some.sum())) < len(first)
    return np.concatenate([first, begin[some]]), np.concatenate([last, end[some]]), paragraph


def units(text: bytes) -> list[tuple[int, int, bool]]:
    """``start, end`` (bytes) of each unit and whether it is a paragraph."""
    _, _, _, whole = _hashed(text)
    return list(zip(*(c.tolist() for c in found_units(np.frombuffer(text, np.uint8), whole)), strict=True))


def _cut_word(word: bytes) -> list[int]:
    """Where pieces of a long word begin: at a quarter of its characters, chosen by the six bytes that follow."""
    raw = np.frombuffer(word, np.uint8)
    near = np.lib.stride_tricks.sliding_window_view(raw.astype(np.uint64), len(_GRAM)) @ _GRAM
    near = (near ^ (near >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    cuts = (near >> np.uint64(62) == 0) & ((raw[: len(near)] & 0xC0) != 0x80)
    return [0, *(np.flatnonzero(cuts[1:]) + 1).tolist()]


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and last byte positions (the last one exclusive) of the words, A-Z lower-cased; where words begin before long ones are cut.

    Each different word is hashed once, unless there are few.
    """
    text = text.lower()
    raw = np.frombuffer(text, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _BLANK[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    whole, places = starts, np.concatenate([[0], np.cumsum(ends - starts)])
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        cuts = [np.array(_cut_word(raw[starts[i] : ends[i]].tobytes())[1:], np.int64) for i in long]
        at = np.repeat(long, [len(c) for c in cuts])
        cuts = np.concatenate(cuts)
        starts, ends = np.sort(np.append(starts, starts[at] + cuts)), np.sort(np.append(ends, starts[at] + cuts))
        places = np.sort(np.append(places, places[at] + cuts))
    if len(starts) < FEW_WORDS:
        pieces = (text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        return np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(starts)), starts, ends, whole
    letters = pa.py_buffer(raw[~blank[1:-1]])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), letters]).dictionary_encode()
    _, stops, letters = words.dictionary.buffers()
    stops, letters = np.frombuffer(stops, np.int64)[: len(words.dictionary) + 1].tolist(), letters.to_pybytes() if letters else b""
    different = np.fromiter((xxhash.xxh3_64_intdigest(letters[a:b]) for a, b in pairwise(stops)), np.uint64, len(words.dictionary))
    return different[words.indices.to_numpy()], starts, ends, whole


def hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and last byte positions of the words."""
    return _hashed(text)[:3]


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words; fewer words are one run."""
    size = min(SHINGLE, len(hashes))
    n = len(hashes) - size + 1 if size else 0
    value = sum(hashes[i : i + n] * f for i, f in enumerate(_PLACES[:size])) if n else np.zeros(0, np.uint64)
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return value ^ (value >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


def sequence_digests(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A digest of the words first..last-1 for each pair (none empty): a polynomial, from the sums of all words before its ends."""
    sums = np.append(np.uint64(0), np.cumsum(hashes * _powers(_BASE, len(hashes)), dtype=np.uint64))
    value = (sums[last] - sums[first]) * _powers(pow(_BASE, -1, 1 << 64), len(hashes))[first] + (last - first).astype(np.uint64)
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return value ^ (value >> np.uint64(33))


def _least(rank: np.ndarray, size: int) -> np.ndarray:
    """Where the least of each ``size`` successive values is, the first of equal ones."""
    value, place, width = rank, np.arange(len(rank)), 1
    while width < size:
        step = min(width, size - width)
        left, right = value[: len(value) - step], value[step:]
        later = right < left
        value, place = np.where(later, right, left), np.where(later, place[step:], place[: len(place) - step])
        width += step
    return place


def placed_windows(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word, number of words and digest of each window of texts that begin at the words ``first`` and have ``count`` words.

    Windows are runs of MIN_WORDS words that begin at places their own words choose: of any STEP successive starts the one with the
    least hash begins a window, so two texts that share MIN_WORDS + STEP - 1 words in
    a row share a window wherever lines and sentences end. The first and the last words begin and end one: every word lies in
    a window. A text of fewer words is one window. Digests are polynomials of the words' hashes, all taken at once.
    """
    first, count = first[count > 0], count[count > 0]
    size = np.minimum(count, MIN_WORDS)
    chosen = np.zeros(len(hashes), bool)
    chosen[first] = chosen[first + count - size] = True
    n = len(hashes) - len(_GRAM) + 1
    if (count >= MIN_WORDS + STEP).any():
        rank = sum(hashes[i : i + n] * f for i, f in enumerate(_GRAM))
        rank = (rank ^ (rank >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        least = _least(rank, STEP)
        rest = np.repeat(np.where(count >= MIN_WORDS + STEP, first + count, 0), count)[: len(least)] - np.arange(len(least))
        chosen[least[rest >= MIN_WORDS + STEP - 1]] = True
    begins = np.flatnonzero(chosen)
    size = size[np.searchsorted(first, begins, "right") - 1]
    short, value = size < MIN_WORDS, np.zeros(len(begins), np.uint64)
    for i, factor in enumerate(_PLACES):
        value += np.where(i < size, hashes[np.minimum(begins + i, len(hashes) - 1)] * factor, np.uint64(0)) if short.any() else hashes[begins + i] * factor
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return begins, size, value ^ (value >> np.uint64(33))


def window_digests(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte positions and digests of the windows of one text."""
    hashes, starts, ends = hashed_words(text)
    begins, size, digest = placed_windows(hashes, np.array([0]), np.array([len(hashes)]))
    return starts[begins], ends[begins + size - 1], digest


def normal(unit: bytes) -> bytes:
    return b" ".join(unit.lower().split())


def windows(text: bytes) -> list[tuple[int, int, bytes]]:
    """``start, end`` (bytes) and text of each window."""
    start, end, _ = window_digests(text)
    return [(a, b, normal(text[a:b])) for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def band_values(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS 32-bit values for each set of hashes (none empty)."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros((len(sets), BANDS), np.uint64)
    product = np.empty_like(flat)
    for j, factor in enumerate(_FACTORS):
        low = np.minimum.reduceat(np.multiply(flat, factor, out=product), first)
        band = out[:, j // ROWS]
        band ^= low + np.uint64(0x9E3779B97F4A7C15) + (band << np.uint64(6)) + (band >> np.uint64(2))
        band *= np.uint64(0xFF51AFD7ED558CCD)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


_UNITS = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.int64()),
     ("window", pa.bool_()), ("bands", pa.list_(pa.int32()))]
)


def _unit_batch(part: pa.RecordBatch, at: np.ndarray, start, end, digest: np.ndarray, window: bool, bands: pa.Array) -> pa.RecordBatch:
    """Units of the documents at ``at`` in ``part``."""
    rows = pa.array(at)
    columns = [
        part.column(0).take(rows), part.column(1).take(rows), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
        pa.array(digest.view(np.int64)), pa.array(np.full(len(at), window)), bands,
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_UNITS)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in turn, about PART bytes of texts together or one text that is longer."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        texts = [text or b"" for text in part.column(2).to_pylist()]
        offset = np.cumsum([0, *(len(text) + 1 for text in texts)])
        joined = b"\n".join(texts)
        hashes, starts, ends, whole = _hashed(joined)
        if not len(hashes):
            continue
        word = np.searchsorted(starts, offset)
        begins, size, digest = placed_windows(hashes, word[:-1], np.diff(word))
        where = np.searchsorted(word, begins, "right") - 1
        none = pa.ListArray.from_arrays(pa.array(np.zeros(len(where) + 1, np.int32)), pa.array([], pa.int32()))
        yield _unit_batch(part, where, starts[begins] - offset[where], ends[begins + size - 1] - offset[where], digest, True, none)
        start, end, paragraph = found_units(np.frombuffer(joined, np.uint8), whole)
        if not len(start):
            continue
        where = np.searchsorted(offset, start, "right") - 1
        first, last = np.searchsorted(starts, start), np.searchsorted(ends, end, "right")
        runs = shingles(hashes)
        bands = band_values([runs[a:b] for a, b in zip(first[paragraph].tolist(), (last[paragraph] - SHINGLE + 1).tolist(), strict=True)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(BANDS * paragraph)), pa.int32()), pa.array(bands.ravel()))
        yield _unit_batch(part, where, start - offset[where], end - offset[where], sequence_digests(hashes, first, last), False, lists)


def find_units(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, start, end, digest, window, bands`` of every unit of ``doc_id, mark, bytes``; only lines have bands."""
    return docs.mapInArrow(_unit_batches, "doc_id long, mark long, start int, end int, digest long, window boolean, bands array<int>")


def connect(keys: list[int], sets: list[frozenset] | list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what is similar, directly or in steps; what is connected is not compared again."""
    groups: list[list[int]] = []
    links = []
    for i, mine in enumerate(sets):
        joined = [i]
        rest = []
        for group in groups:
            hit = next((j for j in group if _similar(mine, sets[j], similarity)), None)
            if hit is None:
                rest.append(group)
            else:
                links.append((keys[i], keys[hit]))
                joined += group
        groups = [*rest, joined]
    return links


def _similar(a: frozenset | np.ndarray, b: frozenset | np.ndarray, similarity: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    both = len(a & b) if isinstance(a, frozenset) else len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _compare(similarity: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["band", "value", "tile"]):
            if run.num_rows > 1:
                sets = [np.frombuffer(s, np.int64) for s in run.column("shingles").to_pylist()]
                if sum(map(len, sets)) <= SMALL_RUN:
                    sets = [frozenset(s.tolist()) for s in sets]
                if links := connect(run.column("digest").to_pylist(), sets, similarity):
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare


def unit_shingles(unit: bytes) -> np.ndarray:
    return shingles(hashed_words(unit)[0])


def _shingle_batches(shingles_of: Callable[[bytes], np.ndarray]):
    schema = pa.schema([("digest", pa.int64()), ("shingles", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.schema.get_field_index
            rows = []
            for text, wanted in zip(batch.column(index("bytes")), batch.column(index("wanted")), strict=True):
                text = text.as_py()
                for w in wanted.as_py():
                    rows.append((w["digest"], np.unique(shingles_of(text[w["start"] : w["end"]])).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return make


def near_links(
    distinct: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, shingles_of: Callable[[bytes], np.ndarray] = unit_shingles,
    entries: DataFrame | None = None,
) -> DataFrame:
    """Links ``a, b`` between digests of different paragraphs, enough to connect all that are similar.

    What is compared stands together in a bucket of ``entries`` (``digest, band, value``); without them the ``bands`` are the buckets.
    Buckets with the same members count once. Buckets of more than TILE members are cut into tiles by hash, and each two tiles are
    compared in a group of their own. Shingles are made again only for paragraphs that collide.
    """
    if entries is None:
        entries = distinct.select("digest", F.posexplode("bands").alias("band", "value"))
    buckets = (
        entries.groupBy("band", "value")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("members"), F.min("digest").alias("low"))
        .where("n > 1")
        .groupBy("n", "members", "low")
        .agg(F.min(F.struct("band", "value")).alias("b"))
        .select("b.band", "b.value", F.ceil(F.col("n") / F.lit(TILE)).cast("int").alias("tiles"))
    )
    # buckets grow with the corpus: shuffled at every size, never broadcast
    members = stored(entries.join(stored(buckets, "buckets").hint("merge"), ["band", "value"]), "bucket-members")
    wanted = (
        members.select("digest").distinct()
        .join(distinct.select("digest", "doc_id", "mark", "start", "end"), "digest")
        .groupBy("doc_id", "mark")
        .agg(F.collect_list(F.struct("digest", "start", "end")).alias("wanted"))
    )
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["mark"] == wanted["mark"])
    sets = stored(
        docs.join(wanted, same).select(docs["bytes"], "wanted")
        .mapInArrow(_shingle_batches(shingles_of), "digest long, shingles binary")
        .dropDuplicates(["digest"]),
        "shingle-sets",
    )
    mine = F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int")
    other = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: x != F.col("mine"))
    )
    return (
        members.withColumn("mine", mine)
        .withColumn("other", F.explode(other))
        .withColumn("tile", F.least("mine", "other") * F.col("tiles") + F.greatest("mine", "other"))
        .join(sets, "digest")
        .select("band", "value", "tile", "digest", "shingles")
        .repartition("band", "value", "tile")
        .sortWithinPartitions("band", "value", "tile")
        .mapInArrow(_compare(similarity), "a long, b long")
    )


def repeated_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, mark, start, end, window, root, class_size, class_doc, keep``: every unit that has an equal or near-equal elsewhere.

    ``start, end`` are byte positions in the UTF-8 text; ``root`` names the class, ``class_doc`` is the smallest doc_id in it, and ``keep``
    marks its first unit (smallest doc_id, then start; equal rows are all first). ``mark`` is the text's hash. Null and empty texts have no
    units; repeated rows repeat each other's units. Ids that are null come first.
    """
    body = named(docs, text)
    plain = docs.select(named(docs, doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"), body.cast("binary").alias("bytes"))
    found = stored(find_units(plain), "units")
    lines = found.where(F.size("bands") > 0)
    distinct = stored(
        lines.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("doc_id", "mark", "start", "end", "bands")]), "distinct-units"
    )
    roots = stored(components(near_links(distinct, plain, similarity)), "unit-roots")
    # what stands once and is like nothing else goes before the wide joins: most windows do
    twice = found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    linked = roots.select(F.explode(F.array("node", "root")).alias("digest"))
    again = stored(twice.union(linked).distinct(), "repeated-digests")
    rooted = found.drop("bands").join(again, "digest").join(roots, F.col("digest") == roots["node"], "left").select(
        "doc_id", "mark", "start", "end", "window", F.coalesce("root", "digest").alias("root")
    )
    rooted = stored(rooted, "rooted-units")
    classes = rooted.groupBy("root").agg(
        F.count("*").alias("class_size"), F.min("doc_id").alias("class_doc"), F.min(F.struct("doc_id", "start")).alias("first")
    )
    shared = stored(classes.where("class_size > 1"), "classes")
    keep = F.struct("doc_id", "start").eqNullSafe(F.col("first"))
    return rooted.join(shared, "root").select(
        "doc_id", "mark", "start", "end", "window", "root", "class_size", "class_doc", keep.alias("keep")
    )


def passages(start: np.ndarray, end: np.ndarray, window: np.ndarray) -> int:
    """How many lines and sentences there are, and runs of overlapping windows that touch none of them; sorted by ``start``."""
    lines, reach = start[~window], np.maximum.accumulate(end[~window])
    start, end = start[window], end[window]
    if len(lines):
        before = np.searchsorted(lines, end, "left")
        apart = (before == 0) | (reach[np.maximum(before - 1, 0)] <= start)
        start, end = start[apart], end[apart]
    runs = 1 + int((start[1:] > np.maximum.accumulate(end)[:-1]).sum()) if len(start) else 0
    return len(lines) + runs


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in sorted_runs(batches, ["doc_id", "mark"]):
        place = [run.column(c).to_numpy() for c in ("start", "end", "window")]
        gone = ~run.column("keep").to_numpy()
        counts = passages(*place), passages(*(c[gone] for c in place))
        yield pa.RecordBatch.from_pydict({"doc_id": run.column("doc_id")[:1].combine_chunks(), "n_repeated": counts[:1], "n_removed": counts[1:]})


def document_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: ``doc_id, n_repeated, n_removed, class_id``.

    ``n_repeated``: lines and sentences that stand elsewhere too, and passages of windows that do, apart from those; ``n_removed``: the
    same of what is not the first of its class; ``class_id``: the smallest doc_id connected by repeated units, itself included. Rows that repeat an id count together and each get the sums.
    """
    repeated = stored(repeated_units(docs, doc_id, text, similarity), "repeated-units")
    places = repeated.where(F.col("doc_id").isNotNull()).select("doc_id", "mark", "start", "end", "window", "keep")
    counted = places.repartition("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "start")
    counts = (
        counted.mapInArrow(_count_batches, "doc_id long, n_repeated long, n_removed long")
        .groupBy("doc_id").agg(F.sum("n_repeated").alias("n_repeated"), F.sum("n_removed").alias("n_removed"))
    )
    edges = repeated.where(F.col("doc_id").isNotNull() & F.col("class_doc").isNotNull()).select("doc_id", "class_doc").distinct()
    roots = components(edges)
    ids = docs.select(named(docs, doc_id).cast("long").alias("doc_id"))
    return (
        ids.join(counts, "doc_id", "left")
        .join(roots, ids["doc_id"] == roots["node"], "left")
        .select(
            ids["doc_id"], F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
            F.coalesce("root", ids["doc_id"]).alias("class_id"),
        )
    )
