"""The pipeline's near-duplicate stage against all pairs by exact five-word Jaccard similarity."""

from collections import Counter

import numpy as np

import corpus_pipeline
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def brute_force(rows):
    """Ids that stay: the smallest of each component."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similar(sets[i], sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    low = {}
    for g, (doc, _) in zip(group, rows, strict=True):
        low[g] = min(low.get(g, doc), doc)
    return set(low.values())


def planted(rng):
    """Texts with near copies of similarity 0.8 to 0.95, and some just below 0.8."""
    rows = []
    for i in range(60):
        words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
        other = list(words)
        for k in range(1 + i % 8):
            other[15 + 36 * k] = "changed"
        rows += [(9000 + 2 * i, " ".join(words)), (9001 + 2 * i, " ".join(other))]
    return rows


def test_stage_keeps_one_of_near_copies(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [*planted(np.random.default_rng(8)), (9901, None), (9902, ""), (9903, "two words"), (9904, "Two  WORDS")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(brute_force(rows))


def test_wide_prints_by_bit_planes(spark):
    """The stage's candidates come from fingerprints: bit planes of several words, and recall at 0.8 from them alone."""
    from tripmart.llm import near_copies, simhash

    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, (150, 4), dtype=np.uint64)
    prints[1::2] = prints[::2] ^ (np.uint64(1) << rng.integers(0, 63, (75, 4), dtype=np.uint64))
    near = np.unpackbits(simhash.near_lanes(prints, 72), axis=1, bitorder="little")[:, :150].astype(bool)
    bits = np.unpackbits(prints.view(np.uint8).reshape(150, -1), axis=1)
    assert (near == ((bits[:, None] != bits[None]).sum(axis=2) <= 72)).all()
    rows = [(i, 0, 0, len(t), i, near_copies.wide_prints([np.unique(near_copies.word_shingles(t.encode()))])[0].astype("<u8").tobytes()) for i, t in planted(rng)]
    distinct = spark.createDataFrame([(*r[:5], bytearray(r[5])) for r in rows], near_copies._WHOLE)
    found = {(r["band"], r["value"], r["digest"]) for r in near_copies.near_lanes_of(distinct).collect()}
    together = {}
    for band, value, digest in found:
        together.setdefault((band, value), set()).add(digest)
    pairs = {(i, i + 1) for i, _ in planted(np.random.default_rng(3))[::2]}
    assert {(i, i + 1) for i in (p[0] for p in pairs) if any({i, i + 1} <= g for g in together.values())} == pairs
    assert all(max(g) - min(g) <= 1 for g in together.values())
