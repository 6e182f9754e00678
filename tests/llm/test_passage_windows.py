"""Passages that lines and sentences of 14 words miss."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tripmart.llm import passage_dedup


@pytest.fixture
def word():
    rng = np.random.default_rng(6)
    return lambda n: ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


def classes(spark, docs):
    found = passage_dedup.document_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    return {r["doc_id"]: r for r in found.collect()}


def lines(words, n):
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


def test_short_lines(spark, word):
    """Copies of poems and lists, also in other surroundings and wrapped differently; whole short texts; texts without blanks."""
    poem, other, chars = word(60), word(60), np.random.default_rng(7)
    han = "".join(chr(c) for c in chars.integers(0x4E00, 0x9FA5, 400))
    docs = [
        (1, lines(poem, 6)), (2, lines(poem, 6)), (3, lines(word(9) + poem + word(9), 7)), (4, lines(other, 5)),
        (5, "just three words"), (6, "Just three\nwords"), (7, "just four words here"),
        (8, han), (9, "文" * 31 + han[20:] + "字" * 50), (10, "".join(chr(c) for c in chars.integers(0x4E00, 0x9FA5, 400))),
    ]
    got = classes(spark, docs)
    assert {d: r["class_id"] for d, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8, 10: 10}
    assert got[2]["n_repeated"] == got[2]["n_removed"] == 1 and got[1]["n_removed"] == 0


def test_every_word_lies_in_a_window(word):
    for n in (1, 13, 14, 15, 26, 27, 200):
        text = lines(word(n), 4).encode()
        covered = np.zeros(len(text), bool)
        for start, end, piece in passage_dedup.windows(text):
            covered[start:end] = True
            assert piece == passage_dedup.normal(text[start:end])
        assert covered[~passage_dedup._BLANK[np.frombuffer(text, np.uint8)]].all()


def test_passages_in_other_surroundings(spark, word):
    """A passage of 51 words inside long lines: of short sentences, cut inside sentences, without stops, with one word changed."""
    def stops(words, n):
        return " ".join(w + "." * (i % n == n - 1) for i, w in enumerate(words))

    short, cut, bare, changed = word(51), word(51), word(51), word(51)
    docs = []
    for k, passage in enumerate((stops(short, 8), stops(cut, 20), " ".join(bare), " ".join(changed))):
        for side in range(2):
            if k == 3 and side:
                passage = passage.replace(changed[25], "other")
            docs.append((10 * k + side, " ".join(word(80)) + " " + passage + " " + " ".join(word(80))))
    got = classes(spark, docs)
    assert {d: r["class_id"] for d, r in got.items()} == {10 * k + side: 10 * k for k in range(4) for side in range(2)}
    assert all(r["n_repeated"] >= 1 for r in got.values())


def plain_units(text):
    """Lines of 14 words or more, and such sentences of lines with several, one line at a time."""
    found, at = set(), 0
    for line in text.split(b"\n"):
        if len(line.split()) >= passage_dedup.MIN_WORDS:
            found.add((at, at + len(line), True))
            ends = [(m.start(), m.end()) for m in re.finditer(rb"(?<=[.!?])[ \t]+", line)]
            pieces = [(a, b) for a, b in zip([0, *(e for _, e in ends)], [*(b for b, _ in ends), len(line)], strict=True) if a < b]
            if len(pieces) > 1:
                found |= {(at + a, at + b, False) for a, b in pieces if len(line[a:b].split()) >= passage_dedup.MIN_WORDS}
        at += len(line) + 1
    return found


def unit_rows(texts):
    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(len(texts))], "mark": [7] * len(texts), "bytes": pa.array(texts, pa.binary())})
    return sorted((tuple(r.values()) for b in passage_dedup._unit_batches(iter([batch])) for r in b.to_pylist()), key=repr)


def test_texts_together(monkeypatch):
    """Texts that a task takes together have the units, digests and bands that each has by itself; nothing crosses their ends."""
    rng = random.Random(5)
    ends = [" ", " ", " ", "\n", ". ", "!\t ", "? \n", " \r ", ".\r\n", "\x0b"]
    words = ["a", "Bb", "ccc", "é", "x" * 130, "ab" * 300, "..."]
    texts = [None, b"", b" \n", b"one. "]
    for n in (1, 13, 14, 25, 26, 27, 200) * 12:
        kinds, gaps = rng.randint(1, len(words)), rng.randint(1, len(ends))
        texts.append("".join(rng.choice(words[:kinds]) + rng.choice(ends[:gaps]) for _ in range(n)).encode())
    together = unit_rows(texts)
    monkeypatch.setattr(passage_dedup, "PART", 1)
    assert unit_rows(texts) == together and len(together) > 500
    for doc, text in enumerate(texts):
        mine = {(r[2], r[3], bool(r[6])) for r in together if r[0] == doc and not r[5]}
        assert mine == set(passage_dedup.units(text or b"")) == plain_units(text or b"")
        assert sum(r[0] == doc and r[5] for r in together) == len(passage_dedup.windows(text or b""))


def test_different_words_are_hashed_once(monkeypatch):
    """The words of many texts cost a hash for each different one, not for each."""
    calls, real = [], passage_dedup.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(passage_dedup.xxhash, "xxh3_64_intdigest", lambda word: calls.append(word) or real(word))
    assert len(unit_rows([b"One two three " * 60] * 20)) > 20
    assert sorted(calls) == [b"one", b"three", b"two"]
