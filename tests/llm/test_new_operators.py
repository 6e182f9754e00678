"""Piece coding, periodic runs and importance resampling against plain statements of their results."""

import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tripmart.llm import periodic_runs, resampling, sentence_pieces
from tripmart.llm.queries import QUERIES, tiled_words

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")

# Extra columns have names that operators use themselves, or that are no identifiers.
SCHEMA = "doc_id long, text string, `ids` string, `row` string, `my-col` struct<`my-f`: int, `a b`: string>, `ti``ck` int, score int"
HARD = [
    (1, None), (2, ""), (3, " "), (4, "   a  b "), (5, "▁lit▁▁eral ▁"), (6, "tab\tline\n\r\x00\x01  　x"), (7, "漢字かな交じり文 😀👍🏽 ﬁ Ａ é"),
    (8, "<s> </s> <unk> <0x0A>"), (9, "x" * 30000), (10, "word " * 20000), (11, "ab " * 9), (11, "ab " * 9), (None, "only null id"), (12, "a b a b a b a"),
]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", (1, "z"), 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    return rows + HARD


def test_odd_column_names(spark):
    """Columns with hyphens, blanks, back-quotes and such fields pass through every operator that hands rows on."""
    from tripmart.llm import decontamination, html_extraction, mixing, suffix_dedup, toxicity, url_filter

    schema = "doc_id long, text string, source string, url string, html string, `my-col` struct<`my-f`: int, `a b`: string>, `a b` int, `ti``ck` int"
    rows = [(i, f"some text {i} " * 30, "s", "http://a.org/", "<p>x y", (1, "z"), 2, 3) for i in range(4)]
    docs = spark.createDataFrame(rows, schema)
    from tripmart.llm import near_copies, simhash

    odd = ["my-col", "a b", "ti`ck"]
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rules = spark.createDataFrame([("allow", "org/")], "verdict string, rule string")
    made = [
        suffix_dedup.cut_repeats(docs).select("row.*"), decontamination.decontaminate(docs, items).select("row.*"),
        toxicity.score_toxicity(docs, toxicity.train([], [])).select("row.*"), html_extraction.extract_text(docs),
        url_filter.filter_urls(docs, rules), mixing.mix(docs, mixing.count_words(docs["text"])),
        sentence_pieces.encode_texts(docs, MODEL).select("row.*"), periodic_runs.periodic_runs(docs).select("row.*"),
        resampling.resample(docs, items).select("row.*"), simhash.keep_one(docs), near_copies.keep_one(docs),
    ]
    for result in made:
        assert [c for c in result.columns if c in odd] == odd
        assert {(tuple(r["my-col"]), r["a b"], r["ti`ck"]) for r in result.collect()} == {((1, "z"), 2, 3)}


def test_window_digests():
    """Equal windows of words have equal digests, whatever stands between the words; others do not."""
    from tripmart.llm import passage_dedup

    rng, pieces = random.Random(4), {}
    for _ in range(60):
        words = [rng.choice(["a", "bb", "ccc"]) for _ in range(rng.randint(1, 60))]
        text = "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words).encode()
        for start, end, digest in zip(*passage_dedup.window_digests(text), strict=True):
            assert pieces.setdefault(int(digest), passage_dedup.normal(text[start:end])) == passage_dedup.normal(text[start:end])
    assert len(set(pieces.values())) == len(pieces)
    assert [len(x) for x in passage_dedup.window_digests(b" \n")] == [0, 0, 0]


def test_unit_digests_and_shingles(spark):
    """Lines and sentences of real texts: digests are equal just where the words are, shingles are those of the unit alone."""
    import numpy as np

    from tripmart.llm import passage_dedup as p

    texts = [(r[0] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += [b"x" * 500 + b" a b c d e f g h i j k l m n o p", b"the the thing " * 9, b"the a thing " * 9, ("é" * 300 + " y" * 20).encode()]
    seen, units = {}, 0
    for text in texts:
        hashes, begins, stops = p.hashed_words(text)
        for start, end, _ in p.units(text):
            first, last = np.searchsorted(begins, start), np.searchsorted(stops, end, "right")
            digest = int(p.sequence_digests(hashes, np.array([first]), np.array([last]))[0])
            assert seen.setdefault(digest, p.normal(text[start:end])) == p.normal(text[start:end])
            assert (p.unit_shingles(text[start:end]) == p.shingles(hashes)[first : last - p.SHINGLE + 1]).all()
            units += 1
    assert units > 500 and len(set(seen.values())) == len(seen)


# Pieces -----------------------------------------------------------------------------------------


def test_pieces_as_the_library_gives_them(spark, texts):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = sentence_pieces.encode_texts(_frame(spark, texts), MODEL)
    assert encoded.select("row.*").columns == ["doc_id", "ids", "row", "my-col", "ti`ck", "score"]
    decoded = sentence_pieces.decode_ids(encoded.withColumn("a-b", F.lit(1)), MODEL)
    got = Counter((r[0], r[1], tuple(r[2]), r[3]) for r in decoded.select("row.row.doc_id", "row.text", "ids", "decoded").collect())
    want = Counter()
    for doc, text in texts:
        ids = processor.encode(text or "")
        want[doc, text, tuple(ids), processor.decode(ids)] += 1
    assert got == want


def test_pieces_of_random_texts_and_full_tables():
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    parts = [" ", "▁", "a", "the", "ing", "\n", "é", "漢", "😀", "  ", " ", "1", "<s>", "\x00"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    table = sentence_pieces.ChunkTable(processor, max_chunks=50)
    for at in range(0, len(some), 100):
        ids, bounds = table.encode(some[at : at + 100])
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == processor.encode(some[at : at + 100])


def test_whole_texts_are_chunks_where_pieces_cross_markers():
    class Crossing(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "of▁the" if i == 500 else super().id_to_piece(i)

    table = sentence_pieces.ChunkTable(Crossing(model_file=MODEL))
    assert not table.separable
    ids, bounds = table.encode(["one  two", "", "one  two"])
    assert ids[: bounds[1]].tolist() == table.processor.encode("one  two") == ids[bounds[2] :].tolist()


def test_piece_query(spark):
    rows = QUERIES["op11_sentencepiece_coding"](spark, SMALL).collect()
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(docs)
    for row in rows:
        ids = processor.encode(docs[row["doc_id"]] or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = hashlib.sha256(processor.decode(ids).encode()).hexdigest()
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), digest, text)


# Runs -------------------------------------------------------------------------------------------


def _plain_runs(words):
    """Every period in turn: stretches in which each word equals the one a period later."""
    words, found = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if len(words) else np.zeros(0, int), {}
    for q in range(1, len(words) // 4 + 1):
        same = np.concatenate([[0], words[q:] == words[:-q], [0]]).astype(int)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1) + q, strict=True):
            if e - s >= max(6, 4 * q):
                found.setdefault((int(s), int(e)), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(1500):
        documents = []
        for _ in range(rng.randint(0, 4)):
            words, n = [], rng.randint(0, 130)
            while len(words) < n:
                unit = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 14))]
                words += unit * rng.choice([1, 1, 2, 4, 5, 9])
            documents.append(words)
        got = [[tuple(map(int, r)) for r in runs] for runs in periodic_runs.find_runs(documents)]
        assert got == [_plain_runs(words) for words in documents]


def test_runs_of_powers_within_powers():
    """Blocks that occur three times in a window: the run's period follows from where the smaller period ends."""
    for x in range(1, 14):
        for y in range(1, 6):
            unit = ["a"] * x + ["b"] * y
            words = ["b"] + unit * 5 + ["a"] * 3
            [runs] = periodic_runs.find_runs([words])
            assert [tuple(map(int, r)) for r in runs] == _plain_runs(words)


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for m in (1, 2, 7, 64, 100):
        values = rng.permutation(m)
        tree = periodic_runs.WaveletTree(values)
        low = rng.integers(0, m, 50)
        high = low + 1 + rng.integers(0, m, 50) % (m - low)
        bound = rng.integers(0, m + 1, 50)
        below = [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound, strict=True)]
        assert tree.count_below(low, high, bound).tolist() == below
        k = rng.integers(0, m, 50) % (high - low)
        kth = [int(np.sort(values[a:b])[i]) for a, b, i in zip(low, high, k, strict=True)]
        assert tree.select(low, high, k).tolist() == kth


def test_run_query(spark, texts, tmp_path):
    many = texts + [(i, "eins zwei drei vier " * (i % 50)) for i in range(1000, 1200)]
    _frame(spark, many).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    want = Counter()
    for doc, text in many:
        words = tiled_words(doc, (text or "").encode().split())
        runs = _plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join("%d,%d,%d\n" % r for r in runs).encode()
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[doc, len(runs), *numbers, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    assert sum(r["n_runs"] > 0 for r in rows) > 50


def test_tiled_words():
    doc = next(i for i in range(100) if crc32(str(i).encode()) % 10 == 0)
    words = [b"w%d" % i for i in range(40)]
    g = crc32(str(doc).encode()) // 10
    a = g % 40
    p = 1 + (40 - a) // (3 + g % 8)
    assert tiled_words(doc, words) == words[:a] + [words[a + k % p] for k in range(40 - a)]
    assert tiled_words(doc, []) == [] and tiled_words(None, words) == words


# Resampling -------------------------------------------------------------------------------------


def _plain_resample(rows, target, n_max=1, buckets=10000, least=20, percent=10):
    def features(text):
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(words[i : i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]
        return len(words), [crc32(gram.encode()) % buckets for gram in grams]

    parts = [features(text) for _, text in rows]
    s, t = Counter(b for _, f in parts for b in f), Counter(b for text in target for b in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    scored = []
    for (doc, _), (n_words, found) in zip(rows, parts, strict=True):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in found]
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc, n_words, len(found), sum(gain), sum(gain) + noise))
    enough = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = len(enough) * percent // 100
    ranked = [(*r, place if place <= drawn else None) for place, r in enumerate(enough, 1)]
    return Counter(ranked + [(*r, None) for r in scored if r[1] < least])


@pytest.mark.parametrize("n_max", [1, 3])
def test_resampling(spark, texts, n_max):
    rows = texts + [(77, "Same words here. " * 9)] * 30 + [(None, "no id, but enough words " * 6)] * 3
    target = ["Same HERE words", None, "", "the a of " * 20, "漢字 Ünï"]
    benchmark = spark.createDataFrame([(t, 1) for t in target], "text string, row int")
    drawn = resampling.resample(_frame(spark, rows), benchmark, max_n=n_max)
    got = Counter(map(tuple, drawn.select("row.doc_id", "n_words", "n_features", "weight", "score", "rank").collect()))
    assert got == _plain_resample(rows, target, n_max)
    assert drawn.select("row.*").columns == ["doc_id", "ids", "row", "my-col", "ti`ck", "score"]


def test_resampling_hands_texts_on(spark):
    drawn = resampling.resample(_frame(spark, [(i, f"word{i} " * 25) for i in range(40)]), spark.createDataFrame([("word7",)], "text string"), keep_text=True)
    kept = drawn.where("rank IS NOT NULL").orderBy("rank").select("row.doc_id", "row.text").collect()
    assert len(kept) == 4 and kept[0]["text"].startswith(f"word{kept[0]['doc_id']} ")


def test_empty_tables(spark):
    empty = _frame(spark, [])
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, none).count() == 0
    assert resampling.resample(_frame(spark, HARD), none).count() == len(HARD)
    assert periodic_runs.periodic_runs(empty).count() == 0
    assert sentence_pieces.decode_ids(sentence_pieces.encode_texts(empty, MODEL), MODEL).count() == 0
