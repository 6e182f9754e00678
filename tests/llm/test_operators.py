"""The operators against plain statements of the same results, with nulls, empties, ties and repeats."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tripmart.llm import chat_format, decontamination, html_extraction, mixing, passage_dedup, simhash, suffix_dedup
from tripmart.llm import topk, toxicity, url_filter
from tripmart.llm.graph import components
from tripmart.llm.queries import QUERIES
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long"


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents and hard cases, with extra columns whose names operators use themselves."""
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [
        (9001, "a" * 700), (9002, "ab" * 150), (9003, "x" + "Is onhe. " * 60), (9004, None), (9005, ""), (9006, "y" * 199),
        (9006, "y" * 199), (None, "only one word here"), (9007, "wort " * 3000), (9008, "qwertz" * 33 + "é" * 130),
    ]
    full = [(i, t, None, f"s{(i or 0) % 3}" if (i or 0) % 7 else None, 0, "clash", 5) for i, t in rows]
    return rows, spark.createDataFrame(full, DOCS)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(docs):
    rows, df = docs
    prints = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
        prints.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(grams)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    low = defaultdict(list)
    for g, (doc, _) in zip(group, rows, strict=True):
        low[g] += [] if doc is None else [doc]
    want = Counter((d, p, min(low[g], default=None)) for (d, _), p, g in zip(rows, prints, group, strict=True))
    got = Counter((r[0], r[1] & (2**64 - 1), r[2]) for r in simhash.simhash_groups(df).collect())
    assert got == want
    assert simhash.keep_one(df).columns == df.columns


def test_near_lanes():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for i in range(150):
        x[i + 150] = x[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, i % 8, replace=False)))
    near = np.unpackbits(simhash.near_lanes(x), axis=1, bitorder="little")[:, :300]
    assert (near == (np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)).all()


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(docs, hot):
    rows, df = docs
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = Counter()
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 199):
            gone[i + 1 : i + 201] |= seen[t[i : i + 200]] > 1
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum())
        want[doc, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.cut_repeats(df, hot_segments=hot).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == want


def test_suffix_array():
    rng = np.random.default_rng(5)
    for letters in (b"ab", b"abc ", bytes(range(256))):
        for n in (0, 1, 2, 60, 500):
            t = bytes(rng.choice(list(letters), n).astype(np.uint8))
            assert list(suffix_dedup.suffix_array(t, 520)) == sorted(range(n), key=lambda i: t[i:])


def test_decontamination(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, f"x {ten.upper()} y"), (2, ten.replace("five", "other")), (3, None), (4, "lone"), (5, f"{ten} {ten}"), (5, f"{ten} {ten}")]
    items = [(7, f"{ten} eleven"), (7, f"{ten} eleven"), (8, "Lone"), (9, None), (10, ""), (None, "nothing like it")]
    found = decontamination.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    got = sorted((r["row"]["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect())
    assert got == [(1, 12, 10, ["7"]), (2, 10, 0, []), (3, 0, 0, []), (4, 1, 1, ["8"]), (5, 20, 20, ["7"]), (5, 20, 20, ["7"])]
    near = decontamination.proximity_matches(
        spark.createDataFrame([(1, ten.replace("five", "five five"))], "doc_id long, text string"),
        spark.createDataFrame([(7, ten)], "item_id long, text string"), slop=2,
    )
    assert near.count() >= 1


def test_url_filter(spark):
    pages = [(1, "HTTP://A.Example.ORG/en/12?x"), (2, "http://org"), (3, None), (4, "no scheme"), (5, "http://x.com/de/"), (5, "http://x.com/de/")]
    rules = [("allow", "org/"), ("block", "example.org/en/1"), ("block", "com/de/"), ("block", "le.org/"), (None, "x"), ("block", None)]
    got = url_filter.filter_urls(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "verdict string, rule string")
    )
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()) == [
        (1, "a.example.org", "/en/12", "example.org/en/1", "block"), (2, "org", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "", "", None, "allow"), (5, "x.com", "/de/", "com/de/", "block"), (5, "x.com", "/de/", "com/de/", "block"),
    ]


def test_mixing(docs):
    _, df = docs
    rows = mixing.fair_queue(df, mixing.count_words(df["text"])).collect()
    total = sum(r["size"] for r in rows) / 2
    taken = defaultdict(int)
    for r in rows:
        taken[r["queue"]] += r["size"] * r["taken"]
    target = {r["queue"]: r["target"] for r in rows}
    largest = max(r["size"] for r in rows)
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[q] - target[q]) <= 2 * largest for q in target)
    assert mixing.mix(df, mixing.count_words(df["text"])).columns == df.columns
    assert mixing.mix(df.limit(0), mixing.count_words(df["text"])).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)]
    bad = [(200, None), (None, [1.0]), (300, [float("nan"), 1.0]), (400, [None, 1.0]), (500, [float("inf")])]
    vectors = topk.quantised(spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>"))
    want = []
    for q, x in rows[::50]:
        scores = sorted((-int(np.dot(np.array(x) * 1024, np.array(y) * 1024)), i) for i, y in rows if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(vectors.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_html():
    page = (
        "<html><head><title>T</title><script>x='<p>no</p>'</script></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>"
        "<div class='ad'>Buy, buy, now.</div><article><h1>Head</h1><p><b>One &amp; two,<br>three.<p>Of.</p><p>A long line, with words, "
        "and more.</p></article><div id=comments><p>Nice, very nice text.</p></div><aside>Side</aside><footer>&copy; End</footer></body></html>"
    )
    assert html_extraction.main_text(page) == "Head One & two, three. Of. A long line, with words, and more."
    assert [html_extraction.main_text(x) for x in (None, "", "<nav>a</nav>", "plain  text")] == ["", "", "", "plain text"]


def test_toxicity():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        t = rng.choice(words, 90).tolist()
        if i % 4 == 0:
            t[rng.integers(90)] = "xyzz" + rng.choice(words)[:3]
        texts.append(" ".join(t))
        labels.append(int(i % 4 == 0))
    scores = toxicity.Scorer(toxicity.train(texts[:400], labels[:400])).scores([*texts[400:], "", None])
    assert ((scores[:200] >= 0.7) == np.array(labels[400:], bool)).mean() > 0.95
    assert (scores[200:] < 0.7).all()


def test_toxicity_memory():
    """Many distinct words, and a long text, take a bounded share of memory and get the scores of a fresh start."""
    rng, letters = np.random.default_rng(2), np.array(list("abcdefghijklmnopqrst"))
    words = ["".join(w) for w in letters[rng.integers(20, size=(330_000, 8))]]
    model = toxicity.Model({"aaaa": 2.0, words[5]: -1.0}, {g: float(rng.normal()) for w in words[:3000] for g in toxicity.grams(w)})
    texts = ["", None, "12", *(" ".join(words[at : at + 400]) for at in range(0, 210_000, 400)), " ".join(words[210_000:]), "aaaa qrst"]
    scorer = toxicity.Scorer(model)
    tracemalloc.start()
    try:
        scores = scorer.scores(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 90e6  # over 300 MB with the words of all texts in one table
    assert scores[0] == scores[1] == scores[2] and len(set(scores.tolist())) > 100
    for i in (0, 3, 100, 400, len(texts) - 2, len(texts) - 1):
        ids = toxicity.text_words(texts[i])
        table = model.gates(model.inputs(*model.lookup(ids)))
        logit = model.forward(table, toxicity.windows(np.arange(1, len(ids) + 1))).max()
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-float(logit))), abs=1e-5)


def test_word_runs(monkeypatch):
    """The windows of the runs are those of the whole text, at any length."""
    monkeypatch.setattr(toxicity, "_RUN", 2 * toxicity.STRIDE)
    for n in [0, 1, 40, 63, 64, 65, 111, 112, 113, 160, 161, 208, 209, 500, *range(590, 700)]:
        text = " ".join("x" * (i % 5 + 1) + "abcde"[i % 3] for i in range(n)) + " 7"
        number = {}
        cut = [toxicity.windows(np.array([number.setdefault(w, len(number) + 1) for w in run], int)) for run in toxicity.word_runs(text)]
        whole = toxicity.windows(np.array([number[w] for w in toxicity.text_words(text)], int))
        assert np.array_equal(np.concatenate(cut), whole)


def test_toxicity_batches_are_bounded(spark):
    """Wide rows reach the scorer in Arrow batches of a few MB, and each gets its score."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 400).alias("text"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        scored = toxicity.score_toxicity(docs, toxicity.train([], []))
        largest = scored.select("text").mapInArrow(lambda batches: (pa.record_batch([[b.nbytes]], ["n"]) for b in batches), "n long")
        assert largest.agg(F.max("n")).first()[0] < 5e6
        assert scored.select("row.doc_id").distinct().count() == scored.where("score < 0.7").count() == 4000
    finally:
        if before is not None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
        else:
            spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_gradients():
    model = toxicity.Model({"a": 1.0}, {"<aa>": 1.0})
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    x, ids, y = rng.normal(size=(5, 11)), np.array([[1, 2, 3, 0], [4, 5, 2, 1]]), np.array([0.0, 1.0])

    def loss():
        z = model.forward(model.gates(x), ids)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads, _ = model.gradients(x, model.gates(x), ids, y)
    for name in ("uf", "wb", "att", "out"):
        flat = model.p[name].reshape(-1)
        for i in (0, len(flat) // 2):
            flat[i] += 1e-2
            up = loss()
            flat[i] -= 2e-2
            down = loss()
            flat[i] += 1e-2
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_chat(spark):
    calls = [(1, 0, "a", "t", '{"q":"x"}', []), (1, 1, "b", "t", '{"z":1}', ["a"]), (1, 2, "c", "u", "no json", ["b", "gone"]), (2, 0, "a", "t", None, ["b"]), (2, 1, "b", "t", '{"q":1}', ["a"]), (None, 0, "x", "t", None, None)]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", "fine"), (1, "b", None)], "conv_id long, call_id string, result string")
    schema = {"t": {"properties": {"q": {"type": "string"}}, "required": ["q"], "additionalProperties": False}}
    got = {(r["conv_id"], r["call_id"]): r for r in chat_format.link_calls(calls, results, schema).collect()}
    assert [got[1, c]["level"] for c in "abc"] == [0, 1, 2] and got[2, "a"]["level"] is None
    assert got[1, "a"]["json"] == '{"arguments":{"q":"x"},"depends_on":[],"id":"a","name":"t","result":"fine"}'
    assert got[1, "a"]["valid"] and got[1, "b"]["errors"] == ["missing q", "unknown z"] and len(got) == 5


def test_passages(spark):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    long, near = word(60), word(100)
    docs = [(1, f"{word(20)}\n{long}"), (2, f"{word(30)}\n{long}"), (3, near), (4, near[:-3] + "zzz"), (5, word(40)), (6, None), (7, "")]
    got = {r["doc_id"]: r for r in passage_dedup.document_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: r["class_id"] for d, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}
    assert got[2]["n_removed"] == 1 and got[1]["n_removed"] == 0


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Rows that repeat an id or a label count once; null and other labels and held-out ids are not learned from."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.extend(zip(texts, labels, strict=True)))
    docs = spark.createDataFrame([(i % 20, f"text {i % 20} {i}") for i in range(200)] + [(None, "x"), (3, None), (4, "")], "doc_id long, text string")
    labels = [(i % 20, int(i % 20 < 5)) for i in range(40)] + [(None, 1), (7, None), (8, 2)]
    toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), rows=4)
    ids = [t.split()[1] for t, _ in seen]
    assert len(ids) == len(set(ids)) and sum(x for _, x in seen) <= 4 and 4 < len(seen) <= 8
    held = spark.createDataFrame([(int(i),) for i in ids], "i long").where(toxicity.held_out(F.col("i"))).count()
    assert held == 0


def test_empty_tables(spark):
    """Every operator gives no rows for no rows."""
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert simhash.simhash_groups(none).count() == simhash.keep_one(none).count() == 0
    assert suffix_dedup.cut_repeats(none).count() == passage_dedup.document_classes(none).count() == 0
    assert decontamination.decontaminate(none, items).count() == 0
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(none, model).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame([("allow", "org/")], "verdict string, rule string")
    assert url_filter.filter_urls(pages, rules).count() == html_extraction.extract_text(pages).count() == 0
    full = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    found = decontamination.decontaminate(full, items.limit(0)).collect()
    assert sorted((r["row"]["doc_id"], r["n_hit"], r["items"]) for r in found) == [(1, 0, []), (2, 0, [])]
    calls = spark.createDataFrame([], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    assert chat_format.link_calls(calls, spark.createDataFrame([], "conv_id long, call_id string, result string"), {}).count() == 0


def test_clashing_columns(docs, spark):
    """Columns of the input that carry an operator's own names come back unharmed."""
    _, df = docs
    wide = df.limit(40).withColumns({"score": F.lit("mine"), "kept": F.lit("mine"), "print": F.lit("mine"), "words": F.lit("mine")})
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    for made in (suffix_dedup.cut_repeats(wide), decontamination.decontaminate(wide, items), toxicity.score_toxicity(wide, toxicity.train([], []))):
        row = made.select("row.*")
        assert row.count() == 40 and row.where("score = 'mine' AND kept = 'mine' AND print = 'mine' AND row = 'clash'").count() == 40
    assert simhash.keep_one(wide).where("print = 'mine'").count() > 0
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>x", "old", "old")], "page_id long, url string, html string, text string, host string")
    rules = spark.createDataFrame([("allow", "org/")], "verdict string, rule string")
    assert html_extraction.extract_text(pages).first()["text"] == "x"
    assert url_filter.filter_urls(pages, rules).first()["host"] == "a.org"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
