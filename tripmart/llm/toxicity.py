"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word: how strongly the word and its character grams go with the label in one part of the
training sample (word score; greatest and mean gram score), and learned vectors of the word and of its grams. The network reads
windows of words in both directions, pools its states by attention and gives a score; a document's score is the
greatest of all its overlapping windows. A scoring task holds a batch of a few MB, one group of windows and a bounded
memory of words at a time, however long or many its texts are. The network is trained on the other part of the sample, so that it
never sees scores that its own labels made; each document gives its highest window, found again between rounds.

Training takes a sample of at most SAMPLE_ROWS labelled documents (those with the smallest MD5 of their id, each label apart), which
is all that reaches the driver; the model that goes to the executors has a fixed greatest size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.llm.common import named
from tripmart.session import bound_batches

SAMPLE_ROWS = 3000  # of each label, at most
SAMPLE_CHARS = 50_000  # longer documents are not drawn for training; all are scored whole
VOCABULARY = 30_000  # words, and as many grams, with a score
THRESHOLD = 0.7
HIDDEN, DIM = 8, 4
WINDOW, STRIDE = 64, 48
_PAD_GATE = 30.0  # keeps the state through padding
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 1 << 17  # words whose inputs a task remembers
_GROUP = 1024  # windows that a task scores at a time
_RUN = _GROUP * STRIDE  # words of a text that a task holds at a time
GRAM_SIZES = (4, 5)


def text_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_runs(text: str | None) -> Iterator[list[str]]:
    """The words of a text in overlapping runs, whose windows together are those of the whole text."""
    if not text or len(text) <= _RUN:  # no more words than characters
        yield text_words(text)
        return
    found = map(re.Match.group, _WORD.finditer(text.lower()))
    run = list(islice(found, _RUN + WINDOW - STRIDE))
    yield run
    while more := list(islice(found, _RUN)):
        run = run[_RUN:] + more
        yield run


def grams(word: str) -> list[str]:
    """Character grams of the word between marks of its ends."""
    marked = f"<{word}>"
    return [marked[i : i + n] for n in GRAM_SIZES for i in range(len(marked) - n + 1)]


def _association(docs: Iterable[list[str]], labels: np.ndarray, keep: int) -> dict[str, float]:
    """Smoothed log odds of the label for documents with a token, for the ``keep`` tokens furthest from zero."""
    with_label, without = Counter(), Counter()
    for tokens, label in zip(docs, labels, strict=True):
        (with_label if label else without).update(set(tokens))
    share = max(labels.mean(), 1e-6)
    odds = {}
    for t in with_label.keys() | without.keys():
        p, q = with_label[t], without[t]
        if p + q >= 3:
            odds[t] = float(np.log((p + 5 * share) / share / (q + 5 * (1 - share)) * (1 - share)))
    return dict(sorted(odds.items(), key=lambda x: (-abs(x[1]), x[0]))[:keep])


def _sum_rows(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows with the same index."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[index[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Model:
    """Vocabulary, learned vectors and weights; small enough to be sent with a task."""

    def __init__(self, words: dict[str, float], char_grams: dict[str, float], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.words = {w: i + 1 for i, w in enumerate(sorted(words))}
        self.grams = {g: i + 1 for i, g in enumerate(sorted(char_grams))}
        self.word_score = np.array([0.0, *(words[w] for w in self.words)], np.float32)
        self.gram_score = np.array([0.0, *(char_grams[g] for g in self.grams)], np.float32)
        n, h = 3 + 2 * DIM, HIDDEN
        init = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {
            "word": init(len(self.word_score), DIM) / 3, "gram": init(len(self.gram_score), DIM) / 3,
            "att": init(2 * h, h), "att_v": init(h), "out": init(2 * h), "bias": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {f"w{d}": init(n, 3 * h), f"u{d}": init(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, and the numbers and counts of the grams of each word (at least one: zero)."""
        known = self.grams.get
        ids = [[i for g in grams(w) if (i := known(g))] or [0] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        return np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words)), flat, sizes

    def inputs(self, word: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(word):
            return np.zeros((0, 3 + 2 * DIM), np.float32)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        score, share = self.gram_score[flat], sizes[:, None].astype(np.float32)
        return np.concatenate(
            [
                self.word_score[word][:, None], np.maximum.reduceat(score, first)[:, None],
                np.add.reduceat(score, first)[:, None] / share, self.p["word"][word],
                np.add.reduceat(self.p["gram"][flat], first, axis=0) / share,
            ],
            axis=1,
        )

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions; row 0 is padding, which keeps the state."""
        made = np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=1)
        pad = np.zeros((1, 6 * HIDDEN), np.float32)
        pad[:, :HIDDEN] = pad[:, 3 * HIDDEN : 4 * HIDDEN] = _PAD_GATE
        return np.concatenate([pad, made.astype(np.float32)])

    def forward(self, table: np.ndarray, ids: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of windows: rows of word numbers in ``table``, 0 for padding."""
        n, steps, h = len(ids), ids.shape[1], HIDDEN
        states = np.zeros((steps, n, 2 * h), np.float32)
        for k, d in enumerate("fb"):
            u, part, state = self.p[f"u{d}"], table[:, 3 * h * k : 3 * h * (k + 1)], np.zeros((n, h), np.float32)
            part = np.ascontiguousarray(part)
            for t in range(steps) if d == "f" else reversed(range(steps)):
                x, r = part[ids[:, t]], state @ u
                zr = 1 / (1 + np.exp(-(x[:, : 2 * h] + r[:, : 2 * h])))
                z = zr[:, :h]
                new = np.tanh(x[:, 2 * h :] + zr[:, h:] * r[:, 2 * h :])
                if trace is not None:
                    trace[d, t] = (state, zr, new, r[:, 2 * h :])
                state = new + z * (state - new)
                states[t, :, h * k : h * (k + 1)] = state
        inner = np.tanh(states @ self.p["att"])
        weight = inner @ self.p["att_v"] - 1e4 * (ids.T == 0)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if trace is not None:
            trace |= {"states": states, "inner": inner, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, table: np.ndarray, ids: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean log loss: by parameter, and by the words' inputs ``x``."""
        trace: dict = {}
        logit = self.forward(table, ids, trace)
        h, p, g = HIDDEN, self.p, {}
        d_logit = ((1 / (1 + np.exp(-logit)) - target) / len(ids)).astype(np.float32)
        states, inner, weight, pooled = trace["states"], trace["inner"], trace["weight"], trace["pooled"]
        g["out"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_inner = d_e[:, :, None] * p["att_v"] * (1 - inner**2)
        g["att_v"] = np.einsum("tn,tnh->h", d_e, inner)
        g["att"] = np.einsum("tnh,tnk->hk", states, d_inner)
        d_states = weight[:, :, None] * d_pooled + d_inner @ p["att"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, d_inputs = p[f"u{d}"], np.empty((ids.shape[1], len(ids), 3 * h), np.float32)
            g_u, d_state = np.zeros_like(u), np.zeros((len(ids), h), np.float32)
            steps = range(ids.shape[1])
            for t in reversed(steps) if d == "f" else steps:
                before, zr, new, r_new = trace[d, t]
                z, r = zr[:, :h], zr[:, h:]
                total = d_state + d_states[t, :, h * k : h * (k + 1)]
                d_new = total * (1 - z) * (1 - new**2)
                d_z = total * (before - new) * z * (1 - z)
                d_r = d_new * r_new * r * (1 - r)
                d_inputs[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_rec = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g_u += before.T @ d_rec
                d_state = total * z + d_rec @ u.T
            d_table = _sum_rows(ids.T.ravel(), d_inputs.reshape(-1, 3 * h), len(table))[1:]
            g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = g_u, x.T @ d_table, d_table.sum(axis=0)
            d_x += d_table @ p[f"w{d}"].T
        return g, d_x


def windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows of word numbers that cover the whole text; the last may be padded."""
    count = 1 + max(0, -(-(len(ids) - WINDOW) // STRIDE))
    padded = np.zeros((count - 1) * STRIDE + WINDOW, ids.dtype)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class Scorer:
    """Scores texts, a group of windows at a time, remembering the inputs of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.known = np.empty((_CACHE, 3 + 2 * DIM), np.float32)
        self.again = np.zeros(_CACHE, bool)

    def _remember(self, words: list[str], inputs: np.ndarray) -> None:
        """Where there is no room, words that were not met again are forgotten."""
        if len(self.number) + len(words) > _CACHE:
            stay = np.flatnonzero(self.again)[: _CACHE // 2]
            names = list(self.number)
            self.number = {names[i]: at for at, i in enumerate(stay.tolist())}
            self.known[: len(stay)] = self.known[stay]
            self.again[:] = False
        begin = len(self.number)
        end = min(begin + len(words), _CACHE)
        self.number.update(zip(words, range(begin, end), strict=False))
        self.known[begin:end] = inputs[: end - begin]

    def _inputs(self, words: list[str]) -> np.ndarray:
        """The inputs of words, each given once."""
        place = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        met = place >= 0
        out = np.empty((len(words), 3 + 2 * DIM), np.float32)
        out[met] = self.known[place[met]]
        self.again[place[met]] = True
        if not met.all():
            new = [words[i] for i in np.flatnonzero(~met).tolist()]
            out[~met] = made = self.model.inputs(*self.model.lookup(new))
            self._remember(new, made)
        return out

    def window_logits(self, runs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each window, and the number of windows of each run of words."""
        words = list(dict.fromkeys(chain.from_iterable(runs)))
        get = dict(zip(words, range(1, len(words) + 1), strict=True)).__getitem__
        cut = [windows(np.fromiter(map(get, run), np.int32, len(run))) for run in runs]
        whole, table = np.concatenate(cut), self.model.gates(self._inputs(words))
        logits = [self.model.forward(table, whole[at : at + _GROUP]) for at in range(0, len(whole), _GROUP)]
        return np.concatenate(logits), np.array([len(c) for c in cut], np.int64)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """A score of 0 to 1 for each text; a text without words has the score of padding alone."""
        top: list[float] = []
        for owners, runs in _groups(texts):
            logits, sizes = self.window_logits(runs)
            highest = np.maximum.reduceat(logits, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            for i, logit in zip(owners, highest.tolist(), strict=True):
                if i < len(top):  # another run of the same text
                    top[i] = max(top[i], logit)
                else:
                    top.append(logit)
        return 1 / (1 + np.exp(-np.array(top, np.float64)))


def _groups(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Runs of words of about ``_GROUP`` windows, with the places of their texts."""
    owners, runs, size = [], [], 0
    for i, text in enumerate(texts):
        for run in word_runs(text):
            owners.append(i)
            runs.append(run)
            size += 1 + len(run) // STRIDE
            if size >= _GROUP:
                yield owners, runs
                owners, runs, size = [], [], 0
    if runs:
        yield owners, runs


def train(texts: list[str], labels: list[int], rounds: int = 3, epochs: int = 4, seed: int = 7) -> Model:
    """Fit a model; without two kinds of labels it stays untrained, and scores stay near one half or below."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    order = rng.permutation(len(texts))
    half = order[: len(order) // 2], order[len(order) // 2 :]
    one: dict[str, str] = {}  # equal words are kept once
    counted = [{one.setdefault(w, w) for w in text_words(texts[i])} for i in half[0]]
    word_odds = _association(counted, y[half[0]], VOCABULARY) if counted else {}
    gram_docs = ({g for w in words for g in grams(w)} for words in counted)
    model = Model(word_odds, _association(gram_docs, y[half[0]], VOCABULARY) if counted else {}, seed)
    del counted, one
    y = y[half[1]]
    if not 0 < y.sum() < len(y):
        model.p["bias"][:] = -3 if not y.any() else 0
        return model
    number: dict[str, int] = {}
    cut = [
        windows(np.fromiter((number.setdefault(w, len(number) + 1) for w in text_words(texts[i])), np.int32)) for i in half[1]
    ]
    vocabulary = list(number)
    del number
    word, flat, sizes = model.lookup(vocabulary)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    strength = np.concatenate([[0], np.maximum.reduceat(model.gram_score[flat], first) + model.word_score[word]])
    step = 0
    for turn in range(rounds):
        if turn:
            table = model.gates(model.inputs(word, flat, sizes))
            whole = np.concatenate(cut)
            value = np.concatenate([model.forward(table, whole[at : at + 2048]) for at in range(0, len(whole), 2048)])
        else:
            value = strength[np.concatenate(cut)].max(axis=1)
        ends = np.cumsum([len(c) for c in cut])
        best = [int(v.argmax()) for v in np.split(value, ends[:-1])]
        rows = np.stack([c[b] for c, b in zip(cut, best, strict=True)])
        other = np.stack([c[rng.integers(len(c))] for c, t in zip(cut, y, strict=True) if not t])
        rows, target = np.concatenate([rows, other]), np.concatenate([y, np.zeros(len(other), np.float32)])
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
                ids = rows[batch]
                used, local = np.unique(ids, return_inverse=True)
                local = local.reshape(ids.shape)
                if used[0] == 0:
                    used = used[1:]
                else:
                    local = local + 1
                used = used - 1
                upto = np.cumsum(sizes[used])
                take = np.arange(upto[-1] if len(used) else 0) + np.repeat(first[used] - upto + sizes[used], sizes[used])
                x = model.inputs(word[used], flat[take], sizes[used])
                grads, d_x = model.gradients(x, model.gates(x), local, target[batch])
                grads["word"], grads["gram"] = np.zeros_like(model.p["word"]), np.zeros_like(model.p["gram"])
                if len(used):
                    grads["word"] = _sum_rows(word[used], d_x[:, 3 : 3 + DIM], len(grads["word"]))
                    spread = np.repeat(d_x[:, 3 + DIM :] / sizes[used][:, None], sizes[used], axis=0)
                    grads["gram"] = _sum_rows(flat[take], spread, len(grads["gram"]))
                grads["word"][0] = grads["gram"][0] = 0
                step += 1
                for k, g in grads.items():  # Adam
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    model.p[k] -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1 (null ids count as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on a bounded sample of the labelled documents that are not held out."""
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    # an id with both labels counts as toxic
    marked = marked.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.md5(F.col("label_id").cast("string").cast("binary")), "label_id"))
    # the window keeps only the first rows of each label; ids alone are ranked, texts join later
    chosen = marked.withColumn("place", place).where(F.col("place") <= rows).drop("place")
    usable = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    # an id that many rows repeat gives one text, so the sample's bound holds
    sample = (
        usable.join(F.broadcast(chosen), usable["doc_id"] == chosen["label_id"])
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
    )
    sample = sorted(sample.collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in sample], [r["toxic"] for r in sample])


def _score_batches(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            made = pa.array(scorer.scores(text.as_py() for text in texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "score"])

    return score


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the document's columns but the text), ``text`` and ``score`` for every document.

    Null and empty texts, and texts without letters, get the score of an empty window. Rows are scored apart from each
    other, so repeats get equal scores. Only the text is an input.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = F.struct(*[named(docs, c) for c in docs.columns if c != "text"]).alias("row")
    inputs = docs.select(rest, "text")
    schema = T.StructType([*inputs.schema.fields, T.StructField("score", T.DoubleType())])
    return inputs.mapInArrow(_score_batches(sent), schema)
