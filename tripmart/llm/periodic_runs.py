"""Periodic runs of words, found by internal pattern matching.

A run of period q that is at least four periods long contains a whole dyadic block of b = 2^k words, for the k with (2b - 1) / 3 <= q
< (4b - 1) / 3, and the block occurs again q words later. The starts to look at span less than b / 2 + 2 words, so the
occurrences there form an arithmetic progression: one or two of them are candidates themselves; three or more share a
smaller period, and then the stretches of that period around the block and around its occurrence end exactly q words apart.

* Ranks of all substrings of 2^k words come from prefix doubling; only groups of equal substrings go on. Ranks are
  those within a document, so documents are sorted together in one numpy pass and never meet.
* Occurrences in a window: range count and range successor in a wavelet tree over the suffix array.
* A candidate is confirmed exactly: both ends are extended by comparing ranks of halving length.

Each document is worked on in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.llm.common import named

LEAST_WORDS = 6
LEAST_PERIODS = 4
GROUP_WORDS = 300_000  # documents that are sorted together

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _first_period(block: int) -> int:
    """The smallest period that blocks of this length stand for."""
    return (2 * block + 1) // 3


class _Blocks:
    """Aligned blocks with at least two occurrences: position, length, and their interval of the suffix array."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, at: np.ndarray, block: int, low: np.ndarray, high: np.ndarray) -> None:
        take = (high - low >= 2) & (at % block == 0)
        self.parts.append((at[take], np.full(take.sum(), block), low[take], high[take]))

    def arrays(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.parts, strict=True)]


def _doubling(codes: np.ndarray, end: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray], _Blocks, np.ndarray]:
    """Suffix array, ranks of the substrings of 1, 2, 4, ... words, blocks, and the slots that blocks may lie in.

    ``end``: for each position the end of its document. A substring that its document cuts short has a rank of its own. The order is refined
    only as far as blocks for periods up to ``longest`` / LEAST_PERIODS need it.
    """
    n = len(codes)
    sa = np.argsort(codes)
    slots, at, key = np.arange(n), sa, codes[sa]
    rank = np.empty(n, np.int32)
    levels: list[np.ndarray] = []
    blocks, alive = _Blocks(), np.zeros(n, bool)
    block = 1
    while True:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(cut, len(key)))
        low = np.repeat(slots[cut], size)
        rank = rank.copy()
        rank[at] = low
        levels.append(rank)
        size = np.repeat(size, size)
        if block == 2:
            alive[slots[size >= 2]] = True
        if block > 1:
            blocks.add(at, block, low, low + size)
        shared = size > 1
        slots, at = slots[shared], at[shared]
        if not len(at) or LEAST_PERIODS * _first_period(2 * block) > longest:
            return sa, levels, blocks, alive
        after = at + block
        follows = after < end[at]
        key = rank[at] * np.int64(n + 1)
        key[follows] += 1 + rank[after[follows]]
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        block *= 2


class WaveletTree:
    """Range counting and range selection over a permutation of 0..m-1, a level for each bit."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, len(values).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            ones = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]))
            values = np.concatenate([values[~ones], values[ones]])

    def _children(self, zeros, low, high):
        low0, high0 = zeros[low], zeros[high]
        return low0, high0, zeros[-1] + low - low0, zeros[-1] + high - high0

    def count_below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in each interval of slots are smaller than ``bound`` (at most m)."""
        total = np.zeros(len(low), np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            low0, high0, low1, high1 = self._children(zeros, low, high)
            one = (bound >> bit & 1).astype(bool)
            total += np.where(one, high0 - low0, 0)
            low, high = np.where(one, low1, low0), np.where(one, high1, high0)
        return total

    def select(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) in each interval: the successor of a bound that has k values below it."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            low0, high0, low1, high1 = self._children(zeros, low, high)
            one = k >= high0 - low0
            k = np.where(one, k - (high0 - low0), k)
            value |= one.astype(np.int64) << bit
            low, high = np.where(one, low1, low0), np.where(one, high1, high0)
        return value


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, backward: bool = False) -> np.ndarray:
    """Number of equal words from each a and b (a < b) on, or before them: steps of halving length while ranks agree."""
    n, total = len(levels[0]), np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        step = 1 << k
        while True:
            i, j = (a - total - step, b - total - step) if backward else (a + total, b + total)
            inside = (i >= 0) & (j < n)
            same = inside & (levels[k][np.where(inside, i, 0)] == levels[k][np.where(inside, j, 0)])
            total += step * same
            if k < len(levels) - 1 or not same.any():
                break
    return total


def _candidates(sa, levels, blocks: _Blocks, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods that the occurrences of each block in its window call for."""
    at, block, low, high = blocks.arrays()
    slot = np.concatenate([[0], np.cumsum(alive)])
    low, high = slot[low], slot[high]
    positions = np.sort(sa[alive])  # values of the tree are places in this list
    tree = WaveletTree(np.searchsorted(positions, sa[alive]))
    first, last = at + (2 * block + 1) // 3, at + (4 * block + 1) // 3 - 1
    before = tree.count_below(low, high, np.searchsorted(positions, first))
    found = tree.count_below(low, high, np.searchsorted(positions, last + 1)) - before

    def occurrence(which: np.ndarray, k: int) -> np.ndarray:
        return positions[tree.select(low[which], high[which], before[which] + k)]

    one, two, many = np.flatnonzero(found >= 1), np.flatnonzero(found == 2), np.flatnonzero(found >= 3)
    next_one, next_two = occurrence(one, 0), occurrence(two, 1)
    start, head = at[many], occurrence(many, 0)
    step = occurrence(many, 1) - head
    # where the stretches with the smaller period end, around the block and around its first occurrence
    shift = (head + _common(levels, head, head + step)) - (start + _common(levels, start, start + step))
    single = found[one] < 3
    where = np.concatenate([at[one][single], at[two], start])
    period = np.concatenate([(next_one - at[one])[single], next_two - at[two], shift])
    return where[period > 0], period[period > 0]


def find_runs(documents: list[list], least_words: int = LEAST_WORDS) -> list[np.ndarray]:
    """For each list of words its maximal runs of at least LEAST_PERIODS periods and ``least_words`` words: rows of start, length, period.

    Rows stand by start, then period. Words are compared for equality only.
    """
    lengths = np.array([len(words) for words in documents], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    none = np.zeros((0, 3), np.int64)
    if not len(lengths) or lengths.max() < least_words:
        return [none] * len(documents)
    codes, n_codes = [], 0
    for words in documents:  # a document's words have codes of their own
        code: dict = {}
        codes += [code.setdefault(word, n_codes + len(code)) for word in words]
        n_codes += len(code)
    sa, levels, blocks, alive = _doubling(np.array(codes, np.int64), np.repeat(bounds[1:], lengths), int(lengths.max()))
    if not alive.any():
        return [none] * len(documents)
    at, period = _candidates(sa, levels, blocks, alive)
    inside = at + period < bounds[-1]
    at, period = at[inside], period[inside]
    start = at - _common(levels, at, at + period, backward=True)
    stop = at + period + _common(levels, at, at + period)
    long = stop - start >= np.maximum(least_words, LEAST_PERIODS * period)
    start, stop, period = start[long], stop[long], period[long]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    # several periods of one stretch are multiples of the smallest
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])]) if len(start) else np.zeros(0, bool)
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    start, stop, period = start[order], stop[order], period[order]
    cut = np.searchsorted(start, bounds)
    return [
        np.column_stack([start[a:b] - base, (stop - start)[a:b], period[a:b]])
        for a, b, base in zip(cut[:-1], cut[1:], bounds[:-1], strict=True)
    ]


def collapse(words: list, runs: np.ndarray) -> list:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [word for word, inside in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not inside]


Rewrite = Callable[[object, list[bytes]], list[bytes]]


def _run_batches(names: list[str], rewrite: Rewrite | None, key: str):
    def solve(part: pa.RecordBatch, documents: list[list[bytes]]) -> pa.RecordBatch:
        found = find_runs(documents)
        offsets = np.concatenate([[0], np.cumsum([len(runs) for runs in found])])
        flat = np.concatenate(found)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
        kept = [b" ".join(collapse(words, runs)).decode() for words, runs in zip(documents, found, strict=True)]
        sizes = pa.array([len(words) for words in documents], pa.int64())
        columns = [part.column(part.schema.get_field_index("row")), sizes, lists, pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            ids = batch.column(batch.schema.get_field_index("row")).field(key) if rewrite else texts
            start, documents, size = 0, [], 0
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()  # of bytes: at ASCII white space only
                if rewrite:
                    words = rewrite(ids[i].as_py(), words)
                documents.append(words)
                size += len(words)
                if size >= GROUP_WORDS:
                    yield solve(batch.slice(start, i + 1 - start), documents)
                    start, documents, size = i + 1, [], 0
            if documents:
                yield solve(batch.slice(start), documents)

    return run


def periodic_runs(docs: DataFrame, text: str = "text", rewrite: Rewrite | None = None, key: str = "doc_id") -> DataFrame:
    """``row`` (the columns but the text), ``n_words``, ``runs`` (start, length, period by start and period), ``collapsed``.

    ``collapsed`` are the words that no run holds after its first period, joined by blanks. Words are
    separated by ASCII white space. Null and empty texts have no words and no runs; repeated rows give the same again; a text of any length
    is one document; an empty table gives no rows. ``rewrite(key, words)`` may replace the words beforehand.
    """
    rest = [named(docs, c) for c in docs.columns if c != text]
    inputs = docs.select(F.struct(*rest).alias("row"), named(docs, text).alias("text"))
    schema = T.StructType([
        inputs.schema["row"], T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType()),
    ])
    return inputs.mapInArrow(_run_batches(schema.names, rewrite, key), schema)
