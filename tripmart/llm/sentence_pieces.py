"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of the model holds a whitespace marker behind another character, no merge crosses the place in
front of a marker, so a text's ids are those of its chunks (markers and the word behind them), one after the other. Words
follow Zipf's law: each task keeps a table of the distinct chunks it has met, lets the library segment only new ones,
and gathers the ids of a text from the table by position. Nothing is shuffled: a table for the whole corpus would send every
word over the network to save the segmentation of a few. The table is dropped when it is full, so memory is
bounded; that changes no result. For a model whose pieces may cross markers, whole texts are the chunks.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.llm.common import named

MARKER = "▁"
TABLE_CHUNKS = 300_000
TABLE_CHARACTERS = 20_000_000
SEGMENTED = 2_000  # chunks that one call of the library segments
GROUP_CHARACTERS = 2_000_000  # texts that are looked up together

_CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")
_CROSSING = re.compile(f"[^{MARKER}]{MARKER}")
# Blanks at the ends and doubled, a ligature, a wide letter, a composable accent, control characters.
_PROBE = "  ﬁx Ａ  é\t\r\n\x01 "


def has_separable_chunks(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether the ids of a text are those of its chunks: texts are only marked, and no piece crosses a marker."""
    marked = processor.normalize(_PROBE) == MARKER + _PROBE.replace(" ", MARKER)
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    known = processor.piece_to_id(MARKER) != processor.unk_id()
    return marked and known and not any(_CROSSING.search(piece) for piece in pieces)


class _Codes(dict):
    """Numbers chunks in the order in which they are first asked for."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        return code


class ChunkTable:
    """The ids of each distinct chunk, segmented once."""

    def __init__(self, processor: sentencepiece.SentencePieceProcessor, max_chunks: int = TABLE_CHUNKS):
        self.processor, self.max_chunks = processor, max_chunks
        self.separable = has_separable_chunks(processor)
        self.lone_marker = [processor.piece_to_id(MARKER)]
        self._clear()

    def _clear(self) -> None:
        self.codes, self.characters = _Codes(), 0
        self.ids, self.ends = array("i"), array("q", [0])

    def _chunks(self, text: str) -> list[str]:
        """Chunks, each without its first marker; blanks of the text are markers."""
        if not text:
            return []
        if not self.separable:
            return [text]
        if "  " in text or text[0] == " " or MARKER in text:
            return [chunk[1:] for chunk in _CHUNK.findall(MARKER + text.replace(" ", MARKER))]
        return text.split(" ")  # nothing but single blanks between words: one marker each

    def _add(self, chunks: list[str]) -> None:
        """Segment chunks and append their ids to the table; a few thousand at a time, so that the lists die young."""
        for at in range(0, len(chunks), SEGMENTED):
            part = chunks[at : at + SEGMENTED]
            # The library adds the first marker itself, but none to an empty text.
            for chunk, ids in zip(part, self.processor.encode(part, num_threads=1), strict=True):
                self.ids.extend(ids if chunk else self.lone_marker)
                self.ends.append(len(self.ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the bounds of each text in it."""
        if len(self.codes) > self.max_chunks or self.characters > TABLE_CHARACTERS:
            self._clear()
        known, codes, counts = len(self.codes), [], [0]
        for text in texts:
            codes += map(self.codes.__getitem__, self._chunks(text))
            counts.append(len(codes))
        fresh = list(islice(self.codes, known, None))
        self._add(fresh)
        self.characters += sum(map(len, fresh))
        table, ends = np.array(self.ids, np.int32), np.array(self.ends, np.int64)
        code = np.array(codes, np.int64)
        first, length = ends[code], ends[code + 1] - ends[code]
        bounds = np.concatenate([[0], np.cumsum(length)])
        return table[np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], length)], bounds[counts]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about GROUP_CHARACTERS in sum; a longer text is a group of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > GROUP_CHARACTERS:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _encoder(model, name: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(sentencepiece.SentencePieceProcessor(model_proto=model.value))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            texts = [text or "" for text in texts]
            for start, end in _groups(texts):
                ids, bounds = table.encode(texts[start:end])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, name])

    return encode


def _decoder(model, name: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [processor.decode(ids or []) for ids in lists.slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, name])

    return decode


def _model_bytes(df: DataFrame, model: str):
    """The model file at ``model`` on the driver (half a megabyte), sent to the executors once."""
    with open(model, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_texts(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names), and ``ids``: the text's ids as the library gives them.

    Ids have neither begin nor end marks and are not sampled. Null and empty texts have none; repeated rows stay; texts of
    any length are encoded whole; an empty table gives no rows. The row's struct holds every column but ``text``, which stands beside it.
    """
    rest = [named(docs, c) for c in docs.columns if c != text]
    inputs = docs.select(F.struct(*rest).alias("row"), named(docs, text).alias("text"))
    schema = T.StructType([*inputs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return inputs.mapInArrow(_encoder(_model_bytes(docs, model), "ids"), schema)


def decode_ids(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``row`` (all columns but ``ids``), ``ids`` and ``decoded``, the text that the library decodes them to.

    Null and empty lists decode to the empty text; ids outside the model fail in the library, by number.
    """
    rest = [named(encoded, c) for c in encoded.columns if c != ids]
    inputs = encoded.select(F.struct(*rest).alias("row"), named(encoded, ids).alias("ids"))
    schema = T.StructType([*inputs.schema.fields, T.StructField("decoded", T.StringType())])
    return inputs.mapInArrow(_decoder(_model_bytes(encoded, model), "decoded"), schema)
