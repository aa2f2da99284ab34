"""SentencePiece encoding and decoding through a distinct-chunk table.

When no piece crosses a white-space marker, a text falls into chunks (a run of
markers and what follows up to the next run) that the model segments
independently.  Each task keeps a table of the distinct chunks it has met:
every one is segmented, and its ids decoded, once by the library; a text's ids
are then the chunks' rows of the table, joined by position with one ragged
gather.  The table is dropped and started anew at ``max_chunks`` entries, which
bounds a task's memory and changes no result.

Defined results: null text counts as empty (only begin and end ids, decoded to
the empty text); repeated rows give equal rows; an empty table gives an empty
one; a text column or result names that clash with other columns raise
``ValueError``; any other column passes through untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattle.llm.common import binary_values, bound_batches, ragged, slices, tidy
from wattle.llm.registry import register, table

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Bytes of text that are split and gathered at once.
BLOCK = 2 << 20


def check_model(model: bytes) -> None:
    """Raise unless pieces cannot cross markers and texts only gain a leading marker, so that chunks are independent."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece of this model crosses a white-space marker")
    # a normaliser that drops or rewrites characters shows in one of these
    for probe in ("a", " a  b ", "\n\t x", "ﬁ Å ½ é e\u0301 ａ"):
        if sp.decode(sp.encode(probe)) != probe or not sp.encode(probe, out_type=str)[0].startswith(MARK):
            raise ValueError("needs a model that only adds a leading marker and escapes spaces")


#: Characters of the chunks that a table holds, at most, besides those of the texts at hand.
MOST_TEXT = 1 << 24


class ChunkTable(dict):
    """chunk -> row number; ``ids`` of row i are ``flat[start[i]:start[i] + length[i]]``."""

    def __init__(self, model: bytes, max_chunks: int = 200_000):
        import sentencepiece

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.mark_id = self.sp.piece_to_id(MARK)
        self.max_chunks = max_chunks
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.held = 0
        self.pending: list[str] = []
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.decoded: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = row = len(self)
        self.held += len(chunk)
        self.pending.append(chunk)
        return row

    def segment_pending(self) -> None:
        """Segment the new chunks and decode their ids, each once."""
        if not self.pending:
            return
        # the library puts one marker in front of each text; it adds none to an empty one
        ids = self.sp.encode([c[1:] for c in self.pending], num_threads=1)
        ids = [x or [self.mark_id] for x in ids]
        self.decoded += [" " + x for x in self.sp.decode(ids, num_threads=1)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        first, n, more = len(self.decoded) - len(ids), len(ids), int(lengths.sum())
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.start):
            self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
        self.flat[self.used:self.used + more] = np.fromiter((i for x in ids for i in x), np.uint32, more)
        self.start[first:first + n] = self.used + np.cumsum(lengths) - lengths
        self.length[first:first + n] = lengths
        self.used += more
        self.pending = []

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """(ids without begin and end, text decoded from them) of each text."""
        if len(self) > self.max_chunks or self.held > MOST_TEXT:
            self.reset()
        look = self.__getitem__
        rows = [list(map(look, _CHUNK.findall(MARK + t.replace(" ", MARK)))) if t else [] for t in texts]
        self.segment_pending()
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        codes = np.fromiter((c for r in rows for c in r), np.int64, int(counts.sum()))
        lengths = self.length[codes]
        ids = self.flat[ragged(self.start[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        decoded = self.decoded
        for i, row in enumerate(rows):
            yield ids[ends[i]:ends[i + 1]], "".join([decoded[c] for c in row])[1:]


def _add(df: DataFrame, names: list[str]) -> None:
    if clash := sorted({c.lower() for c in df.columns} & {n.lower() for n in names}):
        raise ValueError(f"columns would clash: {clash}")


def encode(df: DataFrame, model: bytes, text_col: str = "text", ids_col: str | None = "ids", begin: bool = True, end: bool = True,
           max_chunks: int = 200_000, keep_text: bool = True) -> DataFrame:
    """``df`` with n_tokens, ids_sha256, decoded_sha256 and, unless ``ids_col`` is None, the ids.

    ``keep_text=False`` leaves the text column out of the result.
    """
    check_model(model)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids_col:
        added.append(T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)))
    _add(df, [f.name for f in added])
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*kept, *added])
    order = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model, max_chunks)
        one = np.array([chunks.sp.bos_id()] * begin, np.uint32), np.array([chunks.sp.eos_id()] * end, np.uint32)
        for batch in batches:
            offsets, _ = binary_values(batch.column(text_col))
            texts = batch.column(text_col)
            for i, j in slices(offsets, BLOCK):
                part = batch.slice(i, j - i)
                counts, ids_hex, text_hex, all_ids = [], [], [], []
                for ids, text in chunks.encode([t or "" for t in texts.slice(i, j - i).to_pylist()]):
                    ids = np.concatenate([one[0], ids, one[1]])
                    counts.append(len(ids))
                    ids_hex.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                    text_hex.append(hashlib.sha256(text.encode()).hexdigest())
                    if ids_col:
                        all_ids.append(ids.astype(np.int32))
                columns = [part.column(n) for n in order] + [pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
                if ids_col:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, np.concatenate(all_ids)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return bound_batches(df).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text the library decodes from each id array (null ids: null)."""
    _add(df, [out_col])

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for ids in batches:
            yield pd.Series([None if x is None else sp.decode([int(i) for i in x]) for x in ids], dtype=object)

    return df.withColumn(out_col, text_of(F.col(ids_col)))


def load_model(path: str | None = None) -> bytes:
    """The model's bytes, read on the driver and shipped to tasks in the function's closure."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


@register("op1_sentencepiece_chunks")
def op1_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, load_model(), ids_col=None, keep_text=False)
