"""Token-id files with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by id, tokenised, and written as segments: each
segment is one concatenated id array (16 bits an id where the vocabulary allows it), and two Elias-Fano sequences,
the documents' ids and their ends: the low bits of every value packed, the high bits
in unary, about 2 + log2(ids / documents) bits a document instead of a 64-bit table.  A
sampled select index gives any document's offsets without decoding the rest, and reading goes through it in blocks of documents.  Segments are binary rows
of a Parquet table, so writing, retries and reading work on any store Spark can reach.

Words are tokenised through a table of distinct pre-tokens, like the library would: lower-cased
Latin text is cut by the tokenizer's own pattern, every distinct piece is encoded by the library
once, and everything else (other scripts, special tokens) goes to the library by white-space-delimited
chunks, which its pre-tokenizer never joins.

Defined results: null text counts as empty (only the end id); null ids come first; of
repeated ids the order is by the text's hash, then the text; ids 2 ** 62 or more apart in one segment are kept in 64 bits each;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattle.llm.common import binary_values, bound_batches, ragged, slices
from wattle.llm.registry import register, table
from wattle.session import scratch_path

# ----------------------------------------------------------------------------- Elias-Fano

SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of n integers below or equal to ``top``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        values = values.astype(np.int64)
        n = len(values)
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(top >> low_bits) + n + 1, np.uint8)
        bits[ones] = 1
        tail = np.empty((n, low_bits), np.uint8)
        for k in range(low_bits):
            tail[:, k] = values >> k & 1
        low = np.packbits(tail.ravel(), bitorder="little")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.int64))

    def between(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, found from the sample before the i-th one on; only the bits they lie in are looked at."""
        if j <= i:
            return np.zeros(0, np.int64)
        start, after = int(self.samples[i // SAMPLE]), (j - 1) // SAMPLE + 1
        end = int(self.samples[after]) + 1 if after < len(self.samples) else len(self.high) * 8
        first = start >> 3
        ones = np.flatnonzero(np.unpackbits(self.high[first:(end + 7) >> 3], bitorder="little")) + (first << 3)
        ones = ones[ones >= start][i % SAMPLE:][:j - i]
        out = (ones - np.arange(i, j)).astype(np.int64) << self.low_bits
        at = i * self.low_bits
        tail = np.unpackbits(self.low[at >> 3:(j * self.low_bits + 7) >> 3], bitorder="little")[at & 7:][:(j - i) * self.low_bits].reshape(j - i, self.low_bits)
        for k in range(self.low_bits):
            out |= tail[:, k].astype(np.int64) << k
        return out

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.between(i, i + 1)[0])

    def decode(self) -> np.ndarray:
        return self.between(0, self.n)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<i8")
        return b"".join([head.tobytes(), self.low.tobytes(), self.high.tobytes(), self.samples.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, low_bits, low, high, samples = (int(x) for x in np.frombuffer(data, "<i8", 5))
        return cls(n, low_bits, np.frombuffer(data, np.uint8, low, 40), np.frombuffer(data, np.uint8, high, 40 + low), np.frombuffer(data[40 + low + high:], "<i8", samples))


# ----------------------------------------------------------------------------- segments

MAGIC = b"EFTOK002"
#: Ids further apart than this are not Elias-Fano coded, so that all sums stay in 64 bits.
WIDEST = 1 << 62


def write_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: magic, sizes, document ids (ascending, nulls first), ends, ids; both sequences Elias-Fano coded."""
    ends = EliasFano.encode(np.cumsum(lengths), len(ids)).to_bytes()
    numbers = [d for d in doc_ids if d is not None]
    nulls = len(doc_ids) - len(numbers)
    if any(d is not None for d in doc_ids[:nulls]) or any(x > y for x, y in zip(numbers, numbers[1:])):
        raise ValueError("documents must come in ascending order of their ids, those without first")
    base, span = (numbers[0], numbers[-1] - numbers[0]) if numbers else (0, 0)
    coded = span < WIDEST
    names = EliasFano.encode(np.array(numbers, np.int64) - base, span).to_bytes() if coded else np.array(numbers, "<i8").tobytes()
    sizes = np.array([len(doc_ids), len(ids), ids.dtype.itemsize, nulls, base, coded, len(names), len(ends)], "<i8")
    return b"".join([MAGIC, sizes.tobytes(), names, ends, ids.astype(ids.dtype.newbyteorder("<")).tobytes()])


class Segment:
    """A segment read back; nothing is decoded until asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token segment")
        data = memoryview(data)
        self.n_docs, self.n_ids, width, self.n_nulls, self.base, coded, names, ends = (int(x) for x in np.frombuffer(data, "<i8", 8, 8))
        at = 72
        self.names = EliasFano.from_bytes(data[at:at + names]) if coded else np.frombuffer(data, "<i8", names // 8, at)
        at += names
        self.ends, at = EliasFano.from_bytes(data[at:at + ends]), at + ends
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def doc_ids(self, i: int = 0, j: int | None = None) -> pa.Array:
        """Ids of documents i to j - 1 (all)."""
        j = self.n_docs if j is None else j
        nulls = max(0, min(j, self.n_nulls) - i)
        x, y = max(i - self.n_nulls, 0), max(j - self.n_nulls, 0)
        found = self.names.between(x, y) + self.base if isinstance(self.names, EliasFano) else self.names[x:y]
        return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(found, pa.int64())])

    def edges(self, i: int, j: int) -> np.ndarray:
        """Start of document i, then the ends of documents i to j - 1."""
        return np.concatenate([[0], self.ends.between(0, j)]) if i == 0 else self.ends.between(i - 1, j)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, its offsets from two selects."""
        start, end = self.edges(i, i + 1).tolist()
        return self.ids[start:end]


# ----------------------------------------------------------------------------- tokenising

# lower-case Latin letters that normalisation leaves alone
_LETTERS = "a-zß-öø-įı-ňŊ-ž"
_SIMPLE = re.compile(f"[\\t-\\r -~{_LETTERS}]*")
# the tokenizer's own split pattern, over those letters
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[!-/:-@\\[-`{{-~]+")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER = "\0"
#: The pattern that the shortcut above stands for; another tokenizer goes by chunks only.
_KNOWN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


#: Characters of the pieces that a table holds, at most, besides those of the texts at hand.
MOST_TEXT = 1 << 24


class PieceTable(dict):
    """pre-token -> row; ids of row i are ``flat[start[i]:start[i] + length[i]]``."""

    def __init__(self, spec: str, most: int):
        import json

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_str(spec), most
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        parsed = json.loads(spec)
        steps = (parsed.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.known = (steps[0].get("pattern") or {}).get("Regex") == _KNOWN and parsed["model"].get("end_of_word_suffix") == "</w>"
        self.special = [t["content"] for t in parsed["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.held = 0
        self.pending: list[str] = []
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.rows = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def __missing__(self, piece: str) -> int:
        self[piece] = row = len(self)
        self.held += len(piece)
        self.pending.append(piece)
        return row

    def pieces(self, text: str) -> list[str]:
        low = text.lower()
        if self.known and _SIMPLE.fullmatch(low) and not any(s in text for s in self.special):
            return _PIECE.findall(low)
        out: list[str] = []
        for chunk in _CHUNK.findall(text):
            low = chunk.lower()
            if self.known and _SIMPLE.fullmatch(low) and not any(s in chunk for s in self.special):
                out += _PIECE.findall(low)
            else:
                out.append(_OTHER + chunk)
        return out

    def encode_pending(self) -> None:
        """Encode the new pieces: many simple ones as one text, cut again after each word's last token."""
        first, self.rows, pending, self.pending = self.rows, self.rows + len(self.pending), self.pending, []
        while self.rows > len(self.start):
            self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
        rows = range(first, self.rows)
        simple = [(r, p) for r, p in zip(rows, pending) if p[0] != _OTHER]
        for i in range(0, len(simple), 2000):
            at, part = zip(*simple[i:i + 2000])
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(self.ends[found]) + 1 if len(found) else found
            if len(cuts) == len(part) and cuts[-1] == len(found):
                self._store(np.array(at), np.diff(cuts, prepend=0), found)
            else:
                self._each(at, part)
        other = [(r, p[1:]) for r, p in zip(rows, pending) if p[0] == _OTHER]
        if other:
            self._each(*zip(*other))

    def _each(self, rows: tuple, pieces: tuple) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(list(pieces), add_special_tokens=False)]
        self._store(np.array(rows), np.fromiter(map(len, ids), np.int64, len(ids)), np.array([i for x in ids for i in x], np.int64))

    def _store(self, rows: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[rows], self.length[rows] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self) > self.most or self.held > MOST_TEXT:
            self.reset()
        look = self.__getitem__
        rows = [list(map(look, self.pieces(t))) if t else [] for t in texts]
        if self.pending:
            self.encode_pending()
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        codes = np.fromiter((c for r in rows for c in r), np.int64, int(counts.sum()))
        lengths = self.length[codes]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[ragged(self.start[codes], lengths)], np.diff(sums[edges])


_TABLES: dict[int, PieceTable] = {}


def piece_table(spec: str, most: int = 400_000) -> PieceTable:
    """The worker process's table for a tokenizer; it outlives the task, and at ``most`` pieces or MOST_TEXT characters starts anew."""
    key = hash(spec)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = PieceTable(spec, most)
    return _TABLES[key]


# ----------------------------------------------------------------------------- Spark

#: A segment is closed at so many ids.
SEGMENT_IDS = 1 << 22


def write_tokens(df: DataFrame, path: str, spec: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Tokenise ``df`` in ascending id order into the segment table at ``path``: (part, segment, n_docs, n_ids, data)."""
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the hash spreads and orders rows that share an id
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part = piece_table(spec), TaskContext.get().partitionId()
        kind = np.uint32 if pieces.wide else np.uint16
        last = np.array([] if end_id is None else [end_id], np.uint32)
        docs: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held, segment = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal docs, lengths, ids, held, segment
            data = write_segment(docs, np.concatenate(lengths), np.concatenate(ids))
            out = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([segment]), pa.array([len(docs)]), pa.array([held]), pa.array([data], pa.binary())], names=["part", "segment", "n_docs", "n_ids", "data"])
            docs, lengths, ids, held, segment = [], [], [], 0, segment + 1
            return out

        for b in batches:
            offsets, _ = binary_values(b.column(1))
            for i, j in slices(offsets, 4 << 20):
                found, counts = pieces.encode([t or "" for t in b.column(1).slice(i, j - i).to_pylist()])
                if end_id is not None:
                    found, counts = np.insert(found, np.cumsum(counts), last[0]), counts + 1
                docs += b.column(0).slice(i, j - i).to_pylist()
                lengths.append(counts)
                ids.append(found.astype(kind))
                held += len(found)
                if held >= SEGMENT_IDS:
                    yield close()
        if docs:
            yield close()

    bound_batches(rows).mapInArrow(run, "part bigint, segment bigint, n_docs bigint, n_ids bigint, data binary").write.parquet(path)


def _starts(segments: DataFrame) -> DataFrame:
    """(part, segment, first): ids before each segment, from sums of the parts (a row for each writing task) and within each part."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("segment"))), F.lit(0))
    return segments.select("part", "segment", own.alias("own")).join(parts, "part").select("part", "segment", (F.col("before") + F.col("own")).alias("first"))


#: Documents read from a segment at a time.
READ_DOCS = 1 << 12


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a segment table, from the segments' bytes."""
    segments = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, segment, data in zip(*(c.to_pylist() for c in b.columns)):
                s = Segment(data)
                for i in range(0, s.n_docs, READ_DOCS):
                    j = min(i + READ_DOCS, s.n_docs)
                    edges = s.edges(i, j)
                    at, n = edges - edges[0], j - i
                    ids = s.ids[edges[0]:edges[-1]].astype("<u4")
                    crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                    columns = [pa.array(np.full(n, part)), pa.array(np.full(n, segment)), s.doc_ids(i, j), pa.array(edges[:-1]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = dict.fromkeys(names, "bigint") | {"ids": "array<int>"}
    docs = segments.select("part", "segment", "data").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))
    found = docs.join(_starts(segments.select("part", "segment", "n_ids")), ["part", "segment"])
    return found.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def load_tokenizer(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


@register("op7_elias_fano_tokens")
def op7_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"llm/tokens-{uuid.uuid4().hex}")
    write_tokens(table(spark, sf_dir, "documents"), path, load_tokenizer())
    return read_tokens(spark, path, with_ids=False)
