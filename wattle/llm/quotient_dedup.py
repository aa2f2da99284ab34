"""Exact de-duplication with counting quotient filters.

Texts are equal when they are the same after deleting ASCII white space.  Pass one
hashes every text to 64 bits.  Each task turns its fingerprints into counting quotient
filters, one for each block of the hash space: a fingerprint's high bits are its quotient, stored
as a unary run length, and the low bits its remainder, stored sorted in the run
with a counter.  The filters of a block merge without loss by walking their sorted
remainders; a block holds a bounded share of all fingerprints, and a text that a third of
all rows repeat is one entry with a counter in each task's filter.

Only fingerprints counted more than once go on: pass two reads the texts again,
lets through those whose fingerprint may be among them (a bitmap of bounded size), and groups
them by their bytes.  Grouping combines equal texts within a task before the shuffle.

Defined results: null text counts as empty; of equal texts the row with the most code
points stays, then the smallest id, a null id last, then the first row read; of repeated rows
one stays; an empty table gives an empty one; other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattle.llm.common import binary_values, bound_batches, key_bitmap, materialize, may_contain, shielded, SPACE, tidy
from wattle.llm.registry import register, table


def quotient_bits_for(n: int, bits: int) -> int:
    """Quotient bits of a filter of n fingerprints: runs of one remainder or less on average."""
    return min(max(n - 1, 1).bit_length(), bits)


def _width(bits: int) -> int:
    return max((bits + 7) // 8, 1)


def _walked(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct values with their counts as one: every value of y takes its place among those of x."""
    at = np.searchsorted(x, y)
    both = np.zeros(len(y), bool)
    inside = at < len(x)
    both[inside] = x[at[inside]] == y[inside]
    m = m.copy()
    m[at[both]] += n[both]
    place = at[~both] + np.arange(len(y) - int(both.sum()))
    old = np.ones(len(x) + len(place), bool)
    old[place] = False
    values, counts = np.empty(len(old), x.dtype), np.empty(len(old), m.dtype)
    values[old], values[place], counts[old], counts[place] = x, y[~both], m, n[~both]
    return values, counts


class QuotientFilter:
    """A counting quotient filter over ``bits``-bit fingerprints with ``quotient_bits`` of them as quotient.

    ``runs[q]`` is the number of remainders in the run of quotient q; ``remainders`` holds the
    runs one after the other, each sorted, and ``counts`` how often each fingerprint was added.
    """

    def __init__(self, quotient_bits: int, bits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits, self.bits = quotient_bits, bits
        self.runs, self.remainders, self.counts = runs, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, quotient_bits: int, bits: int, counts: np.ndarray | None = None) -> QuotientFilter:
        found, at = np.unique(fingerprints, return_inverse=True)
        n = np.bincount(at, counts, len(found)).astype(np.uint64) if len(found) else np.zeros(0, np.uint64)
        return cls._of_sorted(found, n, quotient_bits, bits)

    @classmethod
    def _of_sorted(cls, found: np.ndarray, counts: np.ndarray, quotient_bits: int, bits: int) -> QuotientFilter:
        low = np.uint64(bits - quotient_bits)
        runs = np.bincount((found >> low).astype(np.int64), minlength=1 << quotient_bits)
        return cls(quotient_bits, bits, runs, found & ((np.uint64(1) << low) - np.uint64(1)), counts)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        return quotients << np.uint64(self.bits - self.quotient_bits) | self.remainders

    def count(self, fingerprint: int) -> int:
        low = self.bits - self.quotient_bits
        q = fingerprint >> low
        start = int(self.runs[:q].sum())
        run = self.remainders[start:start + int(self.runs[q])]
        at = int(np.searchsorted(run, fingerprint & (1 << low) - 1))
        return int(self.counts[start + at]) if at < len(run) and int(run[at]) == fingerprint & (1 << low) - 1 else 0

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Sum of filters over the same bits, two and two by walking their sorted (quotient, remainder) runs; nothing is
        lost, as the remainders are whole.  The sum has as many quotients as fingerprints, to a power of two."""
        bits = filters[0].bits
        parts = [(f.fingerprints(), f.counts) for f in filters]
        while len(parts) > 1:
            parts = [_walked(*parts[i], *parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        values, counts = parts[0]
        return cls._of_sorted(values, counts, quotient_bits_for(len(values), bits), bits)

    def to_bytes(self) -> bytes:
        """Unary runs (a 1 for each remainder, a 0 after each run), remainders in whole bytes, counters as bytes or, past 254, 64 bits."""
        ones = np.zeros(len(self.remainders) + len(self.runs), np.uint8)
        ones[np.arange(len(self.remainders)) + np.repeat(np.arange(len(self.runs)), self.runs)] = 1
        width = _width(self.bits - self.quotient_bits)
        large = self.counts > 254
        head = np.array([self.quotient_bits, self.bits, len(self.remainders)], "<i4")
        return b"".join([head.tobytes(), np.packbits(ones).tobytes(), self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(),
                         np.where(large, 255, self.counts).astype(np.uint8).tobytes(), self.counts[large].astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        quotient_bits, bits, n = (int(x) for x in np.frombuffer(data, "<i4", 3))
        at, total = 12, n + (1 << quotient_bits)
        ones = np.unpackbits(np.frombuffer(data, np.uint8, (total + 7) // 8, at))[:total]
        at += (total + 7) // 8
        runs = np.diff(np.flatnonzero(ones == 0), prepend=-1) - 1
        width = _width(bits - quotient_bits)
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        remainders = whole.view("<u8").ravel().astype(np.uint64)
        at += n * width
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.uint64)
        counts[counts == 255] = np.frombuffer(data, "<u8", int((counts == 255).sum()), at + n)
        return cls(quotient_bits, bits, runs, remainders, counts)


def _hashes(column: pa.Array) -> Iterator[tuple[bytes, int, bytes]]:
    """(text without white space, 64-bit fingerprint as signed integer, SHA-256) of each value."""
    offsets, data = binary_values(column)
    whole = memoryview(data)
    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = bytes(whole[i:j]).translate(None, SPACE)
        fp = xxhash.xxh64_intdigest(text)
        yield text, fp - (1 << 64) if fp >> 63 else fp, hashlib.sha256(text).digest()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one, a written table: (rid, id, n_chars, fp, sha) of each row."""
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                     F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("n_chars"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("fp", T.LongType()), T.StructField("sha", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [(fp, sha) for _, fp, sha in _hashes(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.binary())], names=schema.names)

    return materialize(bound_batches(rows).mapInArrow(tidy(run), schema), "dedup-fingerprints")


#: Fingerprints per block of the hash space, on average; and blocks at least.
BLOCK_SIZE, LEAST_BLOCKS = 1 << 18, 256


def repeated_fingerprints(hashed: DataFrame, block_bits: int | None = None) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once, through merged filters."""
    if block_bits is None:
        blocks = max(LEAST_BLOCKS, hashed.count() // BLOCK_SIZE)
        block_bits = (blocks - 1).bit_length()
    bits = 64 - block_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, list[QuotientFilter]] = {}
        for b in batches:
            values = np.sort(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            block = (values >> np.uint64(bits)).astype(np.int64)
            values &= (np.uint64(1) << np.uint64(bits)) - np.uint64(1)
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=1 << 62))
            for s, e in zip(cuts[:-1], cuts[1:]):
                filters.setdefault(int(block[s]), []).append(QuotientFilter.build(values[s:e], quotient_bits_for(int(e - s), bits), bits))
            for k, found in filters.items():
                if len(found) > 8:
                    filters[k] = [QuotientFilter.merge(found)]
        data = [QuotientFilter.merge(f).to_bytes() for f in filters.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(filters), pa.int64()), pa.array(data, pa.binary())], names=["block", "filter"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = QuotientFilter.merge([QuotientFilter.from_bytes(x) for x in rows["filter"]])
        many = whole.counts > 1
        fp = (whole.fingerprints()[many] | np.uint64(int(key[0]) << bits)).view(np.int64)
        return pd.DataFrame({"fp": fp, "n": whole.counts[many].astype(np.int64)})

    filters = hashed.select("fp").mapInArrow(build, "block bigint, filter binary")
    return filters.groupBy("block").applyInPandas(merge, "fp bigint, n bigint")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, sha) of each row, sha the binary SHA-256 of its normalised text."""
    hashed = fingerprints(df, id_col, text_col)
    repeated = materialize(repeated_fingerprints(hashed), "dedup-repeated")
    # the rows to choose from, slim; combined within tasks first, so a hot text is a row per task
    order = F.struct((-F.col("n_chars")).alias("short"), F.col("id").isNull().alias("no_id"), F.col("id").alias("_id"), F.col("rid").alias("_rid"))
    groups = (hashed.join(repeated.select("fp"), "fp", "left_semi")
              .groupBy("sha").agg(F.min(order).alias("best"), F.count("*").alias("rows")))
    verified = _verified(df, text_col, repeated)
    # every class must be one text, byte for byte, in as many rows
    true_class = (F.col("texts") == 1) & (F.col("rows") == F.col("found"))
    groups = groups.join(verified, "sha", "left").select(
        "sha", "best", F.when(F.coalesce(true_class, F.lit(False)), F.col("rows")).otherwise(F.raise_error(F.lit("different texts share a digest"))).alias("rows"))
    # written, so that the join below reads both sides from plain exchanges and Spark can split a hot class
    groups = materialize(groups, "dedup-groups")
    both = hashed.join(groups, "sha", "left")
    keeper = F.col("best").isNotNull()
    return both.select("id", F.when(keeper, F.col("best._id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("bigint").alias("group_size"),
                       F.when(keeper, F.col("rid") == F.col("best._rid")).otherwise(True).alias("kept"), "sha")


def _verified(df: DataFrame, text_col: str, repeated: DataFrame) -> DataFrame:
    """(sha, texts, found): number of different texts, and of rows, of each digest that repeats."""
    bitmap = df.sparkSession.sparkContext.broadcast(key_bitmap(repeated, "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_hashes(b.column(0)))
            keep = may_contain(bitmap.value, np.array([r[1] for r in rows], np.int64)) if rows else []
            rows = [r for r, k in zip(rows, keep) if k]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()),
                                              pa.array([r[0] for r in rows], pa.binary())], names=["fp", "sha", "bytes"])

    routed = df.select(F.col(text_col).cast("binary")).mapInArrow(tidy(run), "fp bigint, sha binary, bytes binary")
    # equal bytes are combined within each task, so no text is moved once per copy
    texts = routed.groupBy("sha", "bytes").agg(F.count("*").alias("found"))
    return texts.groupBy("sha").agg(F.count("*").alias("texts"), F.sum("found").alias("found"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each class of equal texts, all its columns unchanged.

    Rows whose fingerprint occurs once pass straight through; only the others are grouped, by bytes.
    """
    own = df.columns
    df, (id_col, text_col) = shielded(df, id_col, text_col)
    names = df.columns
    repeated = materialize(repeated_fingerprints(fingerprints(df, id_col, text_col)), "dedup-repeated")
    bitmap = df.sparkSession.sparkContext.broadcast(key_bitmap(repeated, "fp"))

    schema = T.StructType([*df.schema.fields, T.StructField("_maybe", T.BooleanType()), T.StructField("_bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_hashes(b.column(text_col)))
            maybe = may_contain(bitmap.value, np.array([r[1] for r in rows], np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe), pa.array([r[0] if k else None for r, k in zip(rows, maybe)], pa.binary())], names=schema.names)

    marked = bound_batches(df).mapInArrow(tidy(run), schema)
    order = F.struct(-F.coalesce(F.length(text_col), F.lit(0)), F.col(id_col).isNull(), F.col(id_col), F.col(text_col))
    best = marked.filter("_maybe").groupBy("_bytes").agg(F.min_by(F.struct(*names), order).alias("_row")).select("_row.*")
    return marked.filter("not _maybe").select(*names).unionByName(best).toDF(*own)


@register("op5_quotient_dedup", r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
g AS (SELECT t, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""")
def op5_quotient_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
