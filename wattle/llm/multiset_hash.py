"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a line, or a sentence of one (what ends in line feeds or in ``. ! ?``), without the white space around
it.  A document's fingerprint sums over its paragraphs, whose order so does not matter, and has two parts:

* WIDE lanes of 64 bits of the paragraph's hash, modulo 2^64: equal for equal multisets, and else different but for a chance
  of 2^-256, however often a paragraph stands there;
* a sketch of LANES counters, each the sum of +1 or -1 by a bit of the hash.  Counters don't wrap (they hold 32 bits, and a text has fewer
  paragraphs).  The squared length of the difference of two sketches estimates the squared difference of the multisets,
  which gives their likeness, 1 - |a - b|^2 / (|a|^2 + |b|^2), cut to 0..1 (a standard error of about sqrt(2 / LANES)).

A paragraph is inserted or deleted by adding or subtracting its hash; equal texts have equal fingerprints.

Neighbours (the next document by ascending id) need no global sort in one place: approximate quantiles of
the ids, which are ids that occur, bound ranges; each range is sorted in a task of its own and also gets the first
document of the range after it.

Defined results: null text counts as empty (the zero vector, alike to itself by 1); null ids come first;
of rows that share an id the order is by text; a single document is its own next one; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle.llm.common import bound_batches, tidy
from wattle.llm.registry import register, table

LANES, WIDE = 256, 4
#: Up to and with the delimiters; the matches of a text cover it whole.
_PARAGRAPH = re.compile(r"[^\n.!?]*(?:[\n.!?]+|$)")


def paragraph_hash(paragraph: str) -> bytes:
    return hashlib.blake2b(paragraph.encode(), digest_size=LANES // 8 + 8 * WIDE).digest()


def hashes(parts: list[str]) -> list[bytes]:
    return [paragraph_hash(p) for p in map(str.strip, parts) if p]


def sums(groups: list[list[bytes]]) -> np.ndarray:
    """The sum of each group's hashes: WIDE lanes modulo 2^64, then the sketch, as int64."""
    counts = np.fromiter(map(len, groups), np.int64, len(groups))
    out = np.zeros((len(groups), WIDE + LANES), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        raw = np.frombuffer(b"".join(h for g in groups for h in g), np.uint8).reshape(-1, 8 * WIDE + LANES // 8)
        starts = (np.cumsum(counts) - counts)[some]
        out[some, :WIDE] = np.add.reduceat(np.ascontiguousarray(raw[:, :8 * WIDE]).view("<i8"), starts, axis=0)
        bits = np.unpackbits(raw[:, 8 * WIDE:], axis=1)
        out[some, WIDE:] = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) - counts[some, None]
    return out


def fingerprint(text: str | None) -> np.ndarray:
    return sums([hashes(_PARAGRAPH.findall(text or ""))])[0]


def insert(vector: np.ndarray, paragraph: str) -> np.ndarray:
    """Fingerprint after a paragraph is added; the wide lanes wrap, as they are modulo 2^64."""
    return vector + sums([hashes([paragraph])])[0]


def delete(vector: np.ndarray, paragraph: str) -> np.ndarray:
    return vector - sums([hashes([paragraph])])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints, row by row, by their sketches."""
    a, b = a[..., WIDE:].astype(np.float64), b[..., WIDE:].astype(np.float64)
    square = lambda v: (v ** 2).sum(axis=-1)
    total, apart = square(a) + square(b), square(a - b)
    return np.clip(1 - np.divide(apart, total, out=np.zeros_like(apart), where=total > 0), 0, 1)


def as_text(vector: np.ndarray) -> str:
    return base64.b64encode(vector[:WIDE].astype("<i8").tobytes() + vector[WIDE:].astype("<i4").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = base64.b64decode(text)
    return np.concatenate([np.frombuffer(raw, "<i8", WIDE), np.frombuffer(raw, "<i4", LANES, 8 * WIDE).astype(np.int64)])


def edit(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many first code points of the following text, or all."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def compare_neighbours(rows: list[tuple[str, str]]) -> tuple[list[int], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(n_chars, edited_sha256, fingerprints of text, edited and following text) of (text, following text) pairs.

    The edited text's fingerprint takes the paragraphs before the cut as they are; only those from the cut on are split anew.
    """
    own, changed = [], []
    n_chars, digests = [], []
    following: list[list[bytes]] = []
    known: dict[int, list[bytes]] = {}

    for text, after in rows:
        parts = _PARAGRAPH.findall(text)
        new = edit(text, after)
        cut, at, keep = len(text) - len(text) // 4, 0, 0
        # a paragraph that ends before the cut is followed by a kept code point, so it ends there in the edited text too
        while keep < len(parts) and at + len(parts[keep]) < cut:
            at += len(parts[keep])
            keep += 1
        head = hashes(parts[:keep])
        whole = head + hashes(parts[keep:])
        own.append(whole)
        changed.append(head + hashes(_PARAGRAPH.findall(new[at:])))
        n_chars.append(len(text))
        digests.append(hashlib.sha256(new.encode()).hexdigest())
        known[id(text)] = whole
    for _, after in rows:
        # usually the next row's own text
        following.append(known[id(after)] if id(after) in known else hashes(_PARAGRAPH.findall(after)))
    return n_chars, digests, sums(own), sums(changed), sums(following)


def _ranges(df: DataFrame, partitions: int) -> np.ndarray:
    """At most ``partitions`` ascending keys that occur, the smallest one first."""
    shares = [i / partitions for i in range(partitions)]
    found = df.agg(F.min("key").alias("least"), F.percentile_approx("key", shares, 10_000).alias("cuts")).first()
    return np.unique(np.array([found["least"], *(found["cuts"] or [])], np.int64)) if found["least"] is not None else np.zeros(0, np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(lowest)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = _ranges(rows.select("key"), partitions)
    n = max(len(bounds), 1)

    @F.pandas_udf("own int, before int")
    def place(keys: pd.Series) -> pd.DataFrame:
        own = np.searchsorted(bounds, keys.to_numpy(np.int64), "right") - 1
        # the first key of a range goes to the range before it too, that of the first to the last
        first = bounds[own] == keys.to_numpy(np.int64)
        return pd.DataFrame({"own": own.astype(np.int32), "before": np.where(first, (own - 1) % n, -1).astype(np.int32)})

    placed = rows.withColumn("p", place("key"))
    both = F.array(F.struct(F.col("p.own").alias("part"), F.lit(False).alias("extra")), F.struct(F.col("p.before").alias("part"), F.lit(True).alias("extra")))
    dealt = placed.select("id", "key", "text", F.explode(F.filter(both, lambda x: x["part"] >= 0)).alias("d")).select("id", "key", "text", "d.part", "d.extra")
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "extra", "key", "text").select("id", "text", "part", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                size += len(row[1])
                if size >= 2 << 20:
                    yield finish(held)
                    held, size = held[-1:], 0
        if held:
            yield finish(held)

    def finish(held: list[tuple]) -> pa.RecordBatch:
        # a range's own rows come first, then the first document of the next range, so each own row has one after it
        pairs = [(x, y) for x, y in zip(held, held[1:]) if not x[3]]
        n_chars, digests, own, changed, after = compare_neighbours([(x[1], y[1]) for x, y in pairs])
        return pa.RecordBatch.from_arrays([
            pa.array([x[0] for x, _ in pairs], pa.int64()), pa.array(n_chars, pa.int64()), pa.array(digests, pa.string()),
            pa.array(map(as_text, own), pa.string()), pa.array(map(as_text, changed), pa.string()), pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
        ], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return bound_batches(dealt).mapInArrow(tidy(run), "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@register("op10_multiset_hash")
def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
