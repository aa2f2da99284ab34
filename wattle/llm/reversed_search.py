"""Ranked lexical search, reversed: the items' terms are the index and the documents stream through it.

The items (queries) are few against the documents, so the inverted index is built over *their* terms: term -> items
that hold it.  It goes to every task; each document's term counts pass through it once, adding to one sum for each
item that shares a term, and every task keeps a heap of the k best documents for each item.  The heaps of all tasks
are merged in two steps, first within runs of MERGE neighbouring tasks.  No document is shuffled.

1. ``item_terms``: distinct (item, term) pairs, cut into blocks of items with at most BLOCK_POSTINGS pairs; a block's
   index is what is sent to the tasks, whatever the number of items (an item is never split, so a block holds one
   item's distinct terms at least).  Every block is a pass of its own over the documents.
2. ``term_counts``: each document's length n and its counts of the block's terms, written as a table; from it come
   N (documents with a term), L (all terms) and the block's document frequencies.
3. ``best_documents``: the counts stream through the index; heaps; merge.

Scores are whole numbers, so results do not depend on the order of sums: with m = 10 + (90 n N) div L, a shared
term adds w * ((10^9 tf) div (1000 tf + 8 m)), w = floor(1000 ln((2 N + 2) / (2 df + 1))).

Defined results: a null or empty text has no terms: such a document counts nowhere, such an item has no rows; rows
that share an item id are one item with the terms of all; rows that share a document id are ranked each for itself;
equal scores go by ascending document id, null ids last; terms of any length count whole; empty tables give an empty
one; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattle.llm.common import binary_values, bound_batches, materialize, ragged, tidy
from wattle.llm.registry import register, table

#: Maximal stretches of ASCII letters, digits and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (item, term) pairs in one index: some 40 MB with the terms themselves.
BLOCK_POSTINGS = 500_000
#: Sums held at once in a task, and (document, item) additions made at once.
CELLS, ADDITIONS = 1 << 21, 1 << 21
#: Tasks whose heaps are merged in the first step.
MERGE = 64
#: Bytes of a text that are split into terms at once.
SLICE = 4 << 20
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in lists, one for each stretch of about SLICE bytes."""
    data = data.translate(_FOLD)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, term) pairs, in order of items."""
    found = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(id_col).cast("bigint").alias("item"), F.explode(F.array_distinct(found)).alias("term")).distinct().orderBy("item")


class Index:
    """Inverted index of one block: ``terms`` with, for each, the positions in ``items`` that hold it."""

    def __init__(self, items: list[int | None], postings: dict[bytes, list[int]]):
        self.items, self.terms = items, sorted(postings)
        self.lengths = np.array([len(postings[t]) for t in self.terms], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.postings = np.array([i for t in self.terms for i in postings[t]], np.int64)
        self.most_terms = int(np.bincount(self.postings, minlength=1).max()) if len(self.postings) else 0


def index_blocks(pairs: DataFrame, most: int = BLOCK_POSTINGS) -> Iterator[Index]:
    """Indexes over consecutive items of ``item_terms``; the driver holds one block and one partition at a time."""
    items: list[int | None] = []
    postings: dict[bytes, list[int]] = {}
    size, last = 0, object()
    for row in pairs.toLocalIterator():
        if row["item"] != last:
            if size >= most:
                yield Index(items, postings)
                items, postings, size = [], {}, 0
            last = row["item"]
            items.append(last)
        postings.setdefault(row["term"].encode(), []).append(len(items) - 1)
        size += 1
    if size:
        yield Index(items, postings)


def term_counts(documents: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of each document with a term: positions in ``vocabulary`` and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            offsets, data = binary_values(batch.column(1))
            rows, lengths, found, tf, ends = [], [], [], [], [0]
            for row in range(batch.num_rows):
                n, hits = 0, []
                for words in terms(data[offsets[row]:offsets[row + 1]].tobytes()):
                    n += len(words)
                    hits += [i for i in map(place.get, words) if i is not None]
                if not n:
                    continue
                ids, counts = np.unique(np.array(hits, np.int32), return_counts=True)
                rows.append(row), lengths.append(n), found.append(ids), tf.append(counts), ends.append(ends[-1] + len(ids))
            ends = pa.array(ends, pa.int32())
            whole = lambda parts: pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(ends, whole(found)), pa.ListArray.from_arrays(ends, whole(tf)),
            ], names=["doc_id", "n", "terms", "counts"])

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return bound_batches(rows).mapInArrow(tidy(run), "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _add_up(cells: np.ndarray, values: np.ndarray, size: int, exact: bool) -> np.ndarray:
    """Sums of ``values`` by cell; float64 sums are exact while they stay under 2^53."""
    if exact:
        return np.bincount(cells, values, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, cells, values)
    return out


class Heaps:
    """The k best (score, document) for each item: highest score first, of equal ones the smallest id."""

    #: Stands for a null id, after all others.
    LAST = 1 << 63

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a document needs this score to enter

    def update(self, ids: list[int | None], scores: np.ndarray) -> None:
        """``scores``: a row for each document, a column for each item."""
        need = self.least
        if len(scores) > self.k:
            need = np.maximum(need, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        for doc, item in zip(*(x.tolist() for x in np.nonzero(scores >= need))):
            heap = self.heaps[item]
            entry = (int(scores[doc, item]), -(self.LAST if ids[doc] is None else ids[doc]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, doc in heap:
                yield item, None if -doc == self.LAST else -doc, score


def scores_of(index: Index, weights: np.ndarray, n_docs: int, n_terms: int, lengths: list[int], ends: np.ndarray, found: np.ndarray, tf: np.ndarray):
    """Row ranges [i, j) of documents with their scores against all items; ``ends`` are offsets into found and tf."""
    exact = int(weights.max(initial=0)) * 1_000_000 * index.most_terms < 1 << 53
    m = np.array([10 + 90 * n * n_docs // n_terms for n in lengths], np.int64)
    doc = np.repeat(np.arange(len(lengths)), np.diff(ends))
    gain = weights[found] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    added = np.concatenate([[0], np.cumsum(index.lengths[found])])[ends]
    i, width = 0, len(index.items)
    while i < len(lengths):
        j = max(i + 1, min(i + max(CELLS // width, 1), int(np.searchsorted(added, added[i] + ADDITIONS, "right")) - 1))
        part = slice(ends[i], ends[j])
        times = index.lengths[found[part]]
        items = index.postings[ragged(index.starts[found[part]], times)]
        yield i, j, _add_up(np.repeat(doc[part] - i, times) * width + items, np.repeat(gain[part], times), (j - i) * width, exact).reshape(j - i, width)
        i = j


def best_documents(counts: DataFrame, index: Index, n_docs: int, n_terms: int, frequencies: dict[int, int], k: int) -> DataFrame:
    """(item, task, doc_id, score): the heaps of all tasks."""
    weights = np.array([term_weight(n_docs, frequencies.get(i, 0)) for i in range(len(index.terms))], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        heaps = Heaps(len(index.items), k)
        for batch in batches:
            ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found, tf = batch.column(2), batch.column(3)
            ends = found.offsets.to_numpy().astype(np.int64)
            parts = [c.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(np.int64) for c in (found, tf)]
            for i, j, scores in scores_of(index, weights, n_docs, n_terms, lengths, ends - ends[0], *parts):
                heaps.update(ids[i:j], scores)
        rows = list(heaps.rows())
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([
            pa.array([index.items[r[0]] for r in rows], pa.int64()), pa.array([task] * len(rows), pa.int32()),
            pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
        ], names=["item", "task", "doc_id", "score"])

    return counts.mapInArrow(tidy(run), "item bigint, task int, doc_id bigint, score bigint")


def _best(rows: DataFrame, keys: list, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
           block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, scores above 0."""
    spark = documents.sparkSession
    heaps = spark.createDataFrame([], "item bigint, task int, doc_id bigint, score bigint")
    for index in index_blocks(item_terms(items, item_id, item_text), block_postings):
        counts = materialize(term_counts(documents, index.terms, doc_id, doc_text), "term-counts")
        total = counts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        # at most one row for each term of the block
        found = counts.select(F.explode("terms").alias("term")).groupBy("term").count()
        frequencies = {r["term"]: r["count"] for r in found.collect()}
        heaps = heaps.unionAll(best_documents(counts, index, total["docs"], total["terms"], frequencies, k))
    near = F.floor(F.col("task") / MERGE).alias("near")
    merged = _best(heaps.select("item", near, "doc_id", "score"), ["item", "near"], k)
    return _best(merged, ["item"], k).select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_SQL = rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
gains AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS gain
          FROM tf JOIN weights USING (term) JOIN lengths USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM gains JOIN wanted USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


@register("op13_reversed_search", _SQL)
def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
