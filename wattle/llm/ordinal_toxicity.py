"""Toxicity as severity grades: cumulative-link ordinal regression on sparse text features.

Features are lower-cased words and their prefixes of 4 to 6 letters, weighted log2(1 + count).  They are
counted over a bounded sample of labelled documents (``MOST_TOXIC`` + ``MOST_CLEAN`` rows, the first by
hash of the id), and the FEATURES most associated with the toxic label (likelihood ratio) are kept.

Grades: clean documents are 0; toxic ones are 1 (mild) to 3 (severe).  A text is split into two halves, its words by turns;
a half is a training row, and its grade comes from the other half, by how many associated features that one
shows (a third of the rows each), so the model learns to tell a grade it does not see.  Halves without any feature say
nothing and are left out unless both are (then the document is one row).  The model is the proportional-odds one,
P(grade <= k) = sigmoid(theta_k - w.x): one weight vector is shared by all thresholds theta_0 < theta_1 <
theta_2.  Clean sample rows are weighted up to their share of all labels.  Every document
gets its expected severity sum_k P(grade >= k); it is rejected when a grade above 0 is the likelier case.  On held-out halves
severity rises with the grade and is off by up to 0.6: too low for mild texts, too high for severe ones, as one slope serves all thresholds.

Defined results: null or empty text has no feature; labels that are null or without document are ignored, repeated
ones count as toxic if any is; without labels of both kinds nothing is rejected and severity is 0; repeated rows
score alike; ties between features go to the smaller hash; an empty table gives an empty one; other columns pass through,
clashing ones raise ``ValueError``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattle.llm.common import bound_batches, materialize, tidy
from wattle.llm.registry import register, table

#: Bound of the labelled sample that the model is fitted on.
MOST_TOXIC, MOST_CLEAN = 3000, 6000
FEATURES = 400
#: A feature needs so many toxic documents and so large a likelihood ratio.
LEAST_DOCUMENTS, LEAST_RATIO = 4, 25.0
GRADES = 4
PREFIXES = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its proper prefixes, as signed 64-bit integers."""
    names = [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh64_intdigest(n.encode()) - (1 << 63) for n in names]


def text_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _counts(words: list[str]) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(words).items():
        for f in word_features(word):
            out[f] += n
    return out


def counted(text: str | None) -> Counter:
    return _counts(text_words(text))


def halves(text: str | None) -> tuple[Counter, Counter]:
    """Feature counts of the words at even and at odd places."""
    words = text_words(text)
    return _counts(words[::2]), _counts(words[1::2])


@dataclass
class OrdinalModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # theta_0 < theta_1 < ...
    cuts: np.ndarray  # a toxic half is of grade 1 + the number of cuts that its features exceed

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, features, even, odd) of the sampled documents, written, with the counts in both halves; and the number of labels of each kind."""
    labels = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    kinds = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    first = lambda toxic, most: labels.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # MOST_TOXIC + MOST_CLEAN rows of two numbers at most: safe to broadcast
    some = F.broadcast(first(1, MOST_TOXIC).unionByName(first(0, MOST_CLEAN)).select(F.col("doc_id").alias("_id"), "toxic"))
    rows = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("text")).join(some, F.col("_d") == F.col("_id")).select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [halves(t) for t in b.column(1).to_pylist()]
            names = [list(x | y) for x, y in found]
            parts = [pa.array([[x[k][f] for f in fs] for x, fs in zip(found, names)], pa.list_(pa.int32())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.list_(pa.int64())), *parts], names=["toxic", "features", "even", "odd"])

    return materialize(bound_batches(rows).mapInArrow(tidy(run), "toxic int, features array<bigint>, even array<int>, odd array<int>"), "toxic-sample"), kinds


def associated(sample: DataFrame) -> list[int]:
    """The features most associated with the toxic label, best first."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = float(n.get(1, 0)), float(n.get(0, 0))
    if not toxic or not clean:
        return []
    counts = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counts = counts.filter((F.col("a") >= LEAST_DOCUMENTS) & (F.col("a") / toxic > F.col("b") / clean))
    both = F.col("a") + F.col("b")
    part = lambda seen, share: F.when(seen > 0, 2 * seen * F.log(seen / (both * share))).otherwise(0.0)
    ratio = part(F.col("a"), toxic / (toxic + clean)) + part(F.col("b"), clean / (toxic + clean))
    best = counts.select("f", ratio.alias("g")).filter(F.col("g") >= LEAST_RATIO).orderBy(F.desc("g"), "f").limit(FEATURES)
    return [r["f"] for r in best.collect()]


def fit_thresholds(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 800, ridge: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the proportional-odds model, by full-batch Adam."""
    k = GRADES - 1
    # thetas as a first value and positive gaps
    params = np.concatenate([np.zeros(x.shape[1]), [1.0], np.zeros(k - 1)])
    weight = weight / weight.sum()
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, gaps = params[:-k], np.exp(params[len(params) - k + 1:])
        theta = params[-k] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = x @ w
        below = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -500, 500)))
        edges = np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))])
        row = np.arange(len(x))
        up, down = edges[row, y + 1], edges[row, y]
        p = np.maximum(up - down, 1e-12)
        by_score = -weight * (up + down - 1)
        by_theta = np.zeros((len(x), k + 2))
        by_theta[row, y + 1] -= weight * up * (1 - up) / p
        by_theta[row, y] += weight * down * (1 - down) / p
        g_theta = by_theta[:, 1:-1].sum(axis=0)
        after = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([x.T @ by_score + ridge * w, [after[0]], after[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = 0.1 if t <= steps // 2 else 0.02
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    gaps = np.exp(params[len(params) - k + 1:])
    return params[:-k], params[-k] + np.concatenate([[0.0], np.cumsum(gaps)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on the bounded sample; what comes to the driver is at most a row of FEATURES numbers for each sampled document."""
    sample, kinds = labelled_sample(docs, labels, id_col, text_col)
    chosen = np.array(sorted(associated(sample)), np.int64)
    if not len(chosen):
        return OrdinalModel(chosen, np.zeros(0), np.full(GRADES - 1, 500.0), np.zeros(GRADES - 2))
    # equal rows (most clean ones show no feature at all) are one row with their number as weight
    rows: Counter = Counter()
    for r in known_features(sample, chosen).collect():
        for own, others, weight in training_rows(r):
            rows[r["toxic"], own, others] += weight
    ordered = sorted(rows)
    x, toxic, others = np.zeros((len(ordered), len(chosen))), np.array([r[0] for r in ordered]), np.array([r[2] for r in ordered])
    times = np.array([rows[r] for r in ordered], float)
    for i, (_, values, _) in enumerate(ordered):
        for k, n in values:
            x[i, k] = np.log2(1.0 + n)
    # times are whole or half numbers
    cuts = np.quantile(np.repeat(others, (2 * times).astype(int))[np.repeat(toxic, (2 * times).astype(int)) == 1], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    y = np.where(toxic == 1, 1 + (others[:, None] > cuts[None, :]).sum(axis=1), 0)
    weight = times * np.where(toxic == 1, kinds[1] / max(times[toxic == 1].sum(), 1), kinds[0] / max(times[toxic == 0].sum(), 1))
    return OrdinalModel(chosen, *fit_thresholds(x, y, weight), cuts)


def known_features(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(toxic, at, even, odd): the sample's features that are in the sorted array ``chosen``, by their place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, parts = [], ([], [])
            for f, *counts in zip(*b.columns[1:]):
                f = f.values.to_numpy()
                i = np.minimum(np.searchsorted(chosen, f), len(chosen) - 1)
                hit = chosen[i] == f
                at.append(i[hit].astype(np.int32))
                for part, c in zip(parts, counts):
                    part.append(c.values.to_numpy()[hit])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.list_(pa.int32())) for v in (at, *parts))], names=["toxic", "at", "even", "odd"])

    return sample.select("toxic", "features", "even", "odd").mapInArrow(tidy(run), "toxic int, at array<int>, even array<int>, odd array<int>")


def training_rows(row) -> list[tuple[tuple, int, float]]:
    """((place, count) of a half's features, number of the other half's, weight) of each half that shows a feature, of one if none does."""
    both = [tuple(sorted((k, n) for k, n in zip(row["at"], row[part]) if n)) for part in ("even", "odd")]
    shown = [(own, len(other)) for own, other in (both, both[::-1]) if own] or [((), 0)]
    return [(own, others, 1 / len(shown)) for own, others in shown]


def calibration(docs: DataFrame, labels: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[float, float, float]]:
    """(weight, mean severity told from a half, mean grade by its other half) of labelled documents the model was not
    fitted on, by the grade that is likeliest to be reached; a bounded sample of them, as for ``fit``."""
    sample, _ = labelled_sample(docs, labels, id_col, text_col)
    out = np.zeros((GRADES, 3))
    for r in known_features(sample, model.features).collect() if len(model.features) else []:
        for own, others, weight in training_rows(r):
            reach = model.probabilities(np.array([sum(model.weights[k] * np.log2(1.0 + n) for k, n in own)]))[0]
            grade = 1 + int((others > model.cuts).sum()) if r["toxic"] else 0
            out[int((reach >= 0.5).sum())] += weight * np.array([1.0, reach.sum(), grade])
    return [(n, severity / n, grade / n) for n, severity, grade in out.tolist() if n]


def score(df: DataFrame, model: OrdinalModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with severity (expected grade), grade (the likeliest to be reached) and rejected."""
    added = [T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())]
    if clash := {f.name for f in added} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns would clash: {sorted(clash)}")
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*kept, *added])

    class Known(dict):
        """word -> positions of its features in the model."""

        def __missing__(self, word: str) -> tuple[int, ...]:
            if len(self) > 100_000:
                self.clear()
            self[word] = out = tuple(at[f] for f in word_features(word) if f in at)
            return out

    at = {int(f): i for i, f in enumerate(model.features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            scores = np.zeros(b.num_rows)
            for i, text in enumerate(b.column(text_col)):
                text = text.as_py()
                if text and at:
                    found: Counter = Counter()
                    for positions in filter(None, map(known.__getitem__, _WORD.findall(text.lower()))):
                        found.update(positions)
                    if found:
                        # in the order of the features, so that equal counts give equal sums
                        scores[i] = sum(float(model.weights[k]) * float(np.log2(1.0 + n)) for k, n in sorted(found.items()))
            reach = model.probabilities(scores)
            columns = [pa.array(reach.sum(axis=1).round(9)), pa.array((reach >= 0.5).sum(axis=1), pa.int32()), pa.array(reach[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *columns], names=schema.names)

    return bound_batches(df).mapInArrow(tidy(run), schema)


@register("op8_ordinal_toxicity")
def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), keep_text=False)
