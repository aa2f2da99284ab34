"""Periodic runs in word sequences by internal pattern matching.

A run is a maximal stretch of consecutive words with smallest period q (words q apart are identical) and a length of
at least max(LEAST, 2 q).  Tasks take whole texts, BATCH_WORDS words at a time, as one sequence in which words of
different documents differ, so no match leaves its document.

1. ``Factors``: names for all factors of 1, 2, 4, ... words by prefix doubling.  Only positions whose factor occurs
   again are named on, so ordinary prose is done after four or eight words.  The same sort gives the suffix array of
   the positions that start a repeated factor of four words; equal factors are neighbours in it.
2. Dyadic blocks: a run of period q holds, with its copy q words on, a block of 2^k words that starts at a multiple of
   2^k with q in 2^(k+1) - 1 .. 2^(k+2) - 2 (blocks of four words at even places serve all q up to 14).  Every
   repeated block looks for its occurrences in the windows of those distances: a wavelet tree over the suffix array
   (``WaveletTree``) counts what lies before the window and gives the range successor and those after it.
3. Within a window as long as a block, three or more occurrences form an arithmetic progression, so two of them and
   their number tell all.  A progression that continues the block's own repetition gives no new period;
   else every term is a candidate period.
4. Candidates of one period whose blocks overlap are one stretch; it is extended both ways by comparing factors of
   falling length.  Of stretches with the same bounds the smallest period stays: the others are its multiples.

A text of n words costs O(n log n) beyond sorting its repeated factors, also where it is one word throughout.

Defined results: null and empty texts have no words and no runs; a text shorter than LEAST words has no runs; repeated
rows and rows that share an id give a row each; words are compared byte by byte; an empty table gives an empty one;
other columns are not read.  A task holds one batch, or one text if that is longer: some 100 bytes a word, and for
words in long repeats 12 bytes more for each doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle.llm.common import binary_values, bound_batches, ragged, tidy
from wattle.llm.registry import register, table

#: Least length of a run in words; the blocks of step 2 are laid out for it.
LEAST = 12
BATCH_WORDS = 200_000
#: The smallest blocks: 2^2 words at every second place.
_LOWEST = 2
#: Names of factors that occur once (or lie outside the text) are their place less this.
_ONCE = 1 << 60


class Factors:
    """Names of the factors of 2^k words from every position where such a factor occurs more than once.

    ``levels[k]`` is (positions ascending, name, number of occurrences); equal names mean equal factors.  From
    level _LOWEST on, a factor's name is where its occurrences start in ``suffixes``, the suffix array.
    """

    def __init__(self, words: np.ndarray):
        """``words``: a number for each word; words of different documents have different numbers."""
        self.words, self.n = words, len(words)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.suffixes = np.zeros(0, np.int64)
        if self.n < 2:
            return
        names = words
        at = np.arange(self.n - 1)
        first, second, span = names[:-1], names[1:], int(names.max()) + 1
        for k in range(1, 64):
            order, start, size = _classes(first * span + second)
            again = size > 1
            if k <= _LOWEST:
                # ranks are renumbered among the positions that are kept
                order, size = order[again], size[again]
                start = (np.cumsum(again) - 1)[start[again]]
                if k == _LOWEST:
                    self.suffixes = at[order]
            else:
                rank = first[order] + start - _class_start(first[order])
                self.suffixes[first[order] + np.arange(len(order)) - _class_start(first[order])] = at[order]
                order, size, start = order[again], size[again], rank[again]
            at, name = at[order], start
            by_place = np.argsort(at, kind="stable")
            at, name, size = at[by_place], name[by_place], size[by_place]
            if not len(at):
                return
            self.levels[k] = at.astype(np.int32 if self.n < 1 << 31 else np.int64), name.astype(np.int32 if self.n < 1 << 31 else np.int64), size
            # the next level joins each factor with the one 2^k words on; a factor that occurs once can't repeat in a longer one
            there = np.searchsorted(at, at + (1 << k))
            there[there == len(at)] = 0
            is_named = at[there] == at + (1 << k)
            second = np.where(is_named, name[there] + self.n, at)
            first, span = name, 2 * self.n + 1

    def name(self, k: int, at: np.ndarray) -> np.ndarray:
        """Names of the factors of 2^k words at ``at``; one that occurs once has a name below 0 that no other has."""
        if k == 0:
            return np.where((at >= 0) & (at < self.n), self.words[np.clip(at, 0, self.n - 1)], at - _ONCE)
        places, names, _ = self.levels[k]
        there = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[there] == at, names[there], at - _ONCE)

    def extend(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many words match from places ``a`` and ``b`` (a < b) on (step 1), or before them (step -1)."""
        out = np.zeros(len(a), np.int64)
        for k in range(max(self.levels, default=0), -1, -1):
            shift = out if step > 0 else -out - (1 << k)
            out += np.where(self.name(k, a + shift) == self.name(k, b + shift), 1 << k, 0)
        return out


def _classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order of ``keys`` and, in that order, where the class of equal keys starts and its size."""
    order = np.argsort(keys, kind="stable")
    start = _class_start(keys[order])
    ends = np.append(np.flatnonzero(np.diff(start)) + 1, len(start))
    return order, start, np.repeat(np.diff(np.append(0, ends)), np.diff(np.append(0, ends)))


def _class_start(ordered: np.ndarray) -> np.ndarray:
    """For each of the ordered values, the place of the first one equal to it."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


class WaveletTree:
    """Wavelet tree (level by level, as a matrix) over numbers; queries are arrays of ranges [l, r)."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(values.max(initial=0)).bit_length(), 1)
        self.zeros: list[np.ndarray] = []  # zeros[d][i]: values among the first i whose bit is 0
        for d in range(self.bits - 1, -1, -1):
            ones = (values >> d & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones, dtype=np.int32)]))
            values = np.concatenate([values[~ones], values[ones]])

    def count_below(self, l: np.ndarray, r: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range are below its bound."""
        out = np.zeros(len(l), np.int64)
        over = bound >= 1 << self.bits
        out[over] = (r - l)[over]
        bound = np.where(over, 0, np.maximum(bound, 0))
        for d, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            one = (bound >> d & 1).astype(bool)
            zl, zr = zeros[l].astype(np.int64), zeros[r].astype(np.int64)
            out += np.where(one, zr - zl, 0)
            l, r = np.where(one, zeros[-1] + l - zl, zl), np.where(one, zeros[-1] + r - zr, zr)
        return out

    def smallest(self, l: np.ndarray, r: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of each range with exactly k smaller places before it in sorted order."""
        out = np.zeros(len(l), np.int64)
        for d, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            zl, zr = zeros[l].astype(np.int64), zeros[r].astype(np.int64)
            one = k >= zr - zl
            out += np.where(one, 1 << d, 0)
            k = np.where(one, k - (zr - zl), k)
            l, r = np.where(one, zeros[-1] + l - zl, zl), np.where(one, zeros[-1] + r - zr, zr)
        return out


def _occurrences(tree: WaveletTree, l: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(ranges that have any, number, first, step) of the values from low to high, both included, of each range."""
    before = tree.count_below(l, r, low)
    number = tree.count_below(l, r, high + 1) - before
    some = np.flatnonzero(number)
    l, r, before, number = l[some], r[some], before[some], number[some]
    first = tree.smallest(l, r, before)  # the range successor of low
    more = np.flatnonzero(number > 1)
    step = np.zeros(len(some), np.int64)
    step[more] = tree.smallest(l[more], r[more], before[more] + 1) - first[more]
    return some, number, first, step


def _candidates(factors: Factors, tree: WaveletTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, period, block length) of blocks that occur again a candidate period on."""
    found = [(np.zeros(0, np.int64),) * 3]
    for k, (places, names, sizes) in factors.levels.items():
        if k < _LOWEST:
            continue
        block = 1 << k
        chosen = places % (2 if k == _LOWEST else block) == 0
        at, l = places[chosen].astype(np.int64), names[chosen].astype(np.int64)
        r = l + sizes[chosen]
        nearest, farthest = (1 if k == _LOWEST else 2 * block - 1), 4 * block - 2
        for low in range(nearest, farthest + 1, block):
            some, number, first, step = _occurrences(tree, l, r, at + low, at + min(low + block - 1, farthest))
            here = at[some]
            # in a progression that goes on with the block's own repetition a period is a multiple of the smallest one
            row = np.flatnonzero(number > 2)
            same = factors.extend(here[row], here[row] + step[row], 1) >= first[row] + block - step[row] - here[row]
            if k == _LOWEST:
                # the smallest period itself is found here, as the first occurrence
                number[row[same & (first[row] - here[row] == step[row])]] = 1
                same &= first[row] - here[row] != step[row]
            number[row[same]] = 0
            again = np.repeat(np.arange(len(some)), number)
            turn = ragged(np.zeros(len(some), np.int64), number)
            found.append((here[again], (first - here)[again] + turn * step[again], np.full(len(again), block)))
    return tuple(np.concatenate(x) for x in zip(*found))


def runs_of(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period."""
    if least < LEAST:
        raise ValueError(f"runs shorter than {LEAST} words are not looked for")
    factors = Factors(words)
    if not len(factors.suffixes):
        return (np.zeros(0, np.int64),) * 3
    place, period, block = _candidates(factors, WaveletTree(factors.suffixes))
    order = np.lexsort((place, period))
    place, period, block = place[order], period[order], block[order]
    first = np.ones(len(place), bool)
    first[1:] = (period[1:] != period[:-1]) | (place[1:] - place[:-1] > block[1:])
    final = np.append(first[1:], True) if len(first) else first
    begin, last, period = place[first], place[final], period[first]
    start = begin - factors.extend(begin, begin + period, -1)
    end = last + period + factors.extend(last, last + period, 1)
    long = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _repeats(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """For each of n words, whether a run holds it after the run's first period."""
    level = np.zeros(n + 1, np.int64)
    np.add.at(level, start + period, 1)
    np.add.at(level, start + length, -1)
    return np.cumsum(level[:-1]) > 0


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row: its runs as an array of (start, length, period) by start, then
    period, and its words joined by one space without those that a run repeats."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            offsets, data = binary_values(batch.column(1))
            for row in range(batch.num_rows):
                words = data[offsets[row]:offsets[row + 1]].tobytes().split()
                if texts and held + len(words) > BATCH_WORDS:
                    yield finish(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(batch.column(0)[row])
                texts.append(words)
                held += len(words)
        if texts:
            yield finish(ids, texts)

    def finish(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for text in texts for w in text), np.int64, int(sizes.sum()))
        # dense numbers for (document, word): pairs of them fit into 64 bits
        words = np.unique(words + np.repeat(np.arange(len(texts)), sizes) * max(len(numbers), 1), return_inverse=True)[1].astype(np.int64)
        start, length, period = runs_of(words, least)
        begins = np.cumsum(sizes) - sizes
        drop = _repeats(len(words), start, length, period)
        touched = np.add.reduceat(np.append(drop, False), begins) if len(begins) else drop
        collapsed = []
        for i, text in enumerate(texts):
            if sizes[i] and touched[i]:
                text = [w for w, out in zip(text, drop[begins[i]:begins[i] + sizes[i]].tolist()) if not out]
            collapsed.append(b" ".join(text))
        doc = np.searchsorted(begins + sizes, start, "right")
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        runs = pa.StructArray.from_arrays([pa.array(start - begins[doc]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays([
            pa.array([i.as_py() for i in ids], id_type), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ], names=["id", "n_words", "runs", "collapsed"])

    id_type = pa.int64()
    rows = rows.withColumn("id", F.col("id").cast("bigint"))
    return bound_batches(rows).mapInArrow(tidy(run), "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


#: White space between words.
_SPACE = " \t\n\x0b\x0c\r"


def planted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, or, where crc32 of the decimal id is divisible by 10, its words with those from number a on in a
    period of p: a and p follow from the rest of the checksum.  A row without id or words stays as it is."""
    text = F.col(text_col)
    check = F.crc32(F.col(id_col).cast("string"))
    words = F.split(F.btrim(text, F.lit(_SPACE)), r"[\x20\x09-\x0D]+")
    n = F.size(words).cast("bigint")
    g = F.floor(check / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times))
    changed = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((check % 10 == 0) & (F.btrim(text, F.lit(_SPACE)) != ""), F.array_join(changed, " ")).otherwise(text)


#: crc32 of a short ASCII text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(s) + 1), lambda k: ascii(substr(s, k, 1))::UBIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)::UBIGINT[]), lambda v, j: xor(v // 2, (v % 2) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""
_SQL = rf"""
WITH ids AS (SELECT doc_id, doc_id::VARCHAR AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
checks AS (SELECT doc_id, words, len(words) AS n, ({_CRC})::BIGINT AS h FROM ids),
laws AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM checks),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM laws),
seq AS (SELECT doc_id, i, CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % p + 1] END AS word
        FROM (SELECT doc_id, words, a, p, unnest(range(n)) AS i FROM periods)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q, n FROM seq x JOIN seq y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i JOIN periods l ON l.doc_id = x.doc_id
         WHERE 2 * (y.i - x.i) <= n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
digests AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
            arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS best FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM seq ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
       (1000 * best.l // best.p)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM ids LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@register("op11_periodic_runs", _SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_runs(docs.withColumn("text", planted(docs)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
                       F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
