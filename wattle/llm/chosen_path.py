"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles.  Equal sets form a class, and one
document of each class takes part in the join.  Every one of ``TREES`` independent
trees starts with one minwise token of each set (a coordinate of a MinHash): the sets that share
it form a node.  Nodes of up to ``LEAF`` sets are compared exhaustively.  In a larger one every set first
meets the node's hub; the links so found and those of the small nodes are confirmed and give a first set of
components.  Large nodes whose sets lie in one component end there.  The others part by size (sets that
differ by more than the threshold in size cannot be similar; each set goes to its own and the next class) and then
branch on two coordinates chosen by the node's path, as long as that lessens the rows in large nodes.  What is left
then, as with many texts of one template, branches on its rarest shingles: similar sets share one
of the rarest quarter of each (prefix filter), so no pair that shares a large node parts here.  A pair at the threshold shares 1.5 of its two children
on average, more than one, so it goes on meeting at any depth with probability 8/9 while others part.
It shares a given root with probability 0.75, so ten trees miss it with probability 0.25 ** 10 (1e-6) where the
roots are small, and with (1 - 0.75 * 8/9) ** 10 = 1.7e-5 at most where all ten are large; nodes of rare shingles
that are large all the same are compared in blocks, so none is cut off.

Comparisons inside nodes use 256 MinHash bytes: pairs estimated at LOW (four standard deviations
under the threshold) or more are candidates, and every reported link is confirmed on the full sets.
A node does not emit all its pairs: it emits a spanning forest of its candidates, best first.  Where
candidates between different components are left after these are confirmed, the full sets of the documents they
involve go to the node, once each, and every such candidate is tested there.  What is
returned are components, for which a forest of confirmed links suffices.

Defined results: null, empty or white-space text has an empty set, linked with nothing; a text of
fewer than five words has one shingle; a null id never names a component that has another id; repeated
rows fall into one class; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattle.llm.common import binary_values, bound_batches, key_bitmap, materialize, may_contain, shielded, slices, tasks_for, tidy
from wattle.llm.components import connected_components
from wattle.llm.registry import register, table

WORDS = 5
#: Similarity in hundredths.
THRESHOLD = 75
TREES, LEAF, DEPTH = 10, 1000, 12
COORDINATES = 256
LOW, HIGH = 0.64, 0.86
#: Counters of the table that orders shingles by frequency, at most (two bytes each), and in one piece of it.
COUNTERS, PIECE = 1 << 22, 1 << 15

_random = np.random.default_rng(20240607)
_POWERS = _random.integers(0, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_sets(offsets: np.ndarray, data: np.ndarray, words: _Words) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; bytes.lower() and bytes.split() are ASCII's rules."""
    whole, look = memoryview(data), words.__getitem__
    for i, j in slices(offsets, 1 << 20):
        lists = [bytes(whole[s:e]).lower().split() for s, e in zip(offsets[i:j].tolist(), offsets[i + 1:j + 1].tolist())]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        hashes = np.fromiter((look(w) for ws in lists for w in ws), np.uint64, int(counts.sum()))
        ends = np.cumsum(counts)
        n = max(len(hashes) - WORDS + 1, 0)
        windows = np.zeros(n, np.uint64)
        for k in range(WORDS):
            windows += hashes[k:k + n] * _POWERS[k]
        windows = _mix(windows)
        for count, end in zip(counts.tolist(), ends.tolist()):
            if count >= WORDS:
                yield np.unique(windows[end - count:end - WORDS + 1])
            elif count:
                # the length keeps short sequences apart from each other and from shingles
                parts = np.concatenate([hashes[end - count:end] * _POWERS[:count], _POWERS[WORDS:] * np.uint64(count)])
                yield _mix(parts.sum(dtype=np.uint64, keepdims=True))
            else:
                yield np.zeros(0, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def minhash(values: np.ndarray) -> np.ndarray:
    """Smallest hash under each of COORDINATES functions."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):
        np.minimum(out, (_FACTORS[:, None] * values[None, i:i + 1024]).min(axis=1), out=out)
    return out


def _sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pass one, a written table: (rid, id, key, n, class, roots, sketch) of each row."""
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            sizes, names, roots, sketches = [], [], [], []
            for values in shingle_sets(*binary_values(b.column(3)), words):
                least = minhash(values)
                sizes.append(len(values))
                names.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                roots.append(least[:TREES].view(np.int64))
                sketches.append((least >> np.uint64(16)).astype(np.uint8).tobytes())
            ends = np.arange(0, len(sizes) * TREES + 1, TREES, dtype=np.int32)
            flat = np.concatenate(roots) if roots else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.ListArray.from_arrays(ends, flat), pa.array(sketches, pa.binary())],
                                             names=["rid", "id", "key", "n", "class", "roots", "sketch"])

    return materialize(bound_batches(rows).mapInArrow(tidy(run), f"rid bigint, id {kind}, key bigint, n bigint, class binary, roots array<bigint>, sketch binary"), "near-sets")


def _classes(sets: DataFrame) -> DataFrame:
    """One row of each class of equal, non-empty sets: (cid, class, id, key, n, roots, sketch), written."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid", "key", "n", "roots", "sketch")).alias("f")
    found = sets.filter("n > 0").groupBy("class").agg(first)
    return materialize(found.select(F.monotonically_increasing_id().alias("cid"), "class", "f.id", "f.key", "f.n", "f.roots", "f.sketch"), "near-classes")


def _open(rows: DataFrame) -> DataFrame:
    """(node, size, small) of the nodes whose rows (node, cid, label) have more than one label.

    A node is small when the pairs between labels are no more than in a leaf of LEAF single sets, as with
    a few strangers among many near copies of one text; and it must fit a task in any case.
    """
    each = rows.groupBy("node", "label").agg(F.count("*").alias("n"))
    found = each.groupBy("node").agg(F.sum("n").alias("size"), F.max("n").alias("major")).filter("size > major")
    small = (F.col("size") * (F.col("size") - F.col("major")) <= LEAF * LEAF) & (F.col("size") <= 8 * LEAF)
    return found.select("node", "size", small.alias("small"))


def _children(node: pa.Array, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, coordinate, hash) of each branch, two of each row: the node's path chooses the coordinates."""
    seed = _mix(node.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(level))
    row = np.repeat(np.arange(len(seed)), 2)
    turn = np.tile(np.arange(2), len(seed))
    path = _mix(seed[row] + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, (path >> np.uint64(40)).astype(np.int64) % COORDINATES, path


def _matrix(sketches: pa.Array) -> np.ndarray:
    return binary_values(sketches)[1].reshape(len(sketches), COORDINATES)


def _stars(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """Candidates (a, b) among the pairs of a set and its node's hub; rows are (cid, hub)."""
    large = large.filter("cid <> hub").distinct()
    hubs = materialize(large.select(F.col("hub").alias("cid")).distinct().join(sketches, "cid").select(F.col("cid").alias("hub"), F.col("sketch").alias("hub_sketch")), "near-hubs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (_matrix(b.column(2)) == _matrix(b.column(3))).mean(axis=1) >= LOW
            x, y = b.column(0).to_numpy()[near], b.column(1).to_numpy()[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    both = large.join(sketches, "cid").join(hubs, "hub").select("cid", "hub", "sketch", "hub_sketch")
    return both.mapInArrow(tidy(run), "a bigint, b bigint")


def _branch(large: DataFrame, level: int) -> DataFrame:
    """Rows (node, cid, label, sketch) to the rows (node, cid, label) of the nodes they branch to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _matrix(b.column(3))
            row, coordinate, path = _children(b.column(0), level)
            child = _mix(path ^ _mix(own[row, coordinate].astype(np.uint64) + np.uint64(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(child), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row))], names=["node", "cid", "label"])

    return large.select("node", "cid", "label", "sketch").mapInArrow(tidy(run), "node bigint, cid bigint, label bigint")


def _by_size(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows (node, cid, label) dealt to size classes: one factor of the threshold wide, each set in its own and the one below."""
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / THRESHOLD) + 1e-9)
    rows = large.select("node", "cid", "label").join(sketches.select("cid", "n"), "cid")
    return rows.select("*", F.explode(F.array(own, own - 1)).alias("k")).select(F.xxhash64("node", "k").alias("node"), "cid", "label")


def _blocks(large: DataFrame) -> DataFrame:
    """Rows (node, size, cid, label) of nodes too large to compare at once, dealt to one node for each pair of blocks."""
    count = F.ceil(F.col("size") * 2 / LEAF)
    rows = large.select("node", "cid", "label", count.alias("k"), F.pmod(F.xxhash64("cid", "node"), count).alias("i"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("j"))
    return rows.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), "cid", "label")


def _forest(a: np.ndarray, b: np.ndarray, labels: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, bool]:
    """Which of the edges (a, b), best first, join parts that were apart (equal labels are joined already), and
    whether an edge was passed over between parts that not only sure edges join."""
    first: dict = {}
    up = [first.setdefault(x, i) for i, x in enumerate(labels.tolist())]
    left = len(first) - 1

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    keep = np.zeros(len(a), bool)
    certain = np.flatnonzero(sure)
    for e, x, y in zip(certain.tolist(), a[certain].tolist(), b[certain].tolist()):
        x, y = find(x), find(y)
        if x != y:
            up[y], keep[e], left = x, True, left - 1
            if not left:
                return keep, False
    part = np.array([find(i) for i in range(len(up))])
    open_edges = np.flatnonzero(~sure & (part[a] != part[b]))
    more = False
    for e, x, y in zip(open_edges.tolist(), a[open_edges].tolist(), b[open_edges].tolist()):
        x, y = find(x), find(y)
        if x != y:
            up[y], keep[e], left = x, True, left - 1
        else:
            more = True
            if not left:
                break
    return keep, more


def _by_node(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work`` on tables of whole nodes; the batches are sorted by node."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        node = rest.column("node").to_numpy()
        if not len(node):
            continue
        # the last node may go on in the next batch
        cut = int(np.searchsorted(node, node[-1]))
        if cut:
            yield work(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield work(rest)


def _near_pairs(t: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, x, y, likeness) of each node: its pairs between labels estimated at LOW or more."""
    node, label = t.column("node").to_numpy(), t.column("label").to_numpy()
    sketch = _matrix(t.column("sketch").combine_chunks())
    cuts = np.flatnonzero(np.diff(node, prepend=node[0] - 1, append=node[-1] - 1))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own, names = sketch[s:e], label[s:e]
        # the largest label's sets need not meet each other
        label_of, count = np.unique(names, return_counts=True)
        if len(label_of) < 2:
            continue
        major = names == label_of[np.argmax(count)]
        minor, major = np.flatnonzero(~major), np.flatnonzero(major)
        i, j = np.triu_indices(len(minor), 1)
        x, y = np.concatenate([np.repeat(minor, len(major)), minor[i]]), np.concatenate([np.tile(major, len(minor)), minor[j]])
        apart = names[x] != names[y]
        x, y = x[apart], y[apart]
        likeness = np.concatenate([(own[x[i:i + 8192]] == own[y[i:i + 8192]]).mean(axis=1) for i in range(0, len(x), 8192)] or [np.zeros(0)])
        near = np.flatnonzero(likeness >= LOW)
        if len(near):
            yield s, e - s, x[near], y[near], likeness[near]


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node")


def _long(values: list) -> pa.Array:
    return pa.concat_arrays([pa.array(v, pa.int64()) for v in values]) if values else pa.array([], pa.int64())


def _forests(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Candidates (node, a, b) of nodes given as rows (node, cid, label): a forest of each node's, best first.
    A row with a null a marks a node that has more."""

    def work(t: pa.Table) -> pa.RecordBatch:
        node, cid, label = (t.column(n).to_numpy() for n in ("node", "cid", "label"))
        out: list[tuple] = []
        for s, m, x, y, likeness in _near_pairs(t):
            a, b = np.minimum(cid[s + x], cid[s + y]), np.maximum(cid[s + x], cid[s + y])
            order = np.lexsort((b, a, -likeness))
            keep, more = _forest(x[order], y[order], label[s:s + m], likeness[order] >= HIGH)
            if more:
                out.append((node[s:s + 1], [None], [None]))
            out.append((np.full(int(keep.sum()), node[s]), a[order][keep], b[order][keep]))
        return pa.RecordBatch.from_arrays([_long([o[k] for o in out]) for k in range(3)], names=["node", "a", "b"])

    both = _dealt(rows.join(sketches.select("cid", "sketch"), "cid").select("node", "cid", "label", "sketch"))
    return both.mapInArrow(tidy(lambda batches: _by_node(batches, work)), "node bigint, a bigint, b bigint")


def _involved(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those rows (node, cid, label) that have a candidate of another label in their node."""

    def work(t: pa.Table) -> pa.RecordBatch:
        found = [s + np.union1d(x, y) for s, _, x, y, _ in _near_pairs(t)]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(t.column(n).to_numpy()[at], pa.int64()) for n in ("node", "cid", "label")], names=["node", "cid", "label"])

    both = _dealt(rows.join(sketches.select("cid", "sketch"), "cid").select("node", "cid", "label", "sketch"))
    return both.mapInArrow(tidy(lambda batches: _by_node(batches, work)), "node bigint, cid bigint, label bigint")


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= THRESHOLD * (len(both) - common)


def _links_within(rows: DataFrame, sketches: DataFrame, members: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between the labels of each node's rows (node, cid, label): every candidate
    is tested on the full sets, which travel once for each row and not for each pair, but for those that found links join already."""

    def work(t: pa.Table) -> pa.RecordBatch:
        cid, label, sets = t.column("cid").to_numpy(), t.column("label").to_numpy(), t.column("members").combine_chunks()
        out: list[tuple[int, int]] = []
        for s, m, x, y, likeness in _near_pairs(t):
            own = [np.frombuffer(v.as_buffer(), np.uint64) for v in sets.slice(s, m)]
            first: dict = {}
            up = [first.setdefault(n, i) for i, n in enumerate(label[s:s + m].tolist())]

            def find(i: int) -> int:
                while up[i] != i:
                    up[i] = i = up[up[i]]
                return i

            order = np.argsort(-likeness, kind="stable")
            for i, j in zip(x[order].tolist(), y[order].tolist()):
                r, q = find(i), find(j)
                if r != q and _similar(own[i], own[j]):
                    up[q] = r
                    out.append((min(cid[s + i], cid[s + j]), max(cid[s + i], cid[s + j])))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    both = rows.join(sketches.select("cid", "sketch"), "cid").join(members, "cid").select("node", "cid", "label", "sketch", "members")
    return _dealt(both).mapInArrow(tidy(lambda batches: _by_node(batches, work)), "a bigint, b bigint")


def _full_sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(cid, members) of the wanted classes (cid, class, key), written: their texts are read and hashed again.

    Keys outside a bitmap of bounded size stay behind in the scan; the join on key and class is exact.
    """
    bitmap = df.sparkSession.sparkContext.broadcast(key_bitmap(wanted, "key"))
    rows = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            # the test is made here and not by a function of its own, which would be a second Python process for each task
            b = b.filter(pa.array(may_contain(bitmap.value, b.column(0).to_numpy())))
            found = [v.tobytes() for v in shingle_sets(*binary_values(b.column(1)), words)]
            names = [hashlib.blake2b(v, digest_size=16).digest() for v in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(found, pa.binary())], names=["key", "class", "members"])

    sets = rows.mapInArrow(tidy(run), "key bigint, class binary, members binary")
    # repeated rows share their key: one of them is enough
    return materialize(sets.join(wanted, ["key", "class"]).dropDuplicates(["cid"]).select("cid", "members"), "near-members")


def _confirm(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = members.select(F.col("cid").alias("a"), F.col("members").alias("x"))
    right = members.select(F.col("cid").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a bigint, b bigint")


def _shingle_counts(members: DataFrame) -> np.ndarray:
    """How many sets (cid, members) hold a shingle, at least: counters by hash, stopping at 65,535.

    The table follows the number of shingles up to COUNTERS; past that it only ranks them more coarsely.
    """
    total, size = members.agg(F.sum(F.length("members"))).first()[0] or 0, PIECE
    while size < min(total // 2, COUNTERS):
        size *= 2

    def pack(seen: np.ndarray) -> bytes:
        return np.minimum(seen, 65535).astype("<u2").tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            at = binary_values(b.column(0))[1].view(np.uint64) & np.uint64(size - 1)
            seen += np.bincount(at.astype(np.int64), minlength=size)
        parts = [(i, seen[i * PIECE:(i + 1) * PIECE]) for i in range(size // PIECE)]
        parts = [(i, pack(part)) for i, part in parts if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([part for _, part in parts], pa.binary())], names=["piece", "seen"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a piece comes once from each task and is summed as it comes
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[i] = np.minimum(sums.get(i, 0) + np.frombuffer(part, "<u2").astype(np.int64), 65535)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(v) for v in sums.values()], pa.binary())], names=["piece", "seen"])

    schema = "piece int, seen binary"
    out = np.zeros(size, np.uint16)
    for row in members.select("members").mapInArrow(tidy(count), schema).repartition(size // PIECE, "piece").mapInArrow(tidy(merge), schema).collect():
        out[row["piece"] * PIECE:(row["piece"] + 1) * PIECE] = np.frombuffer(bytes(row["seen"]), "<u2")
    return out


def _rare(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (node, cid, label): sets (cid, label) branch to a node for each of their rarest shingles.

    Similar sets share at least THRESHOLD of either one's shingles, so in any common order the first others + 1 of
    both meet.  The order is by frequency; a shingle counted once is in no other set and names no node.
    Nodes of the same sets are one node.
    """
    members = materialize(members, "near-indexed")
    counts = sets.sparkSession.sparkContext.broadcast(_shingle_counts(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_by = counts.value
        for b in batches:
            nodes = []
            for v in b.column(2):
                own = np.frombuffer(v.as_buffer(), np.uint64)
                seen = seen_by[(own & np.uint64(len(seen_by) - 1)).astype(np.int64)]
                first = len(own) + THRESHOLD * len(own) // -100 + 1
                rarest = np.lexsort((own, seen))[:first]
                nodes.append(own[rarest[seen[rarest] > 1]].view(np.int64))
            row = pa.array(np.repeat(np.arange(len(nodes)), list(map(len, nodes))))
            yield pa.RecordBatch.from_arrays([_long(nodes), b.column(0).take(row), b.column(1).take(row)], names=["node", "cid", "label"])

    joined = sets.join(members, "cid").select("cid", "label", "members")
    rows = materialize(joined.mapInArrow(tidy(run), "node bigint, cid bigint, label bigint"), "near-rare")
    same = rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid")).alias("who")).filter("n > 1")
    return rows.join(same, "node").select(F.xxhash64("n", "who").alias("node"), "cid", "label").distinct()


def _leaves(large: DataFrame, sketches: DataFrame, members_of=None) -> DataFrame:
    """The trees below large nodes: rows (node, cid, label) of nodes small enough to compare.

    ``members_of`` gives the full sets (cid, members) of a table of cids; without it what branching leaves goes to blocks.
    """
    leaves, rows = None, materialize(large, "near-rows")
    step, level, before = "size", 0, None
    while True:
        tasks = tasks_for(rows.count())
        nodes = materialize(_open(rows), "near-nodes", tasks)
        rows = materialize(rows.join(nodes, "node"), "near-rows", tasks)
        small, big = rows.filter("small").select("node", "cid", "label"), rows.filter("not small")
        leaves = small if leaves is None else leaves.unionByName(small)
        left = big.count()
        if not left:
            return leaves
        if step == "size":
            made, step = _by_size(big, sketches), "branch"
        elif step == "branch" and level < DEPTH and (members_of is None or before is None or left < before):
            made, level, before = _branch(big.join(sketches, "cid"), level), level + 1, left
        elif step == "branch" and members_of is not None:
            # a set's label is the same in all its nodes
            sets = materialize(big.select("cid", "label").distinct(), "near-rest", tasks)
            made, step = _rare(sets, members_of(sets.select("cid"))), "rare"
        elif step == "rare":
            made, step = _by_size(big, sketches), "blocks"
        else:
            return leaves.unionByName(_blocks(big))
        rows = materialize(made, "near-rows", 2 * tasks)


def _label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (node, cid) with the label of each class: its component, or itself."""
    named = labels.select(F.col("node").alias("cid"), "component")
    return rows.select("node", "cid").join(named, "cid", "left").select("node", "cid", F.coalesce("component", "cid").alias("label"))


def _members_of(df: DataFrame, id_col: str, text_col: str, classes: DataFrame, cids: DataFrame) -> DataFrame:
    return _full_sets(df, id_col, text_col, classes.select("cid", "class", "key").join(cids.distinct(), "cid"))


def _link(df: DataFrame, id_col: str, text_col: str, classes: DataFrame) -> DataFrame:
    """(node, component) of every class that is linked with another."""
    roots = classes.select(F.posexplode("roots").alias("tree", "token"), "cid").select(F.xxhash64("tree", "token").alias("node"), "cid")
    hub = F.min(F.struct(F.xxhash64("node", "cid").alias("h"), "cid")).alias("hub")
    nodes = roots.groupBy("node").agg(F.count("*").alias("size"), hub).filter("size > 1").select("node", "size", F.col("hub.cid").alias("hub"))
    tasks = tasks_for(classes.count() * TREES)
    rows = materialize(roots.join(materialize(nodes, "near-nodes", tasks), "node"), "near-rows", tasks)
    sketches = materialize(classes.select("cid", "n", "sketch").join(rows.select("cid").distinct(), "cid", "left_semi"), "near-sketches", tasks)
    small, large = rows.filter(F.col("size") <= LEAF), rows.filter(F.col("size") > LEAF)
    some_large = not large.isEmpty()

    # forests of small nodes, and hubs
    met = materialize(_forests(small.select("node", "cid", F.col("cid").alias("label")), sketches), "near-forest", 2 * tasks)
    pairs = met.filter("a is not null").select("a", "b")
    if some_large:
        pairs = pairs.unionByName(_stars(large.select("cid", "hub"), sketches))
    pairs = materialize(pairs.distinct(), "near-pairs", tasks)
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    links = _confirm(pairs, _members_of(df, id_col, text_col, classes, ends))
    labels = materialize(connected_components(links, tasks=tasks), "near-labels", tasks)

    # what these components leave open: nodes with candidates beyond their forest, and the trees below large nodes
    more = materialize(_label(small.join(met.filter("a is null").select("node").distinct(), "node", "left_semi"), labels), "near-more", tasks)
    leaves = more.join(_open(more).select("node"), "node", "left_semi")
    if some_large:
        leaves = leaves.unionByName(_leaves(_label(large, labels), sketches, lambda cids: _members_of(df, id_col, text_col, classes, cids)))
    leaves = materialize(_involved(leaves.dropDuplicates(["node", "cid"]), sketches), "near-open", 2 * tasks)
    if leaves.isEmpty():
        return labels
    members = _members_of(df, id_col, text_col, classes, leaves.select("cid"))
    late = materialize(_links_within(leaves, sketches, members).distinct(), "near-late-links", 2 * tasks)
    if late.isEmpty():
        return labels

    # components of components
    name = labels.withColumnRenamed("component", "c")
    late = late.join(name.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("c", "a").alias("a"), "b")
    late = late.join(name.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("c", "b").alias("b"))
    joined = materialize(connected_components(late, tasks=tasks), "near-joined", tasks)
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("m"))
    kept = labels.join(moved, "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    return materialize(kept.unionByName(joined.join(labels, "node", "left_anti")), "near-labels", tasks)


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row; component_id is the smallest id reachable."""
    sets = _sets(df, id_col, text_col)
    classes = _classes(sets)
    linked = _link(df, id_col, text_col, classes)
    found = classes.select("class", "id", "cid").join(linked.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = found.groupBy("component").agg(F.min("id").alias("component_id"))
    named = materialize(found.join(lowest, "component").select("class", "component_id"), "near-named", tasks_for(classes.count()))
    return sets.select("id", "n", "class").join(named, "class", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose id is not its component's; columns unchanged.

    Rows that surely stay pass straight through the scan; the rest are settled by an exact join.
    """
    own = df.columns
    df, (id_col, text_col) = shielded(df, id_col, text_col)
    # a row is told by its id; rows without one by their component having another
    gone = components(df, id_col, text_col).filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_id"), F.xxhash64(F.col("id")).alias("_k")).distinct()
    gone = materialize(gone, "near-dropped")
    bitmap = df.sparkSession.sparkContext.broadcast(key_bitmap(gone, "_k"))
    keyed = df.withColumn("_key", F.xxhash64(F.col(id_col)))
    schema = T.StructType([*keyed.schema.fields, T.StructField("_maybe", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(may_contain(bitmap.value, b.column("_key").to_numpy()))], names=schema.names)

    marked = bound_batches(keyed).mapInArrow(tidy(run), schema)
    settled = marked.filter("_maybe").join(gone, F.col(id_col).eqNullSafe(F.col("_id")), "left_anti")
    return marked.filter("not _maybe").select(*df.columns).unionByName(settled.select(*df.columns)).toDF(*own)


#: All pairs that share a shingle, counted; components as the smallest id reachable.  Fit for small tables.
_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM h),
e AS (SELECT doc_id, unnest(s) AS x FROM h),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)"""


@register("op6_chosen_path_dedup", _SQL)
def op6_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
