import random

import brute
import numpy as np
import pytest

from wattle.llm import chosen_path as C
from wattle.llm.components import connected_components


def corpus(seed, n=120, clique=60, passages=2):
    """Texts with near copies at all distances, a large group of near copies, and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [None, "", " \n", "One two", "one TWO ", "a b c d e", "A B C D E f", "a b c d", "é É x y z"]
    base = [[word() for _ in range(rng.randrange(20, 90))] for _ in range(n // 4)]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(3):
            copy = list(b)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    hot = [word() for _ in range(70)]
    for _ in range(clique):
        copy = list(hot)
        copy[rng.randrange(70)] = word()
        texts.append(" ".join(copy))
    for _ in range(passages):
        shared = [word() for _ in range(40)]
        texts += [" ".join([word() for _ in range(rng.randrange(5, 60))] + shared) for _ in range(25)]
    texts += [" ".join(hot)] * 20
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, leaf, depth", [(1, 400, 12), (2, 6, 12), (3, 6, 1)])
def test_against_all_pairs(spark, monkeypatch, seed, leaf, depth):
    # small leaves send nodes through stars, size classes, branches and, at depth 1, blocks
    monkeypatch.setattr(C, "LEAF", leaf)
    monkeypatch.setattr(C, "DEPTH", depth)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.near_components(rows)
    got = {r.id: (r.n_shingles, r.component_id) for r in C.components(df).collect()}
    assert got == want


def test_star_below_large_roots(spark, monkeypatch):
    # a centre and 3000 variants 0.75 similar to it, in the next size class; every root they share is large
    monkeypatch.setattr(C, "LEAF", 50)
    rng = np.random.default_rng(5)
    n = 3000
    sketch = np.tile(rng.integers(0, 256, C.COORDINATES, dtype=np.uint8), (n + 1, 1))
    other = rng.random(sketch.shape) >= 0.75
    other[0] = False
    sketch[other] += rng.integers(1, 256, int(other.sum()), dtype=np.uint8)
    sketches = spark.createDataFrame([(i, 301 if i else 400, bytes(sketch[i])) for i in range(n + 1)], "cid long, n long, sketch binary")
    shared = rng.random((n + 1, C.TREES)) < 0.75
    shared[0] = True
    assert (shared.sum(axis=0) > 40 * C.LEAF).all()
    large = spark.createDataFrame([(int(t), int(i), int(i)) for i, t in zip(*np.nonzero(shared))], "node long, cid long, label long")
    leaves = C._leaves(large, sketches).select("node", "cid")
    met = {r.cid for r in leaves.join(leaves.filter("cid = 0").select("node").distinct(), "node").select("cid").distinct().collect()}
    missed = [i for i in range(n + 1) if shared[i].any() and i not in met]
    assert len(missed) == 0


def test_many_texts_of_one_template(spark, monkeypatch):
    # all share two thirds of their words (likeness 0.5, no link) but for some planted near pairs; every root is large
    monkeypatch.setattr(C, "LEAF", 100)
    rng, n = random.Random(9), 4000
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    core = [word() for _ in range(84)]
    texts = [core + [word() for _ in range(44)] for _ in range(n)]
    want = {i: i for i in range(n)}
    for k in range(40):
        copy = list(texts[k])
        copy[90 + k % 8] = word()
        texts.append(copy)
        want[n + k] = k
    made = []
    leaves = C._leaves

    def counted(*args):
        made.append(leaves(*args))
        return made[-1]

    monkeypatch.setattr(C, "_leaves", counted)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sizes = {len(brute.shingles(t)) for _, t in rows}
    assert sizes == {124}
    got = {r.id: r.component_id for r in C.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want
    # what is compared stays linear in the texts
    assert len(made) == 1 and made[0].count() < 10 * n


def test_sets_meet_at_their_rarest_shingles(spark):
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 400, rng.integers(1, 90)).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[:len(base) * 9 // 10], rng.integers(0, 400, 3).astype(np.uint64)]))]
    members = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "cid long, members binary").repartition(3)
    rows = C._rare(members.selectExpr("cid", "cid as label"), members).collect()
    nodes = {}
    for r in rows:
        nodes.setdefault(r.node, set()).add(r.cid)
    pairs = {(a, b) for c in nodes.values() for a in c for b in c if a < b}
    similar = {(a, b) for b in range(len(sets)) for a in range(b) if C._similar(sets[a], sets[b])}
    assert similar and similar <= pairs
    assert C._rare(members.selectExpr("cid", "cid as label").limit(0), members.limit(0)).count() == 0


def test_exactly_at_the_threshold(spark):
    # 30 and 30 words share 26 + 26 - ... : similarity 0.75 counts, just under does not
    base = [f"w{i}" for i in range(18)]
    same = base[:16] + ["x", "y"]  # 14 shingles each, 12 shared: 12 / 16 = 0.75
    less = base[:15] + ["x", "y", "z"]  # 11 shared: 11 / 17
    rows = [(5, " ".join(base)), (4, " ".join(same)), (3, " ".join(less))]
    got = {r.id: (r.n_shingles, r.component_id) for r in C.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_components(rows)


def test_null_ids_repeats_empty_and_clashes(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t, 1), (7, t, 2), (7, t, 2), (9, t + " more", 3), (None, "alone in the world today", 4), (None, None, 5)], "doc_id long, text string, n int")
    out = sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in C.components(df).collect())
    assert out == [("7", 26, "7"), ("7", 26, "7"), ("9", 27, "7"), ("None", 0, "None"), ("None", 1, "None"), ("None", 26, "7")]
    left = C.deduplicate(df)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r.n) for r in left.collect() if r.doc_id is not None) == [("7", 2), ("7", 2)]
    assert C.components(df.limit(0)).count() == 0 and C.deduplicate(df.limit(0)).count() == 0
    assert C.deduplicate(df.withColumnRenamed("n", "_maybe")).columns[-1] == "_maybe"


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute.near_components(rows)
    got = C.op6_chosen_path_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(200)] + [(5, 5)]
    rng.shuffle(pairs)
    want = {x: c for x, c in brute.union([p for p in pairs if p[0] != p[1]]).items()}
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
