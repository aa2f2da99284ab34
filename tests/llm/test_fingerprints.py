import random

import brute
import numpy as np

from wattle.llm import multiset_hash as H


def test_order_independent_and_incremental():
    parts = [f"paragraph number {i} has its own words." for i in range(40)]
    whole = H.fingerprint("\n".join(parts))
    rng = random.Random(1)
    rng.shuffle(parts)
    assert (H.fingerprint("\n\n".join(parts)) == whole).all()
    more = H.insert(whole, "a new one!")
    assert (more == H.fingerprint("\n".join([*parts, "a new one!"]))).all() and (more != whole).any()
    assert (H.delete(more, "a new one!") == whole).all()
    assert (H.insert(H.insert(whole, "x"), "x") != H.insert(whole, "x")).any()  # a multiset, not a set
    assert (H.from_text(H.as_text(whole)) == whole).all()


def test_many_equal_paragraphs():
    one = H.sums([H.hashes(["same."])])[0]
    for n in (1 << 16, 70_000):
        many = H.sums([H.hashes(["same."] * n)])[0]
        assert (many == one * n).all() and (many != 0).any()
        assert H.likeness(many, H.fingerprint("")) == 0
    # equal for equal multisets only, also where counters of 16 bits would meet
    assert (H.sums([H.hashes(["a"] * (1 << 16))])[0] != H.sums([H.hashes(["b"] * (1 << 16))])[0]).any()


def test_likeness_estimates_shared_paragraphs():
    parts = [f"p{i}." for i in range(400)]
    a, b, c = (H.fingerprint("\n".join(x)) for x in (parts[:300], parts[100:], [f"q{i}." for i in range(300)]))
    assert abs(H.likeness(a, b) - 2 / 3) < 0.15 and H.likeness(a, c) < 0.2 and H.likeness(a, a) == 1
    zero = H.fingerprint("")
    assert H.likeness(zero, zero) == 1 and H.likeness(zero, a) == 0


def expected(rows):
    texts = [t or "" for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        new = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        a, b, c = map(H.fingerprint, (text, new, after))
        out.append((i, len(text), brute.sha(new), H.as_text(a), H.as_text(b), float(H.likeness(a, b)), float(H.likeness(a, c))))
    return out


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    return sorted(map(tuple, H.fingerprints(df.repartition(3), **how).collect()), key=str)


def test_neighbours(spark):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("ab .!?\n😀é") for _ in range(rng.randrange(60)))
    rows = [(i * i, text()) for i in range(200)] + [(10**6, None), (10**6 + 1, "long. " * 30_000), (10**6 + 2, "")]
    for partitions in (1, 4, 50):
        assert got(spark, rows, partitions=partitions) == sorted(expected(rows), key=str)


def test_few_rows_null_and_repeated_ids(spark):
    assert got(spark, [(5, "one only. here")]) == expected([(5, "one only. here")])
    assert got(spark, [(5, "a. b"), (3, "c")]) == sorted(expected([(3, "c"), (5, "a. b")]), key=str)
    rows = [(None, "a"), (None, "b. c"), (2, "x. y. z"), (2, "x. y. z"), (2, "zz")]
    assert got(spark, rows, partitions=3) == sorted(expected(rows), key=str)
    assert got(spark, []) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    out = H.op10_multiset_hash(spark, sf).collect()
    assert sorted(map(tuple, out)) == expected(rows)
