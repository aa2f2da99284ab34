import random

import brute
import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattle.llm import quotient_dedup as Q
from wattle.llm.registry import ORACLES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**56 - 1) | st.integers(0, 40), max_size=60), min_size=1, max_size=5), st.integers(1, 10))
def test_filters_merge_without_loss(parts, quotient_bits):
    filters = [Q.QuotientFilter.build(np.array(p, np.uint64), quotient_bits, 56) for p in parts]
    whole = Q.QuotientFilter.merge([Q.QuotientFilter.from_bytes(f.to_bytes()) for f in filters])
    flat = [x for p in parts for x in p]
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist())) == {x: flat.count(x) for x in flat}
    assert all(whole.count(x) == flat.count(x) for x in [*flat, 7, 2**55 + 3])


def test_merge_walks_runs_of_the_right_size(monkeypatch):
    rng = np.random.default_rng(3)
    parts = [np.concatenate([rng.integers(0, 2**56, 3000 * k, dtype=np.uint64), np.arange(50, dtype=np.uint64)]) for k in range(8)]
    filters = [Q.QuotientFilter.build(p, 6, 56) for p in parts]
    found, n = np.unique(np.concatenate(parts), return_counts=True)

    def no_sort(*args, **kwargs):
        raise AssertionError("the merge sorts again")

    with monkeypatch.context() as m:
        for name in ("unique", "sort", "argsort", "lexsort"):
            m.setattr(np, name, no_sort)
        whole = Q.QuotientFilter.merge(filters)
    assert (whole.fingerprints() == found).all() and (whole.counts == n).all()
    # as many quotients as fingerprints, to a power of two, and 40 bits of remainder in 5 bytes
    assert len(found) <= 2**whole.quotient_bits < 2 * len(found)
    assert len(whole.to_bytes()) < 7 * len(found)


def test_large_counters():
    f = Q.QuotientFilter.build(np.array([5] * 1000 + [6] * 255 + [7] * 254, np.uint64), 3, 40)
    g = Q.QuotientFilter.from_bytes(f.to_bytes())
    assert (g.count(5), g.count(6), g.count(7), g.count(8)) == (1000, 255, 254, 0)


def rows():
    rng = random.Random(2)
    out = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, "a b"), (4, "ab "), (5, "a  b   "), (6, "a\u00a0b"), (7, "x" * 100_000), (8, "x " * 100_000), (9, "é"), (10, "e\u0301")]
    texts = ["".join(rng.choice("abc \n") for _ in range(rng.randrange(8))) for _ in range(400)]
    return out + [(11 + i, t) for i, t in enumerate(texts)] + [(1000 + i, "hot text") for i in range(300)]


def test_classes_and_deduplicate(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    want = brute.exact_classes(data)
    out = Q.classes(df).collect()
    assert {r.id: (r.keep_id, r.group_size, r.kept, bytes(r.sha).hex()) for r in out} == want and len(out) == len(data)
    left = Q.deduplicate(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, w in want.items() if w[2])


def test_null_ids_repeats_empty_and_clashes(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "a", 1), (5, "a", 2), (5, "a", 2), (None, "b", 3), (None, "b", 4)], "doc_id long, text string, n_chars int")
    out = Q.classes(df).collect()
    assert len(out) == 6 and sum(r.kept for r in out) == 2
    assert {r.keep_id for r in out if r.group_size == 4} == {5}
    assert sorted((str(r.doc_id), r.text) for r in Q.deduplicate(df).collect()) == [("5", "a"), ("None", "b")]
    assert Q.classes(df.limit(0)).count() == 0 and Q.deduplicate(df.limit(0)).count() == 0
    assert Q.deduplicate(df.withColumnRenamed("n_chars", "_maybe")).columns == ["doc_id", "text", "_maybe"]


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLES['op5_quotient_dedup']})").fetchall()
    got = Q.op5_quotient_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
