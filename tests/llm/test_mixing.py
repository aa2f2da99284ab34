import random

import brute
import pytest
from pyspark.sql import functions as F

from wattle.llm import entropy_mix as M
from wattle.llm.common import materialize

SCHEMA = "doc_id long, text string, source string, extra int"


def decided(df):
    sized = materialize(M.measure(df), "t")
    return sized, M.copies(sized, M.fit(sized))


def corpus(rng, sources):
    rows = []
    for s, n in sources.items():
        rows += [(len(rows) + i, " ".join(["w"] * max(0, int(rng.expovariate(1 / 60)))), s, i) for i in range(n)]
    return rows


def test_targets_met_and_reruns_agree(spark):
    rng = random.Random(5)
    rows = corpus(rng, {"b": 900, "a": 300, None: 200, "ä": 150, "Z": 40, "": 30})
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    _, out = decided(df)
    out = out.collect()
    sizes, want = {}, None
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + brute.words(t)
    want = brute.targets(sizes)
    taken = {}
    for r in out:
        assert 0 <= r.copies <= 2 and r.size == brute.words(rows[r.doc_id][1]) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source] + 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 2, (s, taken[s], want[s])
    again = {r.doc_id: r.copies for r in decided(df.repartition(3, "extra"))[1].collect()}
    assert again == {r.doc_id: r.copies for r in out}
    mixed = M.mix(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {k: v for k, v in again.items() if v}


def test_rates_are_exponentially_tilted(spark):
    # the dual's solution: ln(rate) is proportional to size below the cap
    df = spark.createDataFrame([(i, "w " * (1 + i % 50), "s", 0) for i in range(1000)], SCHEMA)
    sized = materialize(M.measure(df), "t")
    dual = M.solve(sized.select("source", "size"), share=0.6).first()
    assert dual.multiplier < 0
    rates = [min(2, 2.718281828459045 ** (dual.multiplier * (1 + i % 50) / dual.scale)) for i in range(1000)]
    assert abs(sum(r * (1 + i % 50) for i, r in enumerate(rates)) - dual.target) < 1e-4 * dual.target


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "", "a", 1), (2, " \n", "a", 1), (3, "one two", "b", 1), (3, "one two", "b", 1), (4, "x " * 20000, "b", 2), (5, "é\u00a0b", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = M.mix(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == 1 and ids.count(1) == 1 and ids.count(2) == 1  # without words: taken once
    assert ids.count(3) % 2 == 0  # repeated rows are decided alike
    assert M.mix(df.limit(0)).count() == 0
    assert M.mix(df.filter("doc_id = 1")).count() == 1
    assert M.mix(df.withColumnRenamed("extra", "copies")).columns[0] == "doc_id"


def test_query(spark):
    out = M.op4_entropy_mix(spark, "/root/testdata/sf0.001").agg(F.count("*"), F.sum("taken"), F.sum("size")).first()
    assert out[0] == 200 and 1.3 < out[1] / out[2] <= 1.6
