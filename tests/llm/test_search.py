import math
import random
import re
from collections import Counter

from wattle.llm import reversed_search as R

ROWS = "doc_id long, text string, score string"
ITEMS = "item_id long, text string, rank string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def expected(docs, items, k=10):
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(split(text))
    out = []
    for item, found in wanted.items():
        scored = []
        for doc, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in found if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, parts=3, **how):
    docs = spark.createDataFrame([(*d, "x") for d in docs], ROWS).repartition(parts)
    items = spark.createDataFrame([(*i, "x") for i in items], ITEMS).repartition(2)
    return sorted(map(tuple, R.search(docs, items, **how).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "ÜBER", "Ab", "aB", "x-y", "naïve", "日本", "1a"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda k: rng.choice([" ", "\n", "--", "_"]).join(rng.choices(words, weights, k=rng.randrange(k)))
    docs = [(i * 3 - 50, text(60)) for i in range(n)]
    docs += [(d, t) for d, t in docs[:20]] + [(1000 + i, docs[3][1]) for i in range(30)]  # repeated rows, ties
    items = [(i, text(25)) for i in range(12)] + [(3, "w1 w2"), (40, None), (41, ""), (42, "nowhere"), (43, "-- !"), (None, "w3 Über")]
    return docs + [(5000, None), (5001, ""), (None, "w1 w2 w3"), (5002, "w5 " * 50_000)], items


def test_brute_force(spark):
    docs, items = corpus(1, 200)
    want = expected(docs, items)
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, parts=9, block_postings=20) == want  # several blocks
    assert got(spark, docs, items, k=3) == expected(docs, items, 3)


def test_empty(spark):
    docs, items = corpus(2, 5)
    assert got(spark, [], items) == [] and got(spark, docs, []) == [] and got(spark, [(1, None)], items) == []


def test_terms_of_long_texts(monkeypatch):
    text = "Word-one " * 1000 + "é" * 500 + " end"
    whole = [w for part in R.terms(text.encode()) for w in part]
    assert [w.decode() for w in whole] == split(text)
    monkeypatch.setattr(R, "SLICE", 7)
    assert [w for part in R.terms(text.encode()) for w in part] == whole


def test_heaps_keep_the_best():
    import numpy as np

    rng = np.random.default_rng(3)
    scores = rng.integers(0, 6, (500, 4))
    heaps = R.Heaps(4, 10)
    for i in range(0, 500, 37):
        heaps.update(list(range(i, min(i + 37, 500))), scores[i:i + 37])
    best = sorted(heaps.rows())
    want = [(item, doc, int(scores[doc, item])) for item in range(4) for doc in sorted(range(500), key=lambda d: (-scores[d, item], d))[:10]]
    assert best == sorted(want)
    # sums past 2^53 are kept whole
    assert R._add_up(np.array([0, 0]), np.array([1 << 60, 1]), 1, False).tolist() == [(1 << 60) + 1]
