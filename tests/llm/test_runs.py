import random
import zlib

import brute
import numpy as np
import pytest

from wattle.llm import periodic_runs as P


def runs_by_definition(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def numbered(words):
    return np.unique(np.array(words), return_inverse=True)[1].astype(np.int64)


def found(words, **how):
    return list(zip(*(x.tolist() for x in P.runs_of(numbered(words), **how))))


def sequences(rng):
    yield [rng.randrange(2) for _ in range(rng.randrange(1, 130))]
    yield [w for _ in range(15) for w in [rng.randrange(3) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 6)]
    words = [rng.randrange(2) for _ in range(rng.randrange(1, 30))] * rng.randrange(2, 8)
    words[rng.randrange(len(words))] = 5
    yield (words + [9]) * rng.randrange(1, 4)
    n = rng.randrange(5, 40)
    yield ([0, 1] * n + [0, 0] + [1, 0] * n)[rng.randrange(3):] * rng.randrange(1, 3)


def test_random_sequences():
    rng = random.Random(11)
    total = 0
    for _ in range(200):
        for words in sequences(rng):
            expected = runs_by_definition(words)
            assert found(words) == expected
            total += len(expected)
    assert total > 5000
    words = [rng.randrange(2) for _ in range(300)]
    assert found(words, least=20) == runs_by_definition(words, 20)
    with pytest.raises(ValueError):
        found(words, least=5)


def test_long_repetitive_texts():
    assert found([7] * 300_000) == [(0, 300_000, 1)]
    assert found(list(range(1000)) * 300) == [(0, 300_000, 1000)]
    many = found([0, 1] * 40_000 + [0, 0] + [1, 0] * 40_000)  # a run of every odd period around the middle
    assert len(many) == 40_000 and many == sorted(many)


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    values = rng.permutation(500)
    tree = P.WaveletTree(values)
    l = rng.integers(0, 500, 300)
    r = np.minimum(l + rng.integers(1, 100, 300), 500)
    bound = rng.integers(-3, 600, 300)
    below = tree.count_below(l, r, bound)
    assert below.tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(l, r, bound)]
    k = np.minimum(below, r - l - 1)
    assert tree.smallest(l, r, k).tolist() == [sorted(values[a:b])[c] for a, b, c in zip(l, r, k)]


def row_by_definition(doc_id, text):
    words = [w for w in (text or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).decode().split(" ") if w]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_definition(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, brute.sha(listed), brute.sha(kept))


def test_query(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \t ", "one", "a b " * 30, "x " * 5000, "é ü  " * 20 + "\x0b\x0c", "w" * 50_000, "a a\n" * 3 + "b"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(100)]
    rows = [(i * 7, t, "x") for i, t in enumerate(texts)] + [(None, "c d " * 9, "y"), (5, "q " * 20, "z"), (5, "q " * 20, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, P.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((row_by_definition(i, t) for i, t, _ in rows), key=str)


def test_spans_and_texts(spark):
    df = spark.createDataFrame([(1, "s " + "u v w " * 5 + "end")], "doc_id long, text string")
    row = P.find_runs(df).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 15, 3)] and row["collapsed"] == "s u v w end" and row["n_words"] == 17
    assert P.find_runs(df.limit(0)).collect() == []
