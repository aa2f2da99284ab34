import random
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wattle.llm import token_files as T
from wattle.session import scratch_path

SF = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(0, 10**7))
def test_elias_fano(values, more):
    values = np.sort(np.array(values, np.int64))
    top = (int(values[-1]) if len(values) else 0) + more
    e = T.EliasFano.from_bytes(memoryview(T.EliasFano.encode(values, top).to_bytes()))
    assert (e.decode() == values).all() and [e.select(i) for i in range(len(values))] == values.tolist()


def test_boundaries_take_little_space():
    ends = np.sort(np.random.default_rng(1).integers(0, 5_000_000, 10_000))
    size = len(T.EliasFano.encode(ends, 5_000_000).to_bytes())
    assert size < 10_000 * 2  # bytes; a 64-bit table takes 80,000


def test_segment_gives_single_documents():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 49_000, rng.integers(0, 30)).astype(np.uint16) for _ in range(500)]
    s = T.Segment(T.write_segment([None, *range(1, 500)], np.array(list(map(len, docs))), np.concatenate(docs)))
    assert s.doc_ids().to_pylist() == [None, *range(1, 500)]
    assert all((s.document(i) == d).all() for i, d in enumerate(docs))
    assert s.doc_ids(0, 1).to_pylist() == [None] and s.doc_ids(3, 200).to_pylist() == list(range(3, 200)) and s.doc_ids(7, 7).to_pylist() == []
    assert (s.edges(130, 260) == np.concatenate([[0], s.ends.decode()])[130:261]).all()
    with pytest.raises(ValueError):
        T.write_segment([2, 1], np.array([0, 0]), np.zeros(0, np.uint16))


@pytest.mark.parametrize("ids", [[], [None, None], [None, -(1 << 63), -5, -5, 0, (1 << 63) - 1], [-(1 << 63), -(1 << 63) + 9], [(1 << 62) + 3] * 70, [0, (1 << 62) - 1], [0, 1 << 62]])
def test_any_document_ids(ids):
    s = T.Segment(T.write_segment(ids, np.arange(len(ids)), np.zeros(sum(range(len(ids))), np.uint16)))
    assert s.doc_ids().to_pylist() == ids and all(s.doc_ids(i, i + 1).to_pylist() == [d] for i, d in enumerate(ids))


def test_ids_and_ends_of_a_segment_take_little_space():
    n = 10_000
    size = len(T.write_segment(list(range(7 * n, 8 * n)), np.full(n, 300), np.zeros(300 * n, np.uint16))) - 600 * n
    assert size < 3 * n  # bytes; two 64-bit tables take 160,000


def test_piece_table_is_bounded_in_text(monkeypatch):
    monkeypatch.setattr(T, "MOST_TEXT", 5000)
    pieces, plain = T.PieceTable(T.load_tokenizer(), 10**6), Tokenizer.from_str(T.load_tokenizer())
    for k in range(20):
        text = "日本" * 500 + str(k)
        ids, counts = pieces.encode([text])
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and pieces.held <= 5000 + len(text) + 1


def expected(rows):
    t, start, out = Tokenizer.from_str(T.load_tokenizer()), 0, []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def round_trip(spark, df, **how):
    path = scratch_path(spark, f"llm/test-{uuid.uuid4().hex}")
    T.write_tokens(df, path, T.load_tokenizer(), **how)
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in T.read_tokens(spark, path).collect()), key=lambda r: r[1])


ODD = ["a b", "İstanbul ΣΑΣ", "x ́y", "<|endoftext|>z a<|startoftext|>", "'S a'ſ", "it's I'LL we'd!'s '''s", "9٣½ 123", "​а", "é ", " ", "", None, "　a", "ab\u0085c", "é É ß ẞ ŉ K Å", "日本 text",
       "a\x00b", "\x1c a\x1fb", "don't'll", "_a_b-c", "😀a😀", "a" * 2000, "<|ENDOFTEXT|>", "ǅ ª º µ ²", "×÷ ´s 's ’s", "word " * 3000]


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT_IDS", 100)
    rng = random.Random(3)
    rows = list(enumerate(ODD + ["".join(rng.choice("ab'sSt 1É é́!<|>ßİıŉ\n ,.K") for _ in range(rng.randrange(40))) for _ in range(300)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert round_trip(spark, df, partitions=4) == expected(rows)


def test_null_and_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(3, "c", 1), (None, "n", 2), (3, "c", 1), (1, None, 4)], "doc_id long, text string, ids int")
    assert round_trip(spark, df) == expected([(None, "n"), (1, ""), (3, "c"), (3, "c")])
    assert round_trip(spark, df.limit(0)) == []


def test_query_equals_the_library(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.op7_elias_fano_tokens(spark, SF).collect())
    assert got == [r[:4] for r in expected(rows)]


def test_bad_magic():
    with pytest.raises(ValueError):
        T.Segment(b"x" * 100)
