import hashlib

import brute
import numpy as np
import pytest
import sentencepiece

from wattle.llm import sentencepiece_codec as S
from wattle.llm.registry import table

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "   a", " a ", " a  b ", "\n\na\t b", "▁", "▁▁a ▁ b", "a▁b", "<s>x</s>", "<0x0A>", "日本語 text 𝒳", "á ́b", "\x00a b\x00", " " * 40 + "x", " \n \n ", "a" * 3000, "x " * 5000, "😀😀 😀"]


def expected(text):
    sp = sentencepiece.SentencePieceProcessor(model_proto=S.load_model())
    ids = [sp.bos_id(), *sp.encode(text or ""), sp.eos_id()]
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(sp.decode(ids)), ids


def test_odd_texts_and_round_trip(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)], "doc_id long, text string, extra int").repartition(3)
    for limit in (200_000, 2):  # a table that starts anew all the time changes nothing
        out = S.decode(S.encode(df, S.load_model(), max_chunks=limit), S.load_model()).collect()
        assert len(out) == len(ODD)
        for r in out:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) == expected(ODD[r.doc_id]), ODD[r.doc_id]
            assert brute.sha(r.decoded) == r.decoded_sha256 and r.extra == r.doc_id


def test_query_equals_the_library(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    out = S.op1_sentencepiece_chunks(spark, SF).collect()
    assert len(out) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(texts[r.doc_id])[:3] for r in out)


def test_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert len({r.ids_sha256 for r in S.encode(df, S.load_model()).collect()}) == 1
    assert S.encode(df.limit(0), S.load_model()).count() == 0
    with pytest.raises(ValueError):
        S.encode(df.withColumnRenamed("doc_id", "N_tokens"), S.load_model())
    with pytest.raises(ValueError):
        S.check_model(open(__import__("public_tokenizers").path("piece_bpe_32k.model"), "rb").read().replace("▁the".encode(), "t▁he".encode(), 1))
