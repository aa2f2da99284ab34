import brute
import corpus_pipeline as P
import numpy as np
import sentencepiece

from wattle.llm import ordinal_toxicity as O
from wattle.llm.sentencepiece_codec import load_model

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append((before.collect(), docs.collect()))

    # toxicity: what the model rejects, scored row by row
    model = O.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    at = {int(f): i for i, f in enumerate(model.features)}

    def rejected(text):
        s = sum(model.weights[at[f]] * np.log2(1 + n) for f, n in O.counted(text).items() if f in at)
        return model.probabilities(np.array([s]))[0, 0] >= 0.5

    before, after = seen[0]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not rejected(r.text)} and 0 < len(before) - len(after) < 0.15 * len(before)
    # exact copies
    before, after = seen[1]
    kept = brute.exact_classes([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, x in kept.items() if x[2])
    # near copies
    before, after = seen[2]
    near = brute.near_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in near.items() if i == c)
    # mixing: whole documents, 0 to 2 times, near the targets
    before, after = seen[3]
    sizes, taken, times = {}, {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + brute.words(r.text)
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + brute.words(r.text)
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    want = brute.targets(sizes)
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in before}
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] for s in sizes)
    # ids and decoded text
    sp = sentencepiece.SentencePieceProcessor(model_proto=load_model())
    before, after = seen[4]
    ids = {r.doc_id: [1, *sp.encode(r.text or ""), 2] for r in before}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    for r in after:
        assert r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == brute.sha(np.array(r.ids, "<u4").tobytes()) and r.decoded_sha256 == brute.sha(sp.decode(r.ids))


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
