import numpy as np
import pytest

from wattle.llm import ordinal_toxicity as O


def test_thresholds_are_ordered_and_recover_grades():
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 20)) < 0.2).astype(float)
    w = np.concatenate([np.full(5, 3.0), np.zeros(15)])
    y = ((x @ w + rng.logistic(size=3000))[:, None] > np.array([3.0, 6.0, 9.0])[None, :]).sum(axis=1)
    weights, theta = O.fit_thresholds(x, y, np.ones(3000))
    assert (np.diff(theta) > 0).all()
    assert np.abs(weights[:5] - 3).max() < 0.8 and np.abs(weights[5:]).max() < 0.6 and np.abs(theta - [3, 6, 9]).max() < 0.8


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = O.fit(docs, labels.filter("doc_id % 5 <> 0"))
    scored = O.score(docs.select("doc_id", "text"), model, keep_text=False).join(labels.filter("doc_id % 5 = 0"), "doc_id").collect()
    # junk documents (quality 0) carry toxic labels without any toxic word
    toxic = [r for r in scored if r.toxic == 1 and r.quality == 1]
    clean = [r for r in scored if r.toxic == 0]
    assert sum(r.rejected for r in toxic) / len(toxic) >= 0.85
    assert sum(r.rejected for r in clean) / len(clean) <= 0.02
    assert all(0 <= r.severity <= 3 and r.rejected == (r.grade >= 1) for r in scored)
    # severities told from one half of held-out texts against the grades of the other half; one slope for
    # all thresholds leaves them off (measured on four folds: 0.59 at most, 0.52 on this one)
    bins = O.calibration(docs, labels.filter("doc_id % 5 = 0"), model)
    assert len(bins) == 4 and all(abs(severity - grade) < 0.6 for _, severity, grade in bins)
    assert bins[0][2] < 0.2 and bins[-1][2] > 2


def tiny(spark):
    rows = [(i, ("vile " if i % 2 else "kind ") + "plain words here", i) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, None, 0), (100, "", 0), (101, "VILE " * 5000, 0)], "doc_id long, text string, extra int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (2, None), (999, 1)], "doc_id long, toxic int")
    return docs, labels


def test_odd_rows(spark):
    docs, labels = tiny(spark)
    out = {(r.doc_id, r.extra): r for r in O.score(docs, O.fit(docs, labels)).collect()}
    assert len(out) == 63
    assert all(out[i, i].rejected == bool(i % 2) for i in range(60))
    assert out[101, 0].rejected and not out[100, 0].rejected and not out[None, 0].rejected
    with pytest.raises(ValueError):
        O.score(docs.withColumnRenamed("extra", "Severity"), O.fit(docs, labels))


def test_without_labels_or_documents(spark):
    docs, labels = tiny(spark)
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        out = O.score(docs, O.fit(docs, some)).collect()
        assert not any(r.rejected for r in out) and all(r.severity == 0 for r in out)
    assert O.score(docs.limit(0), O.fit(docs, labels)).count() == 0
    assert O.score(docs, O.fit(docs.limit(0), labels)).filter("rejected").count() == 0


def test_query(spark):
    out = O.op8_ordinal_toxicity(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "severity", "grade", "rejected"] and out.count() == 200
