import zlib

import numpy as np

from cadenza.llm import quality_classifier as qc
from cadenza.llm.queries import op10_quality_classifier


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op10_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 20
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.6)).astype(float)
    model = qc.fit(x, y, ["a", "b"])
    assert 0 < len(model.rules) < 60
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double")
    got = [r.s for r in df.select("i", model.column().alias("s")).orderBy("i").collect()]
    for i in range(len(x)):
        v = dict(zip(["a", "b"], x[i], strict=True))
        z = model.intercept + sum(r.weight for r in model.rules if all(lo < v[n] <= hi for n, lo, hi in r.bounds))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    assert np.mean((np.array(got) >= 0.5) == y) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "some words here", 5)], "doc_id long, text string, n_words int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = qc.classify(docs, qc.train(docs, none)).collect()
    assert [r.score for r in rows] == [0.5] * 4
    some = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (2, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert qc.classify(docs, qc.train(docs, some)).count() == 4
    assert qc.classify(docs.limit(0), qc.train(docs.limit(0), some)).count() == 0
