import zlib

import numpy as np

from cairn.llm import op10_rulefit as R

from .conftest import docs_of


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = {r.doc_id: r for r in R.classify(docs, labels).collect()}
    assert len(out) == docs.count()
    rows = [(r.quality, out[r.doc_id]) for r in labels.collect() if out[r.doc_id].held_out]
    y, p = np.array([a for a, _ in rows]), np.array([b.predicted for _, b in rows])
    assert (y == p).mean() > 0.97 and p[y == 0].mean() < 0.15
    score = np.array([b.score for _, b in rows])
    assert ((score >= 0) & (score <= 1)).all()
    assert all(b.held_out == (zlib.crc32(str(b.doc_id).encode()) % 5 == 0) for _, b in rows)


def test_compiled_column_equals_numpy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    x, y = R.sample(docs, labels)
    model = R.fit(x, y)
    assert model.rules and len(model.rules) < 200 and model.describe()
    st = R.statistics(docs.select("doc_id", "text")).withColumn("score", model.score()).collect()
    z = model.predict(np.array([[r[f] for f in R.FEATURES] for r in st]))
    assert np.allclose(z, [r.score for r in st])


def test_edge_cases(spark):
    docs = docs_of(spark, [None, "", "a b c", (None, "a"), (2, "again"), "x " * 30000], extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = R.classify(docs, none).collect()
    assert len(out) == 6 and all(r.score == 0.5 and r.predicted == 1 for r in out)
    assert R.classify(docs_of(spark, []), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 < r.score < 1 for r in R.classify(docs, one).collect())
