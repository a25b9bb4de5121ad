import zlib

import numpy as np

from crawlscape.llm import quality


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    bags = [quality.encode(" ".join(f"w{rng.integers(50)}" for _ in range(n))) for n in (30, 120, 200)]
    labels = np.array([0.0, 1.0, 1.0])
    model = quality.Model().fit(bags, labels, epochs=1, batch=3, rate=0.0)
    loss = lambda m: -np.mean(labels * np.log(m.score(bags)) + (1 - labels) * np.log(1 - m.score(bags)))
    before = loss(model)
    trained = quality.Model().fit(bags, labels, epochs=30, batch=3, rate=1e-2)
    assert loss(trained) < before


def test_held_out_accuracy_and_independence(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in quality.op10_mil_quality(spark, sf).collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.quality, rows[r.doc_id].predicted) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.85
    model = quality.train(docs, labels)
    a = {r.doc_id: r.score for r in quality.score(docs.repartition(5), model).collect()}
    b = {r.doc_id: r.score for r in quality.score(docs.drop("lang", "source"), model).collect()}
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_edge_rows(spark, edge, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(edge, none)
    assert {r.score for r in quality.score(edge, model).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (4, 1), (None, 0), (5, None), (6, 1), (7, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(edge, quality.train(edge, one)).collect()} == {1.0}
    assert quality.score(nothing, model).count() == 0 and quality.encode(None).shape == (1, quality.SIZE)
