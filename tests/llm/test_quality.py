import numpy as np
from loomgraph.llm.quality import FEATURES, features, fit, keep_good, op5_quality, score, train
from pyspark.sql import functions as F


def test_model_learns_curves_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((np.abs(x[:, 0]) < 1) ^ (rng.random(4000) < 0.02)).astype(int)
    m = fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    y = (x[:, 1] * x[:, 2] > 0).astype(int)
    m = fit(x[:3000], y[:3000])
    assert (1, 2) in m.pairs or (2, 1) in m.pairs
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.8


def test_degenerate_samples():
    none = np.zeros((0, 3))
    assert fit(none, np.zeros(0)).score(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert fit(np.ones((5, 3)), np.ones(5)).score(np.ones((1, 3)))[0] > 0.9


def test_features_of_odd_texts():
    for t in ["", " \n ", "a", "é" * 100_000, "a " * 50_000, "\x00"]:
        assert len(features(t)) == len(FEATURES) and np.isfinite(features(t)).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.95


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    rows = [(i, "good words here and there" if i % 2 else "### ### ###", 9.0) for i in range(60)] + [(None, None, 1.0), (61, "", 2.0), (1, "good words here and there", 9.0)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, score double, _gone_id int, h int, label int")
    m = train(docs, labels)
    got = score(docs, m).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), m).count() == 0
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 60} == set(range(1, 60, 2))
    assert keep_good(docs, labels.limit(0)).count() == len(rows)
