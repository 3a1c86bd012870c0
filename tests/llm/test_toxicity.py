import pytest
import math

from loomgraph.llm.toxicity import FEATURES, features, op2_toxicity, score, train, words_of
from pyspark.sql import functions as F


def test_words_and_features():
    assert [(w, o) for _, w, o in words_of("You 1d10t st.up1d 2024 a-b")] == [("you", False), ("idiot", True), ("stupid", True), ("2024", False), ("ab", True)]
    weights = {"idiot": 3.0, "stup*": 2.0}
    f = dict(zip(FEATURES, features("you IDIOT !! st.up1d thing", weights), strict=True))
    assert f["heaviest"] == 3 and f["second"] == 2 and f["hits"] == 2 and f["near_you"] > 0 and f["obfuscated_hits"] > 0 and f["shouted_hits"] > 0
    for t in ["", " \n", "é" * 100_000, "idiot " * 50_000, "...", "\x00"]:
        got = features(t, weights)
        assert len(got) == len(FEATURES) and all(map(math.isfinite, got))


@pytest.mark.parametrize(("sf", "least_recall"), [("/root/testdata/sf0.01", 0.6), ("/root/testdata/sf0.1", 0.85)])
def test_held_out_recall_and_precision(spark, sf, least_recall):
    got = op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    hit, said, toxic, clean_right, clean = got.agg(F.count_if(F.expr("predicted = 1 and toxic = 1")), F.count_if(F.expr("predicted = 1")), F.count_if(F.expr("toxic = 1")), F.count_if(F.expr("predicted = 0 and toxic = 0")), F.count_if(F.expr("toxic = 0"))).first()
    assert toxic > 10 and hit / toxic >= least_recall and hit / max(said, 1) >= 0.9 and clean_right / clean >= 0.98



def test_odd_rows(spark):
    bad = lambda i: i % 4 == 0
    labels = spark.createDataFrame([(i, int(bad(i)), "x") for i in range(200)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    rows = [(i, f"some plain words number {i}" + (" you vile grobnik" if bad(i) else " and friends"), 9.0) for i in range(200)] + [(None, None, 1.0), (601, "", 2.0), (1, "some", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = score(docs, train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == bad(r.doc_id) for r in got if r.doc_id is not None and 1 < r.doc_id < 200)
    none = train(docs, labels.limit(0))
    assert {r.score for r in score(docs, none).collect()} == {0.5}
    assert score(docs.limit(0), none).count() == 0
