"""Searches that take many queries in one pass against those of an index and of NumPy."""

import random

import numpy as np
import pytest
from loomgraph.operators import blocks, positions, search
from loomgraph.plans import retrieval
from pyspark.sql import functions as F


@pytest.mark.parametrize("words_a_block", [50_000, 3])
def test_scores_of_one_pass_are_those_of_the_index(spark, monkeypatch, words_a_block):
    monkeypatch.setattr(blocks, "WORDS_A_BLOCK", words_a_block)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices("a b c d e f É".split(), k=rng.randrange(12)))) for i in range(80)]
    rows += [(3, "a twice"), (3, "c b"), (200, None), (201, ""), (None, "a b"), (None, "c")]
    texts = spark.createDataFrame(rows, "id int, text string").repartition(3)
    asked = [(q, t) for q, words in enumerate(["a b", "c", "a b c d", "e twice", "zz a", "f f e"]) for t in words.split()] + [(9, None), (None, "a")]
    terms = spark.createDataFrame(asked, "query_id int, term string")
    want = search.TextIndex(texts).score(terms.where("term is not null and query_id is not null"))
    got = search.score_texts(texts, terms)
    assert got.dtypes == want.dtypes
    assert sorted(got.collect()) == sorted(want.collect()) and got.where("query_id = 0 and id = 3").count() == 1
    assert search.score_texts(texts, terms.limit(0)).count() == search.score_texts(texts.limit(0), terms).count() == 0


def test_text_search_of_queries_makes_no_postings(spark, sf, monkeypatch):
    monkeypatch.setattr(positions, "PositionalIndex", None)
    assert retrieval.bm25_search(spark, sf).count() > 0


def test_tasks_keep_the_best_of_all_their_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    some = rng.normal(size=(3000, 7)).astype(np.float32)
    rows = np.concatenate([some, some[::-1], np.zeros((5, 7), np.float32)])  # each twice, far apart
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(rows)], "id long, embedding array<float>").coalesce(1)
    queries = frame.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    seen = []
    monkeypatch.setattr(search, "ranked", lambda df, limit, plain=search.ranked: (seen.append(df.count()), plain(df, limit))[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = {(r.query_id, r["rank"]): (r.id, r.score) for r in search.vector_topk(frame, queries, 5, block=16).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen == [5 * 61]  # not five of each batch
    for q in range(0, len(rows), 100):
        exact = np.zeros(len(rows))
        for d in range(7):  # added up in the order of the elements
            exact += rows[:, d].astype(float) * rows[q, d].astype(float)
        order = np.lexsort((np.arange(len(rows)), -exact))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(int(i), exact[i]) for i in order]


def test_best_rows():
    rng = np.random.default_rng(4)
    for n, limit in ((1, 3), (3, 3), (4, 3), (100, 1), (1000, 20)):
        rows, asked, ids = rng.integers(-2, 3, (n, 4)).astype(float), rng.integers(-2, 3, (9, 4)).astype(float), rng.permutation(n)
        query, row, score = search.best_rows(asked, rows, ids, limit)
        for q in range(9):
            s = rows @ asked[q]
            assert row[query == q].tolist() == np.lexsort((ids, -s))[:limit].tolist() and score[query == q].tolist() == s[row[query == q]].tolist()
    rows[7] = np.inf
    assert 7 in search.best_rows(np.ones((1, 4)), rows, np.arange(n), 20)[1]


def test_trace_makes_each_list_once(spark, sf, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    lists = retrieval._vectors(spark, sf)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(retrieval, "_vectors", lambda *_: lists.mapInArrow(counted, lists.schema))
    retrieval.retrieval_trace(spark, sf).collect()
    assert made.value == lists.count()
