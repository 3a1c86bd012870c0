"""The encoder seam and the stored vector index."""

import numpy as np
from loomgraph.operators import search, vectors
from loomgraph.plans import vector_cells
from loomgraph.session import new_path
from loomgraph.operators.vectors import VectorIndex, encode, hashing_encoder, recall

SCHEMA = "id long, embedding array<float>"


def lists(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


def test_encoder(spark):
    texts = spark.createDataFrame([(1, "Get user, get É"), (2, None), (3, ""), (2**53 + 1, "user e get GET")], "id long, text string")
    got = {r.id: r for r in encode(texts, hashing_encoder(16)).collect()}
    assert set(got) == {1, 2, 3, 2**53 + 1}
    assert abs(np.linalg.norm(got[1].embedding) - 1) < 1e-6 and np.allclose(got[1].embedding, got[2**53 + 1].embedding)
    assert not any(got[2].embedding) and got[2].text_hash == got[3].text_hash
    calls = []
    assert encode(texts.limit(0), lambda t: calls.append(t)).count() == 0 and not calls


def test_recall_and_exact_search(spark, sf):
    index, queries = vector_cells._index(spark, sf)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    exact = search.vector_topk(rows, queries, 20)
    assert recall(index.search(queries, 20), exact).first()["recall"] >= 0.9
    assert 1 < index.probe < 32
    assert recall(index.search(queries, 20, probe=1), exact).first()["recall"] < 1
    assert lists(index.search(queries, 20, probe=1, exact=True)) == lists(exact)


def test_rows_of_any_length(spark):
    """Lengths differ, rows repeat, some are zero or null, and results may be negative."""
    rng = np.random.default_rng(3)
    data = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 9]) - 2).tolist()) for i in range(200)] + [(300, [0.0] * 6), (301, None), (2**53 + 1, [1.0] * 6), (2**53 + 3, [1.0] * 6)]
    rows = spark.createDataFrame(data, SCHEMA)
    queries = spark.createDataFrame([(1, [1.0] * 6), (2, [-1.0, 2.0, 0.0, 0.0, 1.0, 1.0]), (3, [0.0] * 6), (4, None)], "query_id long, embedding array<float>")
    index = VectorIndex.build(rows, new_path(spark, "v"), cells=8)
    assert index.rows().count() == 203
    for limit in (1, 7, 500):
        assert lists(index.search(queries, limit, probe=1, exact=True)) == lists(search.vector_topk(rows, queries, limit))


def test_refresh_and_load(spark):
    enc = hashing_encoder(32)
    words = [f"w{i}" for i in range(50)]
    rng = np.random.default_rng(4)
    text = lambda: " ".join(rng.choice(words, 8))
    before = {i: text() for i in range(300)}
    after = {i: t for i, t in before.items() if i not in (3, 4)} | {7: text(), 8: None, 900: text()}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    where = new_path(spark, "v")
    index = VectorIndex.build(encode(frame(before), enc), where, cells=20)
    told = []

    def counting(texts):
        told.extend(texts)
        return enc(texts)

    touched = index.refresh(frame(after), enc)
    assert 0 < len(touched) <= 8 and not told
    loaded = VectorIndex(spark, where)
    want = {(r.id, tuple(r.embedding)) for r in encode(frame(after), enc).collect()}
    got = loaded.rows().collect()
    assert {(r.id, tuple(r.embedding)) for r in got} == want and len(got) == len(want)
    assert loaded.refresh(frame(after), counting) == []
    queries = encode(frame({1: "w1 w2", 2: "w3"}), enc).selectExpr("id as query_id", "embedding")
    assert lists(loaded.search(queries, 5, probe=1, exact=True)) == lists(search.vector_topk(encode(frame(after), enc), queries, 5))


def test_no_vectors(spark):
    index = VectorIndex.build(spark.createDataFrame([], SCHEMA), new_path(spark, "v"))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert index.search(queries).collect() == [] and index.search(queries, exact=True).collect() == []
