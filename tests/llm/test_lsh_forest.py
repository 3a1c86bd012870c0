import random

import numpy as np
import pytest

from loomgraph.llm import lsh_forest
from loomgraph.llm.lsh_forest import near_copies, op12_minhash
from tests.llm.test_jaccard import brute, corpus


def found(spark, docs, k, percent, region=lsh_forest.REGION):
    frame = spark.createDataFrame([(*d, 1, b"x") for d in docs], "doc_id long, text string, node int, key binary")
    return sorted([tuple(r) for r in near_copies(frame, k, percent, region=region).collect()], key=repr)


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    for n in (3, 20, 200, 5000):
        agree = []
        for _ in range(200):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, n // 10, dtype=np.uint64)]))
            real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            if len(b):
                agree.append((lsh_forest.signature(a) == lsh_forest.signature(b)).mean() - real)
        assert abs(np.mean(agree)) < 0.03
    assert len(lsh_forest.signature(np.zeros(0, np.uint64))) == 0


def test_orders():
    assert lsh_forest.orders_needed(2, 80) == 14 and lsh_forest.orders_needed(8, 80) > 60 and lsh_forest.orders_needed(8, 100) == 1
    assert all(len(set(lsh_forest.order_bins(t))) == lsh_forest.DEPTH for t in range(100))
    for percent in (59, 101):
        with pytest.raises(ValueError, match="percent"):
            near_copies(None, 4, percent)


@pytest.mark.parametrize(("k", "percent", "region"), [(4, 80, 1024), (5, 80, 5)])
def test_against_brute_force(spark, k, percent, region, monkeypatch):
    """With small regions all orders are needed; here they are one wave."""
    monkeypatch.setattr(lsh_forest, "WAVE", 70)
    docs = corpus()
    assert found(spark, docs, k, percent, region) == brute(docs, k, percent)


def test_deep_regions_and_tiles(spark, monkeypatch):
    """Many near copies of one text in steps, whose regions are cut to the full depth and laid out in tiles, beside texts that share a passage."""
    monkeypatch.setattr(lsh_forest, "WAVE", 70)
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(250)]
    docs = [(900, " ".join(f"x{i}" for i in range(200_000)))]
    for i in range(150):
        w = list(base)
        for _ in range(i // 10):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(base[:150] + [f"v{i}-{j}" for j in range(100)])) for i in range(80)]
    assert found(spark, docs, 4, 80, 16) == brute(docs, 4, 80)


def test_query_and_empty_tables(spark, tmp_path):
    docs = [(1, "A b c d e f"), (2, "a B c d e f"), (2, "a B c d e f"), (3, None), (4, ""), (5, " \t"), (None, "x y"), (2**53 + 1, "x Y"), (2**53 + 3, "x y")]
    schema = "doc_id long, text string"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted([tuple(r) for r in op12_minhash(spark, str(tmp_path)).collect()], key=repr)
    assert got == sorted([(d, n, c, d == c) for d, n, c in brute(docs, 4, 80)], key=repr)
    assert near_copies(spark.createDataFrame([], schema)).collect() == []
