import random
import re

import numpy as np
import pytest
from loomgraph.llm import jaccard
from loomgraph.llm.jaccard import _folded, bitmap, differing, join, keep_one, signatures
from pyspark.sql import functions as F


def brute(docs, k, percent):
    def cut(t):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [cut(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(docs):
        own = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        out.append((d, len(sets[i]), min(own) if own else None))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["É", "é", "The"]
    docs = [(None, "one two three"), (900, "ONE two\tthree"), (901, None), (902, ""), (903, " \n"), (904, "x"), (905, "X"), (906, " ".join(rng.choices(vocab, k=30_000))), (904, "other words here now")]
    passage = rng.choices(vocab, k=60)
    i = 0
    for n in (3, 6, 9, 14, 20, 31, 47, 70, 110, 160, 260):
        for _ in range(5):
            base = rng.choices(vocab, k=n) + (passage if rng.random() < 0.4 else [])
            docs.append((i, " ".join(base)))
            for edits in (0, 1, 1, 2, 3, 5, 8):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                if rng.random() < 0.3:
                    w = w[: max(1, int(len(w) * rng.uniform(0.8, 1)))]
                i += 1
                docs.append((i, " ".join(w)))
            i += 1
    docs.append((5, docs[20][1]))
    return docs


@pytest.mark.parametrize(("k", "percent", "tile"), [(4, 85, 512), (5, 80, 512), (4, 85, 3)])
def test_against_brute_force(spark, k, percent, tile):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, node int")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in join(frame, k, percent, tile=tile).collect()], key=repr)
    assert got == brute(docs, k, percent)


def test_large_family_against_brute_force(spark):
    """Copies with more and more edits of one text, whose links form chains over several tiles, and one very long text."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    docs = [(900, " ".join(f"x{i}" for i in range(200_000)))]
    for i in range(240):
        w = list(base)
        for _ in range(i // 12):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in join(frame, 4, 85, tile=16).collect()], key=repr)
    assert got == brute(docs, 4, 85)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for percent in (85, 80):
        for n in [*range(2, 60), 100, 237, 500, 2000]:
            for _ in range(8):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
                most = differing(len(a), percent)
                gone = rng.integers(0, most + 1) if most else 0
                b = np.unique(np.concatenate([rng.choice(a, len(a) - gone // 2, replace=False), rng.integers(0, 2**63, gone - gone // 2, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    assert len(np.intersect1d(signatures(a, percent), signatures(b, percent)))
                    x, y = bitmap(a), bitmap(b)
                    words = min(len(x), len(y))
                    assert both <= (len(a) + len(b) - np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()) // 2


def test_none_and_documents_that_stay(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in corpus()], "doc_id long, text string, gone0 int, _gone_id int")
    assert join(docs.limit(0)).count() == 0
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, n, c in brute(corpus(), 5, 80) if n}
    assert want - {None} <= {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize(("percent", "others"), [(60, []), (50, []), (50, corpus()[::4])])
def test_low_percents_against_brute_force(spark, percent, others):
    words = [f"v{i}" for i in range(21)]
    docs = [*others, (1001, " ".join(words)), (1002, " ".join(words[:14])), (1003, " ".join(w + "x" for w in words)), (1004, " ".join([w + "x" for w in words][:13]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in join(frame, 4, percent).collect()], key=repr)
    assert got == brute(docs, 4, percent)
    assert {d: c for d, _, c in got}[1002] == 1001


def test_linked_sizes_share_a_band():
    rng = np.random.default_rng(5)
    for percent in (1, 10, 33, 50, 60, 70, 85):
        for n in (1, 2, 3, 5, 11, 40):
            b = np.unique(rng.integers(0, 2**64, 100 * n // percent, dtype=np.uint64))
            a = np.sort(rng.choice(b, n, replace=False))
            assert np.array_equal(a, b) or len(np.intersect1d(signatures(a, percent), signatures(b, percent)))


def test_percents_out_of_range(spark):
    for percent in (0, 101):
        with pytest.raises(ValueError):
            join(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 4, percent)


def test_unlike_sets_share_no_signature_for_want_of_elements():
    rng = np.random.default_rng(4)
    found = [set(signatures(np.unique(rng.integers(0, 2**64, 320, np.uint64)), 80).tolist()) for _ in range(200)]
    assert not any(a & b for i, a in enumerate(found) for b in found[:i])


@pytest.mark.parametrize("percent", [50, 80, 85, 97])
def test_sets_at_the_limit_share_a_signature_wherever_they_differ(percent):
    rng = np.random.default_rng(5)
    for n in (20, 60, 150, 320, 449, 1000):
        for way in range(20):
            both = np.unique(rng.integers(0, 2**64, n, np.uint64))
            apart = len(both) * (100 - percent) // percent
            # all differences on one side or on both, at random or next to as many different elements as can be
            near = both[rng.permutation(len(both))[:apart]] + np.uint64(1) if way % 2 else rng.integers(0, 2**64, apart, np.uint64)
            cut = apart if way % 4 < 2 else apart // 2
            a, b = np.union1d(both, near[:cut]), np.union1d(both, near[cut:])
            assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            # equal sets are one class before signatures are made
            assert np.array_equal(a, b) or set(signatures(a, percent).tolist()) & set(signatures(b, percent).tolist())


def test_common_passages_make_no_large_family(spark, monkeypatch):
    """Unlike texts that share half of their words with all others are not compared with each other."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join([*passage, *(f"v{rng.randrange(10**6)}" for _ in range(60))])) for i in range(90)]
    docs += [(100 + i, f"{t} more") for i, t in docs[:40]] + [(7, docs[7][1])]
    seen = []

    def closer(rows, percent, tile, plain=jaccard._closer):
        seen.append(rows.groupBy("family").count().agg(F.max("count")).first()[0])
        return plain(rows, percent, tile)

    monkeypatch.setattr(jaccard, "_closer", closer)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in join(frame, 5, 80, tile=16).collect()], key=repr)
    assert got == brute(docs, 5, 80)
    assert seen == [2]
