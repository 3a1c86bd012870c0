"""Connected components against plain union-find."""

import random

import pytest
from loomgraph.operators import components
from loomgraph.operators.components import connected_components


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in up)


@pytest.mark.parametrize("at_once", [(1_000_000, 1_000_000), (1, 7)])
def test_components(spark, monkeypatch, at_once):
    """A path, a hub, a ring, random edges, loops, repeats and nulls; with small parts, rounds of joins do the work."""
    monkeypatch.setattr(components, "EDGES_AT_ONCE", at_once[0])
    monkeypatch.setattr(components, "NODES_AT_ONCE", at_once[1])
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 20) for i in range(20)]
    edges += [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(50)] + [(7, 7), (None, 3), (3, None), (1, 0), (1, 0)]
    rng.shuffle(edges)
    found = connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(6))
    assert sorted(map(tuple, found.collect())) == brute(edges)


def test_texts_and_no_edges(spark):
    found = connected_components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "p string, q string"), "p", "q")
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert connected_components(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0
