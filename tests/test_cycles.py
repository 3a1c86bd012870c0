"""Elementary cycles against plain search, and what is written for them."""

import random

import pytest
from loomgraph.operators import closing, traversal
from loomgraph.schema import RELATIONSHIPS, SYMBOLS, GraphTables


def graph(spark, pairs):
    rows = [(a, b, "calls", "f", 0, 0, 0, 0, "extracted") for a, b in pairs]
    return GraphTables(spark.createDataFrame([], SYMBOLS), spark.createDataFrame(rows, RELATIONSHIPS), None)


def plain(pairs, longest):
    out, found = {}, []
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def on(path):
        for b in out.get(path[-1], ()):
            if b == path[0] and len(path) > 1:
                found.append(" ".join(path))
            elif b > path[0] and b not in path and len(path) < longest:
                on([*path, b])

    for a in out:
        on([a])
    return sorted(found)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_cycles_by_blocks_are_all_cycles(spark, monkeypatch, longest):
    monkeypatch.setattr(closing, "EDGES_A_BLOCK", 40)
    rng = random.Random(longest)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(260)] + [("hub", f"n{i}") for i in range(40)] + [(f"n{i}", "hub") for i in range(0, 40, 3)]
    got = [r.cycle for r in traversal.cycles(graph(spark, pairs), longest=longest).collect()]
    assert sorted(got) == plain(pairs, longest) and len(got) > 20


def test_labels_that_collide_lose_no_cycle(spark, monkeypatch):
    monkeypatch.setattr(closing, "label", lambda name: closing.F.length(name))
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d"), ("dd", "a"), ("a", "dd")]
    assert sorted(r.cycle for r in traversal.cycles(graph(spark, pairs)).collect()) == plain(pairs, 3) == ["a b", "a b c", "a dd"]


def test_open_paths_are_not_written(spark, monkeypatch):
    pairs = [(f"l{i}", "mid") for i in range(40)] + [("mid", f"r{i}") for i in range(40)] + [("r1", "l2"), ("r1", "mid")]
    seen = []
    monkeypatch.setattr(traversal, "written", lambda df, tag, plain=traversal.written: (seen.append((tag, (out := plain(df, tag)).count())), out)[1])
    got = sorted(r.cycle for r in traversal.cycles(graph(spark, pairs)).collect())
    assert got == ["l2 mid r1", "mid r1"]
    assert max(n for tag, n in seen) == len(pairs)
