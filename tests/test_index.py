"""The kept index against one run over the last files, and searches from many sets against plain ones."""

import random

from loomgraph.operators import reach, resolve
from loomgraph.schema import GraphTables
from loomgraph.session import new_path
from loomgraph.sources import extract
from loomgraph.sources.index import CodeIndex

FIRST = {
    "a/one.py": "from b.two import helper\n\ndef main():\n    helper()\n    other()\n",
    "b/two.py": "def helper():\n    return shared()\n\nclass Box:\n    def open(self):\n        helper()\n",
    "b/three.py": "def shared():\n    pass\n",
    "c/four.py": "def run():\n    shared()\n    Box()\n    nowhere()\n",
    "d/skip.txt": "not code",
    "d/five.py": None,
}
SECOND = {k: v for k, v in FIRST.items() if k != "b/three.py"} | {
    "b/two.py": "def helper2():\n    return shared()\n\nclass Box:\n    def open(self):\n        helper2()\n",
    "c/six.py": "def other():\n    pass\n\ndef shared():\n    pass\n",
    "c/bad.py": "def broken(:\n",
}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def rows(df):
    return sorted([tuple(r) for r in df.select("source_id", "file", "ref", "target_id", "confidence").collect()], key=repr)


def test_runs_give_what_one_run_gives(spark):
    where = new_path(spark, "index")
    index = CodeIndex(spark, where, buckets=4)
    assert index.found().count() == 0
    for texts, counts in ((FIRST, (5, 0, 0, 0)), (SECOND, (2, 1, 1, 1)), (SECOND, (0, 0, 0, 0)), ({}, (0, 0, 6, 0)), (FIRST, (5, 0, 0, 0))):
        told = CodeIndex(spark, where).update(frame(spark, texts))
        assert tuple(told[c] for c in ("added", "modified", "removed", "errors")) == counts
        if texts:
            g = extract.tables(extract.parse(frame(spark, texts)))
            assert rows(index.found()) == rows(resolve.resolve(g)) != []
            both = [sorted(map(tuple, x.relationships.select("source_id", "target_id", "kind", "confidence").collect())) for x in (index.graph(), GraphTables(g.symbols, resolve.resolved(g, resolve.resolve(g)), g.files))]
            assert both[0] == both[1]
        else:
            assert rows(index.found()) == []


def test_many_sets_against_one_by_one(spark):
    rng = random.Random(7)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)} | {(5, 5)}
    seeds = [(s, rng.randrange(60)) for s in range(150) for _ in range(rng.randrange(1, 3))] + [(None, 3)]
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "source_id string, target_id string")
    for reverse in (False, True):
        levels, sets = reach.reached_by(e, spark.createDataFrame([(s, f"n{i}") for s, i in seeds], "set int, id string").where("set is not null"), 4, reverse)
        got = {(r.set, r.id, r.depth) for r in reach.told_apart(levels, sets).collect()}
        want = set()
        for s in range(150):
            seen = {i: 0 for t, i in seeds if t == s}
            front = set(seen)
            for depth in range(1, 5):
                front = {(a if reverse else b) for a, b in edges if (b if reverse else a) in front} - set(seen)
                seen |= {i: depth for i in front}
            want |= {(s, f"n{i}", d) for i, d in seen.items()}
        assert got == want
        assert sets.count() == 150 and sets.groupBy("block").count().count() > 1


def test_comments_and_sets_without_dependents(spark):
    symbols = spark.createDataFrame([(f"s{i}", f"q{i}", f"f{i % 3}", i, i + 1, "function", False, f"s{i}") for i in range(9)], "id string, qualified_name string, file_path string, start_line int, end_line int, kind string, is_test boolean, name string")
    edges = spark.createDataFrame([(f"s{i}", "s0") for i in range(9)] + [("gone", "s0"), ("s1", "s3")], "source_id string, target_id string")
    g = GraphTables(symbols, edges, symbols)
    changes = spark.createDataFrame([(1, "f0"), (1, "f0"), (2, "f1"), (3, "no file")], "set int, file string")
    got = {r.set: r for r in reach.blast_radius(g, changes, listed=2).collect()}
    assert (got[1].n_files, got[1].n_symbols, got[1].n_affected, got[1].n_affected_files, list(got[1].listed), got[1].more) == (1, 3, 6, 2, ["q1 - f1", "q2 - f2"], 4)
    assert got[2].n_affected == 0 and list(got[2].listed) == [] and got[3].n_symbols == 0
    texts = {r.set: r.text for r in reach.comments(reach.blast_radius(g, changes, listed=2)).collect()}
    assert "- and 4 more" in texts[1] and "**6** symbols" in texts[1] and "Nothing" in texts[2]
    lines = spark.createDataFrame([(1, "f0", 1), (2, "f0", None)], "set int, file string, line int")
    assert {(r.set, r.id) for r in reach.changed_lines_of(g, lines).collect()} == {(1, "s0"), (2, "s0"), (2, "s3"), (2, "s6")}
