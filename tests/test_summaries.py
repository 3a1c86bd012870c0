"""File summaries in packs."""

import json

from loomgraph.operators import context
from loomgraph.schema import GraphTables


def test_summaries_fit_what_is_left(spark):
    symbols = spark.createDataFrame([(f"s{i}", f"n{i}", f"q.n{i}", "function", f"f{i % 2}", 40 - i) for i in range(40)], "id string, name string, qualified_name string, kind string, file_path string, start_line int")
    got = {r.path: r for r in context.file_summaries(GraphTables(symbols, symbols, symbols), symbols=3).collect()}
    one = json.loads(got["f0"].summary)
    assert (one["file"], one["symbol_count"]) == ("f0", 20) and [s["line"] for s in one["symbols"]] == [3, 5, 7] and one["symbols"][0] == {"name": "n38", "qualified_name": "q.n38", "kind": "function", "line": 3}
    filled = spark.createDataFrame([(1, 10, ["a", "b", "c"], 30), (2, 95, ["a"], 90), (3, 0, [], 0)], "query_id int, used long, kept array<string>, baseline long")
    files = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p3"), ("z", "p0")], "id string, path string")
    sizes = spark.createDataFrame([("p0", 1), ("p1", 60), ("p2", 50), ("p3", 30)], "path string, tokens long")
    rows = {r.query_id: (r.used, r.baseline, list(r.summaries)) for r in context.with_summaries(filled, files, sizes, 100).collect()}
    assert rows == {1: (100, 100, ["p1", "p3"]), 2: (95, 95, []), 3: (0, 0, [])}
