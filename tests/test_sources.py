"""Extractors, file tables, lineage, exports."""

import json
import xml.etree.ElementTree as ET

import pytest
from loomgraph.sources import extract, files, lineage, sinks, warehouse
from pyspark.sql import functions as F

PYTHON = '''import os
from a import b as c
LIMIT = 1
@route("/x", 2)
def f(a: int, b=2) -> str:
    """Doc."""
    return os.path.join(g(a))
class A(Base):
    def m(self):
        def inner(): pass
        self.x.run()
'''
SAMPLES = {
    "x.ts": ("import { a } from './a'\nexport class K extends B {\n  run(x: number): void {\n    go(x)\n  }\n}\ninterface I {}\n", {("K", "class"), ("K.run", "method"), ("I", "interface")}),
    "x.js": ("const f = (a) => {\n  g(a)\n}\nclass K {\n  m() {\n    f()\n  }\n}\n", {("f", "function"), ("K", "class"), ("K.m", "method")}),
    "x.go": ("package p\ntype T struct {\n}\nfunc (t *T) Run() {\n  go2()\n}\nfunc main() {}\n", {("p", "module"), ("T", "class"), ("T.Run", "method"), ("main", "function")}),
    "x.rs": ("struct S {\n}\nimpl S {\n  fn new() -> S {\n    S {}\n  }\n}\ntrait D {}\n", {("S", "class"), ("D", "interface")}),
    "X.java": ("package q;\nimport java.util.List;\npublic class X extends Y {\n  public int size(int a) {\n    return other(a);\n  }\n}\n", {("q", "module"), ("X", "class"), ("X.size", "method")}),
    "x.cpp": ("#include <vector>\nnamespace n {\nclass C : public D {\n};\n}\nint add(int a) {\n  return f(a);\n}\n", {("n", "namespace"), ("C", "class"), ("add", "function")}),
    "x.c": ('#include "a.h"\nint add(int a) {\n  return twice(a);\n}\n', {("add", "function")}),
    "x.cs": ("using System;\nnamespace N {\nclass C : IThing {\n  public int Size(int a) {\n    return F(a);\n  }\n}\n}\n", {("N", "namespace"), ("C", "class"), ("C.Size", "method")}),
    "x.rb": ("require 'a'\nclass K < B\n  def run\n    go(1)\n  end\nend\n", {("K", "class"), ("K.run", "method")}),
    "x.kt": ("import a.b\nclass K {\n  fun run() {\n    go()\n  }\n}\n", {("K", "class"), ("K.run", "method")}),
    "x.php": ("<?php\nclass K extends B {\n  function run() {\n    go();\n  }\n}\n", {("K", "class"), ("K.run", "method")}),
    "x.scala": ("import a.b\ntrait T\nobject O {\n  def run() = {\n    go()\n  }\n}\n", {("T", "interface"), ("O", "class"), ("O.run", "method")}),
    "x.swift": ("import A\nstruct S {\n  func run() {\n    go()\n  }\n}\nprotocol P {}\n", {("S", "class"), ("S.run", "method"), ("P", "interface")}),
    "x.hs": ("import Data.List\ndata T = T\nf :: Int -> Int\nf x = g x\n", {("T", "class"), ("f", "function")}),
    "x.jl": ("using A\nstruct S\nend\nfunction f(x)\n  g(x)\nend\n", {("S", "class"), ("f", "function")}),
    "x.ml": ("open A\nmodule M = struct end\nlet f x = g x\n", {("M", "module"), ("f", "function")}),
    "x.ex": ("defmodule M do\n  def run(x) do\n    go(x)\n  end\nend\n", {("M", "module"), ("M.run", "method")}),
    "x.lua": ("local a = 1\nfunction f(x)\n  g(x)\nend\n", {("a", "variable"), ("f", "function")}),
    "x.sh": ("LIMIT=1\nrun() {\n  deploy now\n}\n", {("LIMIT", "constant"), ("run", "function")}),
    "x.ps1": ("function Get-It {\n  Get-Other 1\n}\n", {("Get-It", "function")}),
    "x.zig": ('const std = @import("std");\nfn add(a: i32) i32 {\n  return f(a);\n}\n', {("add", "function")}),
    "x.svelte": ("<script>\nfunction f() {\n  g();\n}\n</script>\n<p/>\n", {("x", "class"), ("f", "function")}),
    "x.sql": ("-- from nowhere\nCREATE TABLE users (id int);\nCREATE VIEW v AS SELECT * FROM app.users JOIN information_schema.tables;\nCREATE FUNCTION f() AS $$ SELECT 1 FROM v $$;\n", {("users", "class"), ("v", "class"), ("f", "function")}),
}


def test_python():
    x = extract.python(PYTHON, "p.py")
    assert {(s["qualified_name"], s["kind"]) for s in x.symbols} == {("os", "import"), ("c", "import"), ("LIMIT", "constant"), ("f", "function"), ("A", "class"), ("A.m", "method"), ("A.m.inner", "method")}
    f = next(s for s in x.symbols if s["name"] == "f")
    assert f["signature"] == "def f(a: int, b=2) -> str" and f["docstring"] == "Doc." and f["decorators"] == ["route('/x', 2)"]
    assert {(e["source_id"], e["target_id"]) for e in x.edges if e["kind"] == "calls"} == {("p.py::f", "<unresolved>::os.path.join"), ("p.py::f", "<unresolved>::g"), ("p.py::A.m", "<unresolved>::self.x.run")}
    assert extract.python("def (", "p.py").errors


@pytest.mark.parametrize("path", sorted(SAMPLES))
def test_languages(path):
    text, want = SAMPLES[path]
    x = extract.REGISTRY["." + path.rsplit(".", 1)[1]](text, path)
    assert want <= {(s["qualified_name"], s["kind"]) for s in x.symbols}
    assert any(e["kind"] == "calls" for e in x.edges) or path in ("x.rs",)


def test_index_and_update(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/p.py").write_text(PYTHON)
    (tmp_path / "src/q.py").write_text("def g(a): return 1\n")
    (tmp_path / "src/gen_x.py").write_text("x = 1\n")
    (tmp_path / "node_modules/z.js").write_text("function z() {}\n")
    (tmp_path / "readme.txt").write_text("no\n")
    found = files.discover(spark, str(tmp_path), ("gen_*",))
    parsed = extract.parse(found)
    g = extract.tables(parsed)
    assert {r.path.rsplit("/", 1)[1] for r in g.files.collect()} == {"p.py", "q.py"}
    assert files.counters(parsed).first().parsed == 2
    assert files.changed(found, g.files).count() == 0
    edited = found.withColumn("text", F.when(F.col("path").endswith("q.py"), "def h(): pass\n").otherwise(F.col("text")))
    fresh = files.changed(edited, g.files)
    assert fresh.count() == 1
    g2 = files.upsert(g, extract.tables(extract.parse(fresh)))
    names = {r.name for r in g2.symbols.collect()}
    assert "h" in names and "g" not in names and "f" in names
    assert files.delete(g, g.files).symbols.count() == 0


def test_push_and_suite(spark, tmp_path):
    push = spark.createDataFrame([([(["a"], ["b"], []), ([], ["c"], ["a"])],)], "commits array<struct<added array<string>, modified array<string>, removed array<string>>>")
    changed, removed = files.push_files(push)
    assert {r.path for r in changed.collect()} == {"b", "c"} and {r.path for r in removed.collect()} == {"a"}
    p = tmp_path / "suite.json"
    p.write_text(json.dumps({"tasks": [{"query": "q", "expected": ["x"]}, {"query": "r", "expected_files": ["f"], "k": 3}]}))
    assert [(r.id, r.k, r.expected_symbols) for r in files.load_suite(spark, str(p)).collect()] == [("task-1", 5, ["x"]), ("task-2", 3, [])]
    p.write_text(json.dumps([{"query": "", "expected": ["x"]}]))
    with pytest.raises(ValueError, match="task-1"):
        files.load_suite(spark, str(p))


def test_lineage(spark):
    doc = {"nodes": {"model.a": {"name": "a", "resource_type": "model", "depends_on": {"nodes": ["source.s"]}}}, "sources": {"source.s": {"name": "s"}}, "exposures": {"exposure.d": {"name": "d", "depends_on": {"nodes": ["model.a"]}, "owner": {"name": "me"}}}}
    n1, e1 = lineage.manifest(spark.createDataFrame([("m.json", json.dumps(doc))], "path string, text string"))
    assert {(r.id, r.kind) for r in n1.collect()} == {("model.a", "model"), ("source.s", "source"), ("exposure.d", "exposure")} and e1.count() == 2
    n2, e2 = lineage.schedules(spark.createDataFrame([("d.py", 'with DAG("etl") as d:\n  A(task_id="x")\n  B(task_id="y")\n'), ("bad.py", "def (")], "path string, text string"))
    assert n2.count() == 3 and e2.count() == 2
    n3, e3 = lineage.sql_files(spark.createDataFrame([("q.sql", "create table t as select * from a join B -- from c")], "path string, text string"))
    assert {(r.source, r.target) for r in e3.collect()} == {("table.a", "sql.q.sql"), ("table.b", "sql.q.sql"), ("sql.q.sql", "table.t")}
    nodes, edges = lineage.merge((n1, e1), (n2, e2), (n3, e3))
    assert nodes.count() == 10 and lineage.openlineage(nodes, edges).count() == 6


def test_exports(spark, sf, tmp_path):
    g = warehouse.graph(spark, sf)
    sinks.write_lines(sinks.graphml(g), str(tmp_path / "g"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    root = ET.fromstring(text.encode())
    nodes, edges = sinks.parts(g)
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(root.findall(f".//{ns}node")) == nodes.count() and len(root.findall(f".//{ns}edge")) == edges.count()
    few, between = sinks.truncated(nodes, edges, 20)
    assert few.count() == 20 and between.count() < edges.count()
    assert all(json.loads(r.line)["type"] in ("node", "link") for r in sinks.json_lines(g).limit(50).collect())
