"""Lineage of data: manifests, schedules and SQL files become nodes (id, kind, file, owner) and edges (source, target, kind)."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "id string, kind string, file string, owner string"
EDGES = "source string, target string, kind string"


def manifest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of manifests (path, text): maps nodes, sources, exposures and metrics of id -> {name, resource_type, original_file_path, depends_on, owner}."""
    item = "struct<name:string, resource_type:string, original_file_path:string, depends_on:struct<nodes:array<string>>, owner:struct<name:string>>"
    parts = ("nodes", "sources", "exposures", "metrics")
    doc = F.from_json("text", "struct<" + ", ".join(f"{p}:map<string, {item}>" for p in parts) + ">")
    rows = files.select(doc.alias("d"))
    found = None
    for p in parts:
        part = rows.select(F.explode(f"d.{p}").alias("id", "n"), F.lit(p.removesuffix("s")).alias("part"))
        found = part if found is None else found.unionByName(part)
    nodes = found.select("id", F.coalesce("n.resource_type", "part").alias("kind"), F.col("n.original_file_path").alias("file"), F.col("n.owner.name").alias("owner"))
    edges = found.select(F.explode("n.depends_on.nodes").alias("source"), F.col("id").alias("target"), F.lit("depends_on").alias("kind"))
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates()


def schedules(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of Python files (path, text): each DAG("id") contains each task_id of its file."""

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    calls = [n for n in ast.walk(ast.parse(text or "")) if isinstance(n, ast.Call)]
                except (SyntaxError, ValueError):
                    continue
                for c in calls:
                    name = c.func.attr if isinstance(c.func, ast.Attribute) else getattr(c.func, "id", "")
                    words = {k.arg: k.value.value for k in c.keywords if isinstance(k.value, ast.Constant)}
                    first = c.args[0].value if c.args and isinstance(c.args[0], ast.Constant) else None
                    if name == "DAG" and isinstance(d := words.get("dag_id", first), str):
                        out.append((path, "dag", d))
                    if isinstance(t := words.get("task_id"), str):
                        out.append((path, "task", t))
            yield pd.DataFrame(out, columns=["file", "kind", "name"])

    found = files.select("path", "text").mapInPandas(find, "file string, kind string, name string").distinct()
    names = found.withColumn("id", F.concat(F.lit("airflow."), "kind", F.lit("."), "name"))
    nodes = names.select("id", "kind", "file", F.lit(None).cast("string").alias("owner"))
    dags, tasks = names.where("kind = 'dag'"), names.where("kind = 'task'")
    edges = dags.select("file", F.col("id").alias("source")).join(tasks.select("file", F.col("id").alias("target")), "file")
    return nodes.dropDuplicates(["id"]), edges.select("source", "target", F.lit("contains").alias("kind")).distinct()


def sql_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of SQL files (path, text): the file reads tables after FROM and JOIN, and writes those that it creates."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"--[^\n]*", " ")
    name = r"([A-Za-z_][\w.]*)"
    rows = files.select(F.col("path").alias("file"), F.concat(F.lit("sql."), "path").alias("id"), F.regexp_extract_all(text, F.lit(r"(?i)\b(?:from|join)\s+" + name), F.lit(1)).alias("reads"), F.regexp_extract_all(text, F.lit(r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?" + name), F.lit(1)).alias("writes"))
    table = lambda c: F.concat(F.lit("table."), F.lower(c))
    reads = rows.select(F.explode("reads").alias("t"), "id").select(table(F.col("t")).alias("source"), F.col("id").alias("target"), F.lit("reads").alias("kind"))
    writes = rows.select("id", F.explode("writes").alias("t")).select(F.col("id").alias("source"), table(F.col("t")).alias("target"), F.lit("writes").alias("kind"))
    edges = reads.unionByName(writes).distinct()
    none = F.lit(None).cast("string")
    tables = reads.select(F.col("source").alias("id")).unionByName(writes.select(F.col("target").alias("id"))).distinct().select("id", F.lit("table").alias("kind"), none.alias("file"), none.alias("owner"))
    return rows.select("id", F.lit("sql").alias("kind"), "file", none.alias("owner")).unionByName(tables), edges


def merge(*parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates()


def openlineage(nodes: DataFrame, edges: DataFrame, namespace: str = "loomgraph") -> DataFrame:
    """One JSON event a node that has inputs: the node as a job, its sources as inputs, itself as output."""
    inputs = edges.groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("inputs"))
    dataset = lambda n: F.struct(F.lit(namespace).alias("namespace"), n.alias("name"))
    job = F.struct(F.lit(namespace).alias("namespace"), F.col("id").alias("name"))
    return nodes.join(inputs, "id").select("id", F.to_json(F.struct(F.lit("COMPLETE").alias("eventType"), job.alias("job"), F.transform("inputs", dataset).alias("inputs"), F.array(dataset(F.col("id"))).alias("outputs"))).alias("event"))
