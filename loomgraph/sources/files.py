"""Files as tables: discovery, incremental indexing, upserts and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import glob_regex
from loomgraph.schema import GraphTables
from loomgraph.sources.extract import REGISTRY

#: Directories that are never read, and the largest file.
EXCLUDED = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", "target")
LARGEST_KB = 500


def _ignored(rel: Column, rules: tuple[str, ...]) -> Column:
    """Ignore rules: a positive match of the path, a segment or an end of it, unless a negated rule matches."""

    def hit(rule: str) -> Column:
        pattern = glob_regex(rule.strip("/"))
        parts = F.split(rel, "/")
        ends = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))
        return rel.rlike(pattern) | F.exists(parts, lambda p: p.rlike(pattern)) | F.exists(ends, lambda p: p.rlike(pattern))

    rules = tuple(r.strip() for r in rules if r.strip() and not r.strip().startswith("#"))
    yes, no = F.lit(False), F.lit(False)
    for r in rules:
        if r.startswith("!"):
            no = no | hit(r[1:])
        else:
            yes = yes | hit(r)
    return yes & ~no


def choose(files: DataFrame, root: str = "", rules: tuple[str, ...] = (), largest_kb: int = LARGEST_KB) -> DataFrame:
    """Files (path, length, ...) with a known extension, outside excluded directories, not ignored and not too large."""
    rel = F.regexp_replace("path", "^" + "".join(c if c.isalnum() else "\\" + c for c in root), "")
    rel = F.regexp_replace(rel, "^/+", "")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    out = files.where(extension.isin(*sorted(REGISTRY)) & (F.col("length") <= largest_kb * 1024))
    return out.where(~F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, EXCLUDED))) & ~_ignored(rel, rules))


def discover(spark: SparkSession, root: str, rules: tuple[str, ...] = (), largest_kb: int = LARGEST_KB) -> DataFrame:
    """(path, text) of the source files below a root; the content is read only of files that are chosen."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if ":" in root else "file:" + root
    return choose(found, base, rules, largest_kb).select("path", F.decode(F.col("content"), "UTF-8").alias("text"))


def changed(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose text differs from what is indexed (path, content_hash), and new ones."""
    old = indexed.select("path", F.col("content_hash").alias("_old"))
    return files.join(old, "path", "left").where(F.col("_old").isNull() | (F.sha2("text", 256) != F.col("_old"))).drop("_old")


def changed_paths(indexed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, change) of files (path, content_hash) against what is indexed: added, modified or removed."""
    both = indexed.select("path", F.col("content_hash").alias("_old"), F.lit(True).alias("_was")).join(files.select("path", F.col("content_hash").alias("_new"), F.lit(True).alias("_is")), "path", "full_outer")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def delete(g: GraphTables, paths: DataFrame) -> GraphTables:
    """The tables without some files (path) and all that was extracted from them."""
    gone = paths.select("path").distinct()
    inside = gone.withColumnRenamed("path", "file_path")
    return GraphTables(g.symbols.join(inside, "file_path", "left_anti").select(*g.symbols.columns), g.relationships.join(inside, "file_path", "left_anti").select(*g.relationships.columns), g.files.join(gone, "path", "left_anti").select(*g.files.columns))


def upsert(g: GraphTables, new: GraphTables) -> GraphTables:
    """The tables with the files of ``new`` in place of what they had."""
    kept = delete(g, new.files)
    return GraphTables(kept.symbols.unionByName(new.symbols), kept.relationships.unionByName(new.relationships), kept.files.unionByName(new.files))


def counters(parsed: DataFrame) -> DataFrame:
    """One row: files parsed, files with errors, symbols and relationships."""
    bad = F.size("errors") > 0
    return parsed.agg(F.count_if(~bad).alias("parsed"), F.count_if(bad).alias("errors"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).alias("symbols"), F.coalesce(F.sum(F.size("edges")), F.lit(0)).alias("relationships"))


def push_files(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed and removed paths of push payloads (commits: array of added, modified, removed); a removed path is not changed."""
    c = payloads.select(F.explode("commits").alias("c"))
    pick = lambda *names: c.select(F.explode(F.concat(*[F.coalesce(F.col(f"c.{n}"), F.array().cast("array<string>")) for n in names])).alias("path")).distinct()
    removed = pick("removed")
    return pick("added", "modified").join(removed, "path", "left_anti"), removed


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation tasks of a JSON file (a list, or an object with tasks), with defaults; tasks without a query or an expectation are refused."""
    schema = "id string, category string, repo string, task_type string, query string, expected array<string>, expected_symbols array<string>, expected_files array<string>, hard_negatives array<string>, expected_edit_files array<string>, expected_patch array<string>, seed_symbol string, k int, budget int, notes string"
    text = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")
    as_object = F.from_json("value", f"struct<tasks:array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>>")["tasks"]
    rows = text.select(F.posexplode(F.when(F.ltrim("value").startswith("["), as_list).otherwise(as_object)).alias("pos", "t")).select("pos", "t.*")
    none = F.array().cast("array<string>")
    rows = rows.select(
        F.coalesce("id", F.concat(F.lit("task-"), (F.col("pos") + 1).cast("string"))).alias("id"),
        *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("category", "retrieval"), ("repo", "local"), ("task_type", "retrieval"))],
        F.trim("query").alias("query"),
        F.coalesce("expected_symbols", "expected", none).alias("expected_symbols"),
        *[F.coalesce(c, none).alias(c) for c in ("expected_files", "hard_negatives")],
        F.coalesce("expected_edit_files", "expected_patch", none).alias("expected_edit_files"),
        "seed_symbol",
        F.coalesce("k", F.lit(5)).alias("k"),
        "budget",
        "notes",
    )
    bad = rows.where((F.coalesce("query", F.lit("")) == "") | ((F.size("expected_symbols") == 0) & (F.size("expected_files") == 0))).select("id").take(5)
    if bad:
        raise ValueError(f"tasks need a query and an expectation: {', '.join(r['id'] for r in bad)}")
    return rows
