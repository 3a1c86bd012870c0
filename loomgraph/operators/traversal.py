"""Walks over the graph: call chains, impact, paths, cycles, lineage.

Each walk is a loop over levels. A level is a join of the frontier with the edges and
is written to the shared folder, so that a lost executor costs one level at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import closing
from loomgraph.schema import GraphTables, is_sentinel
from loomgraph.session import release, sweep, written

STEPS = "source_id string, target_id string, depth int"


def walk(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False) -> DataFrame:
    """(source_id, target_id, depth) of the edges met at each depth from the seeds (id), forwards or backwards.

    An edge is listed once for each depth at which it is met, as cycles make it.
    """
    near, far = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    pairs = written(edges.select("source_id", "target_id").distinct(), "pairs")  # made once, read at each level
    frontier, levels = seeds.select(F.col("id").alias(near)).distinct(), []
    for depth in range(1, max_depth + 1):
        level = written(pairs.join(frontier, near).select("source_id", "target_id", F.lit(depth).alias("depth")), "level")
        if not level.head(1):
            break
        levels.append(level)
        frontier = level.select(F.col(far).alias(near)).distinct()
    release(pairs)
    return reduce(DataFrame.unionByName, levels) if levels else edges.sparkSession.createDataFrame([], STEPS)


def distances(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False) -> DataFrame:
    """(id, depth) of what is met from the seeds (id), at its smallest depth; a seed only if it is met again.

    What was met before is left out of the next level, so each edge is followed once.
    """
    near, far = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    pairs = written(edges.select(F.col(near).alias("near"), F.col(far).alias("id")).distinct(), "pairs")
    frontier, found = seeds.select(F.col("id").alias("near")).distinct(), None
    for depth in range(1, max_depth + 1):
        step = pairs.join(frontier, "near").select("id").distinct()
        step = step if found is None else step.join(found, "id", "left_anti")
        level = written(step.withColumn("depth", F.lit(depth)), "level")
        if not level.head(1):
            break
        found = level if found is None else found.unionByName(level)
        frontier = level.select(F.col("id").alias("near"))
    release(pairs)
    return found if found is not None else edges.sparkSession.createDataFrame([], "id string, depth int")


def call_chain(g: GraphTables, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    return walk(g.relationships.where("kind = 'calls'"), seeds, max_depth)


def impact(g: GraphTables, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    return walk(g.relationships, seeds, max_depth, reverse=True)


def impact_by_depth(g: GraphTables, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """Symbols that depend on the seeds, counted by their smallest depth."""
    first = distances(g.relationships, seeds, max_depth, reverse=True)
    first = first.join(seeds, "id", "left_anti").join(g.symbols.select("id", "file_path"), "id")
    return first.groupBy("depth").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("n_files")).orderBy("depth")


def changed_symbols(g: GraphTables, changed: DataFrame) -> DataFrame:
    """Symbols whose lines (from 1) hold a changed line: ``changed`` has file and line."""
    c = changed.select(F.col("file").alias("file_path"), "line")
    hit = c.join(g.symbols, "file_path").where(F.col("line").between(F.col("start_line") + 1, F.col("end_line") + 1))
    return hit.select("id").distinct()


def change_impact(g: GraphTables, changed: DataFrame, max_depth: int = 3) -> DataFrame:
    """Symbols that depend on changed ones, which are left out, with their smallest depth."""
    seeds = written(changed_symbols(g, changed), "changed")
    first = distances(g.relationships, seeds, max_depth, reverse=True)
    return first.join(seeds, "id", "left_anti")


def shortest_paths(g: GraphTables, source: str, max_depth: int = 10, target: str | None = None) -> DataFrame:
    """(id, length, path) of all that a symbol reaches, over known ends; of equally short paths the smallest.

    With a target, the search ends at the level on which it is met.
    """
    spark = g.symbols.sparkSession
    edges = written(g.relationships.where(~is_sentinel(F.col("target_id"))).select("source_id", "target_id").distinct(), "pairs")
    start = spark.createDataFrame([(source, 0, [source])], "id string, length int, path array<string>")
    seen, frontier = start, start
    for length in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("id").alias("source_id"), "path"), "source_id")
        step = step.groupBy(F.col("target_id").alias("id")).agg(F.min(F.array_append("path", F.col("target_id"))).alias("path"))
        step = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(length).alias("length"), "path")
        frontier = written(step, "reached")
        if not frontier.head(1):
            break
        seen = seen.unionByName(frontier)
        if target is not None and frontier.where(F.col("id") == target).head(1):
            break
    return seen


def find_path(g: GraphTables, source: str, target: str, max_depth: int = 10) -> DataFrame:
    """One row, or none where the target is not reached: from a symbol to itself it is a path of length 0."""
    return shortest_paths(g, source, max_depth if source != target else 0, target).where(F.col("id") == target)


def cycles(g: GraphTables, kinds: tuple[str, ...] = ("calls", "imports"), longest: int = 3) -> DataFrame:
    """Elementary cycles of up to ``longest`` symbols, each once, from its smallest id.

    Paths of fewer than ``longest`` symbols are written. Where they close, directly or by one more
    symbol, is found on labels, and only those that do are joined with edges by identifier.
    So the work grows with the mean degree to the power of ``longest``, but what is written with one power less.
    """
    edges = g.relationships.where(F.col("kind").isin(*kinds) & ~is_sentinel(F.col("target_id")) & (F.col("source_id") != F.col("target_id")))
    edges = written(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct(), "pairs")
    sweep(edges.sparkSession)
    paths, found = edges.where("a < b").select(F.array("a", "b").alias("path"), F.col("b").alias("end"), F.col("a").alias("first")), []
    few = lambda df: F.broadcast(df) if df.limit(100_001).count() <= 100_000 else df
    named = lambda df, **columns: df.join(few(labels.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()), [closing.label(F.col(own)) == F.col(f"_{c}") for c, own in columns.items()], "left_semi")
    for n in range(2, max(longest, 3)):
        onward = n == longest - 1
        labels = closing.closed(paths.select(F.col("first").alias("a"), F.col("end").alias("b")), edges, onward)
        sweep(edges.sparkSession)
        closable = written(named(paths, first="first", end="end"), "closable")
        steps = written(named(edges, end="a", first="b").unionByName(named(edges, end="a", next="b")).unionByName(named(edges, next="a", first="b")).distinct(), "steps")
        back = steps.select(F.col("a").alias("end"), F.col("b").alias("first"))
        more = lambda known, by: known.join(by.select(F.col("a").alias("end"), F.col("b").alias("next")), "end").where((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next"))).select(F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("end"), "first")
        found.append(closable.join(back, ["end", "first"], "left_semi").select("path"))
        if onward:
            found.append(more(closable, steps).join(back, ["end", "first"], "left_semi").select("path"))
        elif n + 1 < longest:
            paths = written(more(paths, edges), "paths")
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.size("path").alias("length"), F.array_join("path", " ").alias("cycle"))


def lineage_impact(edges: DataFrame, nodes: DataFrame, query: str, max_depth: int = 1000) -> DataFrame:
    """Nodes downstream of those named by a query, with their smallest depth.

    Seeds are the nodes (id) equal to the query in any case, or else those that
    contain it. A seed is listed only if it is reached again.
    """
    exact = nodes.where(F.lower("id") == query.lower())
    seeds = exact if exact.head(1) else nodes.where(F.lower("id").contains(query.lower()))
    return distances(edges.select(F.col("source").alias("source_id"), F.col("target").alias("target_id")), seeds, max_depth)


def seeds_of(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")
