"""Lookups, listings and summaries of the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.schema import CONFIDENCES, GraphTables, check_kind, page

PLACE = ("file_path", "start_line", "id")


# lookups and listings


def symbol_by_id(g: GraphTables, symbol_id: str) -> DataFrame:
    return g.symbols.where(F.col("id") == symbol_id)


def symbols_in_file(g: GraphTables, path: str) -> DataFrame:
    return g.symbols.where(F.col("file_path") == path).orderBy("start_line", "id")


def symbols_by_name(g: GraphTables, name: str, kind: str | None = None) -> DataFrame:
    found = g.symbols.where(F.col("name") == name)
    return found.where(F.col("kind") == kind) if kind else found


def symbols_by_kind(g: GraphTables, kind: str, file_filter: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of symbols of a kind; ``file_filter`` is a part of the path, in any case."""
    found = g.symbols.where(F.col("kind") == check_kind(kind))
    if file_filter:
        found = found.where(F.col("file_path").ilike(f"%{file_filter}%"))
    return found.orderBy(*PLACE).offset(offset).limit(page(limit))


def page_of(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> tuple[DataFrame, bool]:
    """A page of ordered rows and whether more follow: one row more is looked for."""
    probe = df.orderBy(*order).offset(offset).limit(limit + 1)
    return probe.limit(limit), probe.count() > limit


def symbols_by_decorator(g: GraphTables, name: str, file_filter: str | None = None, limit: int = 100) -> DataFrame:
    found = g.symbols.where(F.exists("decorators", lambda d: d.ilike(f"%{name}%")))
    if file_filter:
        found = found.where(F.col("file_path").ilike(f"%{file_filter}%"))
    return found.orderBy(*PLACE).limit(page(limit))


def dependencies(g: GraphTables, symbol_id: str) -> DataFrame:
    return g.relationships.where(F.col("source_id") == symbol_id)


def dependents(g: GraphTables, symbol_id: str) -> DataFrame:
    return g.relationships.where(F.col("target_id") == symbol_id)


def is_public(name: Column) -> Column:
    return ~name.startswith("_") & ~F.col("kind").isin("import", "variable")


def api_surface(g: GraphTables, file_filter: str | None = None, limit: int = 200) -> DataFrame:
    """Public symbols outside tests; ``file_filter`` is the beginning of the path."""
    found = g.symbols.where(~F.col("is_test") & is_public(F.col("name")))
    if file_filter:
        found = found.where(F.col("file_path").ilike(f"{file_filter}%"))
    return found.orderBy(*PLACE).limit(page(limit))


def list_files(g: GraphTables, language: str | None = None) -> DataFrame:
    return (g.files.where(F.col("language") == language) if language else g.files).orderBy("path")


# summaries


def graph_stats(g: GraphTables) -> DataFrame:
    s = g.symbols.agg(F.count("*").alias("symbols"), F.count_distinct("file_path").alias("files"))
    return s.join(F.broadcast(g.relationships.agg(F.count("*").alias("relationships"))))


def breakdown(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def confidence_stats(g: GraphTables) -> DataFrame:
    """All confidences, with 0 for those that no edge has."""
    names = g.relationships.sparkSession.createDataFrame([(c,) for c in CONFIDENCES], "confidence string")
    counts = g.relationships.groupBy("confidence").agg(F.count("*").alias("n"))
    return names.join(counts, "confidence", "left").select("confidence", F.coalesce("n", F.lit(0)).alias("n"))


def degrees(g: GraphTables) -> DataFrame:
    """id, out_degree, in_degree, total of every symbol; parallel edges count each."""
    ends = g.relationships.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    joined = g.symbols.join(sums, "id", "left")
    out, into = F.coalesce("out_degree", F.lit(0)), F.coalesce("in_degree", F.lit(0))
    return joined.select("id", "name", "qualified_name", "kind", "file_path", out.alias("out_degree"), into.alias("in_degree"), (out + into).alias("total"))


def centrality(g: GraphTables, limit: int = 50) -> DataFrame:
    return degrees(g).where("total > 0").orderBy(F.desc("total"), "id").limit(page(limit))


def hub_symbols(g: GraphTables, limit: int = 20) -> DataFrame:
    found = degrees(g).where(~F.col("kind").isin("import", "variable") & (F.col("total") > 0))
    return found.orderBy(F.desc("total"), "name", "id").limit(page(limit))


def _with_files(g: GraphTables) -> DataFrame:
    """Edges with the files of both ends, where both are known."""
    s = g.symbols.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_file"))
    t = g.symbols.select(F.col("id").alias("target_id"), F.col("file_path").alias("target_file"))
    return g.relationships.drop("file_path").join(s, "source_id").join(t, "target_id")


def file_coupling(g: GraphTables, limit: int = 20) -> DataFrame:
    pairs = _with_files(g).where("source_file <> target_file").groupBy("source_file", "target_file")
    counted = pairs.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return counted.orderBy(F.desc("n"), "source_file", "target_file").limit(page(limit))


def file_dependencies(g: GraphTables, path: str) -> DataFrame:
    """Files that a file's symbols reach in one step."""
    return _with_files(g).where((F.col("source_file") == path) & (F.col("target_file") != path)).select(F.col("target_file").alias("file")).distinct().orderBy("file")


def affected_files(g: GraphTables, path: str) -> DataFrame:
    """Files whose symbols reach a file in one step."""
    return _with_files(g).where((F.col("target_file") == path) & (F.col("source_file") != path)).select(F.col("source_file").alias("file")).distinct().orderBy("file")


def module_overview(g: GraphTables, directory: str) -> DataFrame:
    """Files below a directory with their symbols, in order of line."""
    below = g.symbols.where(F.col("file_path").startswith(directory.rstrip("/") + "/"))
    line = F.struct("start_line", "id", "name", "kind")
    return below.groupBy("file_path").agg(F.count("*").alias("n_symbols"), F.array_sort(F.collect_list(line)).alias("symbols")).orderBy("file_path")


def hotspots(g: GraphTables, commits: DataFrame, limit: int = 20, files: int = 200) -> DataFrame:
    """Files by commits x (1 + edges into their symbols).

    ``commits`` (sha, file): the ``files`` most changed count. A changed path is a
    known file if equal, or if the known file ends with "/" and it; the file's last
    part is the join key, and the rest is verified.
    """
    churn = commits.groupBy("file").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "file").limit(files)
    into = g.relationships.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_degree"))
    known = g.symbols.join(into, "id", "left").groupBy("file_path").agg(F.count_distinct("id").alias("symbols"), F.coalesce(F.sum("in_degree"), F.lit(0)).alias("in_degree"))
    base = lambda c: F.substring_index(c, "/", -1)
    fits = (F.col("file") == F.col("file_path")) | F.col("file_path").endswith(F.concat(F.lit("/"), "file"))
    both = churn.join(known, (base(F.col("file")) == base(F.col("file_path"))) & fits)
    return both.select("file", "file_path", "commits", "symbols", "in_degree", (F.col("commits") * (1 + F.col("in_degree"))).alias("score")).orderBy(F.desc("score"), "file", "file_path").limit(page(limit))


def usages(g: GraphTables, name: str, limit: int = 50) -> DataFrame:
    """Edges into the symbols of a name, as lists of lines for each file; at most ``limit`` edges."""
    ids = symbols_by_name(g, name).select(F.col("id").alias("target_id"))
    found = g.relationships.join(ids, "target_id", "left_semi").orderBy("file_path", "start_line", "source_id", "kind").limit(page(limit))
    return found.groupBy("file_path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("start_line")).alias("lines")).orderBy("file_path")


def unused_symbols(g: GraphTables, include_tests: bool = False) -> DataFrame:
    """Symbols without an edge into them, other than modules, imports and usual entry points."""
    used = g.relationships.select(F.col("target_id").alias("id"))
    found = g.symbols.where(~F.col("kind").isin("module", "import") & ~F.col("name").isin("__init__", "main", "cli", "__main__"))
    found = found if include_tests else found.where("not is_test")
    return found.join(used, "id", "left_anti").orderBy(*PLACE)


def _tested(g: GraphTables) -> DataFrame:
    """Edges whose source is a test: target and test."""
    tests = g.symbols.where("is_test").select(F.col("id").alias("source_id"), F.col("name").alias("test_name"), F.col("file_path").alias("test_file"))
    return g.relationships.select("source_id", "target_id").join(tests, "source_id")


def symbol_coverage(g: GraphTables, name: str) -> DataFrame:
    """Symbols of a name and the tests that refer to them directly."""
    found = symbols_by_name(g, name).select("id", "name", F.col("file_path").alias("file"))
    tests = _tested(g).select(F.col("target_id").alias("id"), F.col("source_id").alias("test_id")).distinct()
    return found.join(tests, "id", "left").groupBy("id", "name", "file").agg(F.count("test_id").alias("n_tests")).orderBy("id")


def coverage_gaps(g: GraphTables, file_filter: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """Public symbols outside tests that no test refers to directly."""
    found = g.symbols.where(~F.col("is_test") & is_public(F.col("name")))
    if file_filter:
        found = found.where(F.col("file_path").ilike(f"{file_filter}%"))
    return found.join(_tested(g).select(F.col("target_id").alias("id")), "id", "left_anti").orderBy(*PLACE).offset(offset).limit(page(limit))


def latest_per_key(events: DataFrame, key: str, n: int, at: str = "created_at", tie: str = "id") -> DataFrame:
    """The latest ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_samples(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key, numbered."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def source_slice(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Lines start to end (from 1, both included) of a file's text."""
    lines = F.split("text", "\n")
    return files.where(F.col("path") == path).select("path", F.slice(lines, max(1, start), max(0, end - max(1, start) + 1)).alias("lines"))


def symbol_source(g: GraphTables, files: DataFrame, name: str, around: int = 5, limit: int = 10) -> DataFrame:
    """The text of the symbols of a name, some lines around, and up to ``limit`` edges each way."""
    found = symbols_by_name(g, name).join(files.select(F.col("path").alias("file_path"), "text"), "file_path")
    first = F.greatest(F.lit(1), F.col("start_line") + 1 - around)
    lines = F.slice(F.split("text", "\n"), first, F.col("end_line") + 1 + around - first + 1)
    ids = found.select("id").distinct()

    def side(own: str, other: str, name: str) -> DataFrame:
        edges = g.relationships.select(F.col(own).alias("id"), "kind", other).join(ids, "id", "left_semi")
        return top_samples(edges, "id", ["kind", other], limit).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kind", other))).alias(name))

    out, into = side("source_id", "target_id", "outgoing"), side("target_id", "source_id", "incoming")
    return found.join(out, "id", "left").join(into, "id", "left").select("id", "file_path", first.alias("first_line"), lines.alias("lines"), "outgoing", "incoming")
