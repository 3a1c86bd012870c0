"""Registered queries of the graph catalogue, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import ranking, relational, traversal
from loomgraph.sources import warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The graph view of ``loomgraph.sources.warehouse`` in SQL.
GRAPH_SQL = r"""
WITH RECURSIVE symbols AS (
  SELECT 'part::' || p_partkey AS id, p_name AS name, p_brand || '.' || p_name || '.' || p_partkey AS qualified_name,
         CASE p_type WHEN 'STANDARD' THEN 'function' WHEN 'ECONOMY' THEN 'method' WHEN 'MEDIUM' THEN 'class' WHEN 'PROMO' THEN 'import' WHEN 'LARGE' THEN 'constant' WHEN 'SMALL' THEN 'variable' END AS kind,
         '/src/' || p_brand || '/' || p_type || '.py' AS file_path, p_size AS start_line, p_size + 3 AS end_line,
         CASE WHEN p_partkey % 4 <> 0 THEN p_name || ' of ' || p_brand END AS docstring,
         CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN p_name || '(' || p_size || ')' END AS signature,
         CASE WHEN p_partkey % 5 = 0 THEN ['cached', lower(p_type)] ELSE [] END AS decorators,
         CASE substring(p_brand, 7)::INT % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'rust' END AS language, p_size % 10 = 0 AS is_test
  FROM part
), relationships AS (
  SELECT 'part::' || a.l_partkey AS source_id, 'part::' || b.l_partkey AS target_id,
         CASE a.l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' WHEN 'R' THEN 'references' END AS kind,
         '/src/' || p_brand || '/' || p_type || '.py' AS file_path, a.l_linenumber::INT AS start_line,
         CASE WHEN a.l_linestatus = 'O' THEN 'extracted' ELSE 'inferred' END AS confidence
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part ON a.l_partkey = p_partkey
  WHERE a.l_partkey <> b.l_partkey
), degrees AS (
  SELECT s.id, any_value(name) AS name, any_value(qualified_name) AS qualified_name, any_value(kind) AS kind, any_value(file_path) AS file_path,
         coalesce(any_value(o.n), 0)::BIGINT AS out_degree, coalesce(any_value(i.n), 0)::BIGINT AS in_degree, (coalesce(any_value(o.n), 0) + coalesce(any_value(i.n), 0))::BIGINT AS total
  FROM symbols s LEFT JOIN (SELECT source_id AS id, count(*) AS n FROM relationships GROUP BY 1) o ON o.id = s.id
  LEFT JOIN (SELECT target_id AS id, count(*) AS n FROM relationships GROUP BY 1) i ON i.id = s.id GROUP BY s.id
), with_files AS (
  SELECT r.source_id, r.target_id, r.kind, s.file_path AS source_file, t.file_path AS target_file
  FROM relationships r JOIN symbols s ON s.id = r.source_id JOIN symbols t ON t.id = r.target_id
), tested AS (SELECT r.target_id AS id, r.source_id AS test_id FROM relationships r JOIN symbols s ON s.id = r.source_id AND s.is_test)
"""


def query(name: str, sql: str | None = None, graph: bool = True) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its SQL on the graph view."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (GRAPH_SQL + sql) if graph else sql
        return f

    return add


graph = warehouse.graph
FILE = "/src/Brand#12/STANDARD.py"


@query("graph_stats", "SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(DISTINCT file_path) FROM symbols) AS files, (SELECT count(*) FROM relationships) AS relationships")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.graph_stats(graph(spark, sf_dir))


@query("language_breakdown", "SELECT language, count(*) AS n FROM symbols GROUP BY 1")
def language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.breakdown(graph(spark, sf_dir).symbols, "language")


@query("kind_breakdown", "SELECT kind, count(*) AS n FROM symbols GROUP BY 1")
def kind_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.breakdown(graph(spark, sf_dir).symbols, "kind")


@query("confidence_stats", "SELECT c.confidence, count(r.confidence) AS n FROM (VALUES ('extracted'), ('inferred'), ('ambiguous')) c(confidence) LEFT JOIN relationships r ON r.confidence = c.confidence GROUP BY 1")
def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.confidence_stats(graph(spark, sf_dir))


@query("symbols_in_file", f"SELECT id, name, kind, start_line FROM symbols WHERE file_path = '{FILE}'")
def symbols_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.symbols_in_file(graph(spark, sf_dir), FILE).select("id", "name", "kind", "start_line")


@query("symbols_by_name", "SELECT id, name, kind, file_path FROM symbols WHERE name = 'small ring' AND kind = 'method'")
def symbols_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.symbols_by_name(graph(spark, sf_dir), "small ring", "method").select("id", "name", "kind", "file_path")


@query("symbols_by_kind_page", "SELECT id, name, file_path, start_line FROM symbols WHERE kind = 'class' AND file_path ILIKE '%brand#1%' ORDER BY file_path, start_line, id LIMIT 30 OFFSET 10")
def symbols_by_kind_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.symbols_by_kind(graph(spark, sf_dir), "class", "brand#1", 30, 10).select("id", "name", "file_path", "start_line")


@query("symbols_by_decorator", "SELECT id, name, file_path FROM symbols WHERE len(list_filter(decorators, lambda d: d ILIKE '%ECON%')) > 0 ORDER BY file_path, start_line, id LIMIT 50")
def symbols_by_decorator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.symbols_by_decorator(graph(spark, sf_dir), "ECON", limit=50).select("id", "name", "file_path")


@query("symbol_edges", "SELECT 'out' AS way, target_id AS other, kind FROM relationships WHERE source_id = 'part::7' UNION ALL SELECT 'in', source_id, kind FROM relationships WHERE target_id = 'part::7'")
def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    out = relational.dependencies(g, "part::7").select(F.lit("out").alias("way"), F.col("target_id").alias("other"), "kind")
    return out.unionByName(relational.dependents(g, "part::7").select(F.lit("in").alias("way"), F.col("source_id").alias("other"), "kind"))


@query("api_surface", "SELECT id, name, kind, file_path, start_line FROM symbols WHERE NOT is_test AND name NOT LIKE '\\_%' ESCAPE '\\' AND kind NOT IN ('import', 'variable') AND file_path ILIKE '/src/brand#2%' ORDER BY file_path, start_line, id LIMIT 200")
def api_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.api_surface(graph(spark, sf_dir), "/src/brand#2").select("id", "name", "kind", "file_path", "start_line")


@query("degree_centrality", "SELECT id, name, out_degree, in_degree, total FROM degrees WHERE total > 0 ORDER BY total DESC, id LIMIT 50")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.centrality(graph(spark, sf_dir)).select("id", "name", "out_degree", "in_degree", "total")


@query("hub_symbols", "SELECT id, name, kind, file_path, out_degree, in_degree, total FROM degrees WHERE total > 0 AND kind NOT IN ('import', 'variable') ORDER BY total DESC, name, id LIMIT 20")
def hub_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.hub_symbols(graph(spark, sf_dir)).select("id", "name", "kind", "file_path", "out_degree", "in_degree", "total")


@query("file_coupling", "SELECT source_file, target_file, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM with_files WHERE source_file <> target_file GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def file_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.file_coupling(graph(spark, sf_dir))


@query("file_dependencies", f"SELECT DISTINCT target_file AS file FROM with_files WHERE source_file = '{FILE}' AND target_file <> source_file")
def file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.file_dependencies(graph(spark, sf_dir), FILE)


@query("affected_files", f"SELECT DISTINCT source_file AS file FROM with_files WHERE target_file = '{FILE}' AND target_file <> source_file")
def affected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.affected_files(graph(spark, sf_dir), FILE)


@query("module_overview", "SELECT file_path, count(*) AS n_symbols, string_agg(id, ' ' ORDER BY start_line, id) AS symbols FROM symbols WHERE starts_with(file_path, '/src/Brand#12/') GROUP BY 1")
def module_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.module_overview(graph(spark, sf_dir), "/src/Brand#12")
    return found.withColumn("symbols", F.array_join(F.transform("symbols", lambda s: s["id"]), " "))


@query(
    "hotspots",
    """, commits AS (SELECT l_orderkey AS sha, p_type || '.py' AS file FROM lineitem JOIN part ON l_partkey = p_partkey),
churn AS (SELECT file, count(*) AS commits FROM commits GROUP BY 1 ORDER BY commits DESC, file LIMIT 200),
known AS (SELECT file_path, count(DISTINCT id) AS symbols, sum(in_degree) AS in_degree FROM degrees GROUP BY 1)
SELECT file, file_path, commits, symbols, in_degree::BIGINT AS in_degree, (commits * (1 + in_degree))::BIGINT AS score FROM churn JOIN known ON file_path = file OR ends_with(file_path, '/' || file)
ORDER BY score DESC, file, file_path LIMIT 20""",
)
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = warehouse.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_type", F.lit(".py")).alias("file"))
    lines = warehouse.table(spark, sf_dir, "lineitem")
    return relational.hotspots(graph(spark, sf_dir), lines.join(parts, "l_partkey").select(F.col("l_orderkey").alias("sha"), "file"))


@query("usages_by_file", ", u AS (SELECT r.* FROM relationships r JOIN symbols s ON s.id = target_id AND s.name = 'hot ring' ORDER BY r.file_path, r.start_line, source_id, r.kind LIMIT 50) SELECT file_path, count(*) AS n, string_agg(start_line::VARCHAR, ' ' ORDER BY start_line) AS lines FROM u GROUP BY 1")
def usages_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.usages(graph(spark, sf_dir), "hot ring").withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), " "))


@query("unused_symbols", "SELECT id, name, kind, file_path FROM symbols s WHERE kind NOT IN ('module', 'import') AND name NOT IN ('__init__', 'main', 'cli', '__main__') AND NOT is_test AND NOT EXISTS (SELECT 1 FROM relationships r WHERE r.target_id = s.id)")
def unused_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unused_symbols(graph(spark, sf_dir)).select("id", "name", "kind", "file_path")


@query("symbol_coverage", "SELECT s.id, s.name, s.file_path AS file, count(DISTINCT test_id) AS n_tests FROM symbols s LEFT JOIN tested t ON t.id = s.id WHERE s.name = 'red plate' GROUP BY 1, 2, 3")
def symbol_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.symbol_coverage(graph(spark, sf_dir), "red plate")


@query("coverage_gaps", "SELECT id, name, kind, file_path FROM symbols WHERE NOT is_test AND name NOT LIKE '\\_%' ESCAPE '\\' AND kind NOT IN ('import', 'variable') AND id NOT IN (SELECT id FROM tested) ORDER BY file_path, start_line, id LIMIT 200")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.coverage_gaps(graph(spark, sf_dir)).select("id", "name", "kind", "file_path")


_CALLS = """, w(source_id, target_id, depth) AS (
  SELECT source_id, target_id, 1 FROM relationships WHERE kind = 'calls' AND source_id = (SELECT source_id FROM relationships WHERE kind = 'calls' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  UNION SELECT r.source_id, r.target_id, depth + 1 FROM w JOIN relationships r ON r.source_id = w.target_id AND r.kind = 'calls' WHERE depth < 5
) SELECT DISTINCT source_id, target_id, depth FROM w"""


@query("call_chain", _CALLS)
def call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    calls = g.relationships.where("kind = 'calls'").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    return traversal.call_chain(g, calls.orderBy(F.desc("n"), "id").limit(1).select("id"), 5)


_SEED = "(SELECT id FROM degrees ORDER BY in_degree DESC, id LIMIT 1)"
_IMPACT = f""", w(source_id, target_id, depth) AS (
  SELECT source_id, target_id, 1 FROM relationships WHERE target_id = {_SEED}
  UNION SELECT r.source_id, r.target_id, depth + 1 FROM w JOIN relationships r ON r.target_id = w.source_id WHERE depth < 4
)"""


def _busiest(g) -> DataFrame:  # noqa: ANN001
    return relational.degrees(g).orderBy(F.desc("in_degree"), "id").limit(1).select("id")


@query("impact_analysis", _IMPACT + " SELECT DISTINCT source_id, target_id, depth FROM w")
def impact_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return traversal.impact(g, _busiest(g), 4)


@query("impact_by_depth", _IMPACT + f", f AS (SELECT source_id AS id, min(depth) AS depth FROM w GROUP BY 1) SELECT depth, count(*) AS n, count(DISTINCT file_path) AS n_files FROM f JOIN symbols USING (id) WHERE id <> {_SEED} GROUP BY 1")
def impact_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return traversal.impact_by_depth(g, _busiest(g), 4)


@query(
    "change_impact",
    """, changed AS (SELECT DISTINCT id FROM symbols WHERE file_path = '/src/Brand#12/STANDARD.py' AND EXISTS (SELECT 1 FROM range(5, 21) t(line) WHERE line BETWEEN start_line + 1 AND end_line + 1)),
w(id, depth) AS (SELECT source_id, 1 FROM relationships WHERE target_id IN (SELECT id FROM changed) UNION SELECT r.source_id, depth + 1 FROM w JOIN relationships r ON r.target_id = w.id WHERE depth < 3)
SELECT id, min(depth) AS depth FROM w WHERE id NOT IN (SELECT id FROM changed) GROUP BY 1""",
)
def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    changed = g.symbols.where(F.col("file_path") == FILE).select(F.col("file_path").alias("file")).distinct().select("file", F.explode(F.sequence(F.lit(5), F.lit(20))).alias("line"))
    return traversal.change_impact(g, changed, 3)


@query(
    "shortest_path_length",
    """, w(id, length) AS (SELECT (SELECT min(source_id) FROM relationships), 0 UNION SELECT target_id, length + 1 FROM w JOIN relationships ON source_id = w.id WHERE length < 8)
SELECT id, min(length) AS length FROM w GROUP BY 1""",
)
def shortest_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    first = g.relationships.agg(F.min("source_id")).first()[0]
    return traversal.shortest_paths(g, first, 8).select("id", "length")


@query(
    "cycles_2_3",
    """, e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM relationships WHERE kind IN ('calls', 'imports', 'references'))
SELECT 2 AS length, x.a || ' ' || x.b AS cycle FROM e x JOIN e y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b
UNION ALL SELECT 3, x.a || ' ' || x.b || ' ' || y.b FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b""",
)
def cycles_2_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.cycles(graph(spark, sf_dir), ("calls", "imports", "references"))


_PAGERANK = """, c AS (SELECT source_id, target_id, count(*) AS n FROM relationships GROUP BY 1, 2), o AS (SELECT source_id, sum(n) AS total FROM c GROUP BY 1),
nn AS (SELECT count(*)::DOUBLE AS n FROM symbols),
p(i, id, rank) AS (
  SELECT 0, id, 1.0::DOUBLE / n FROM symbols, nn
  UNION ALL
  SELECT * FROM (
    WITH q AS (SELECT * FROM p),
    lost AS (SELECT coalesce(sum(rank), 0) AS x FROM q WHERE id NOT IN (SELECT source_id FROM o)),
    g AS (SELECT target_id AS id, sum(rank * c.n / o.total) AS got FROM q JOIN c ON c.source_id = q.id JOIN o ON o.source_id = q.id GROUP BY 1)
    SELECT q.i + 1, q.id, 0.15 / nn.n + 0.85 * (coalesce(g.got, 0) + lost.x / nn.n) FROM q LEFT JOIN g ON g.id = q.id, lost, nn WHERE q.i < 10
  )
)"""


@query("pagerank", _PAGERANK + " SELECT id, round(rank, 6) AS rank FROM p WHERE i = 10")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pagerank(graph(spark, sf_dir), max_iter=10, tol=0).select("id", F.round("rank", 6).alias("rank"))


@query("pagerank_by_kind", _PAGERANK + " SELECT id, kind, round(rank, 6) AS rank FROM p JOIN symbols USING (id) WHERE i = 10 AND kind IN ('class', 'function') ORDER BY 3 DESC, id LIMIT 20")
def pagerank_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return ranking.ranking(g, 20, ("class", "function"), ranking.pagerank(g, max_iter=10, tol=0)).select("id", "kind", "rank")


def _lpa(rounds: int) -> str:
    steps = "".join(
        f""", v{k} AS (SELECT e.id, l.community, count(*) AS n, any_value(o.community) AS own FROM ue e JOIN l{k} l ON l.id = e.other JOIN l{k} o ON o.id = e.id GROUP BY 1, 2),
b{k} AS (SELECT id, any_value(own) AS own, max(n) AS most, max(n) FILTER (community = own) AS mine, min(community) FILTER (n = (SELECT max(n) FROM v{k} w WHERE w.id = v{k}.id)) AS best FROM v{k} GROUP BY id),
l{k + 1} AS (SELECT id, CASE WHEN mine = most THEN own ELSE best END AS community FROM b{k})"""
        for k in range(rounds)
    )
    return ", ue AS (SELECT DISTINCT source_id AS id, target_id AS other FROM relationships UNION SELECT target_id, source_id FROM relationships), l0 AS (SELECT DISTINCT id, id AS community FROM ue)" + steps + f" SELECT id, community FROM l{rounds}"


@query("communities_lpa", _lpa(4))
def communities_lpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.communities(graph(spark, sf_dir), 4).select("id", "community")


@query("community_sizes", _lpa(4)[: -len(" SELECT id, community FROM l4")] + ", r AS (SELECT id, community, row_number() OVER (PARTITION BY community ORDER BY id) AS k FROM l4) SELECT community, count(*) AS n, string_agg(id, ' ' ORDER BY id) FILTER (k <= 5) AS samples FROM r GROUP BY 1 HAVING count(*) >= 2")
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.community_sizes(ranking.communities(graph(spark, sf_dir), 4))


@query(
    "lineage_impact",
    """, w(id, depth) AS (SELECT target_id, 1 FROM relationships WHERE source_id = 'part::77' UNION SELECT target_id, depth + 1 FROM w JOIN relationships ON source_id = w.id WHERE depth < 20)
SELECT id, min(depth) AS depth FROM w GROUP BY 1""",
)
def lineage_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    edges = g.relationships.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    return traversal.lineage_impact(edges, g.symbols.select("id"), "PART::77", 20)
