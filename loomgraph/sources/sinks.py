"""Exports of the graph: tables of lines that are sorted and written as text, CSV frames, JSON and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.operators.context import severity_order
from loomgraph.schema import GraphTables, is_sentinel

CLASS_LIKE = ("class", "interface", "enum")
#: Colours of communities.
COLOURS = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac")


def parts(g: GraphTables, file_filter: str | None = None, kinds: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the edges between them; ``file_filter`` is the beginning of a path."""
    nodes = g.symbols
    if file_filter:
        nodes = nodes.where(F.col("file_path").ilike(f"{file_filter}%"))
    if kinds:
        nodes = nodes.where(F.col("kind").isin(*kinds))
    ids = nodes.select("id")
    edges = g.relationships.where(~is_sentinel(F.col("target_id")))
    edges = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes, edges


def truncated(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n nodes by id, and the edges between them."""
    few = nodes.orderBy("id").limit(n)
    ids = few.select("id")
    return few, edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def colour(community: Column) -> Column:
    return F.get(F.array(*map(F.lit, COLOURS)), F.pmod(F.xxhash64(community), F.lit(len(COLOURS))).cast("int"))


def _lines(rows: list[tuple[int, DataFrame, Column]], spark) -> DataFrame:  # noqa: ANN001
    """(section, line) of sections in order; within one, lines are in alphabetical order."""
    out = None
    for section, df, line in rows:
        part = df.select(F.lit(section).alias("section"), line.alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def _fixed(spark, *texts: str) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([("\n".join(texts),)], "line string")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files that, one after another, are the export: rows are dealt out by range of (section, line)."""
    lines.orderBy("section", "line").select("line").write.mode("overwrite").text(path)


def _escaped(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def dot(g: GraphTables, **only) -> DataFrame:  # noqa: ANN003
    nodes, edges = parts(g, **only)
    q = lambda c: F.concat(F.lit('"'), _escaped(F.col(c), ("\\", "\\\\"), ('"', '\\"')), F.lit('"'))
    spark = g.symbols.sparkSession
    return _lines(
        [
            (0, _fixed(spark, "digraph code {", "  rankdir=LR;"), F.col("line")),
            (1, nodes, F.concat(F.lit("  "), q("id"), F.lit(" [label="), q("name"), F.lit(", kind="), q("kind"), F.lit("];"))),
            (2, edges.select("source_id", "target_id", "kind").distinct(), F.concat(F.lit("  "), q("source_id"), F.lit(" -> "), q("target_id"), F.lit(" [label="), q("kind"), F.lit("];"))),
            (3, _fixed(spark, "}"), F.col("line")),
        ],
        spark,
    )


def graphml(g: GraphTables, **only) -> DataFrame:  # noqa: ANN003
    nodes, edges = parts(g, **only)
    x = lambda c: _escaped(F.coalesce(F.col(c), F.lit("")), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    spark = g.symbols.sparkSession
    keys = [f'  <key id="{k}" for="{e}" attr.name="{k}" attr.type="string"/>' for k, e in (("name", "node"), ("kind", "node"), ("file", "node"), ("relation", "edge"))]
    return _lines(
        [
            (0, _fixed(spark, '<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '  <graph edgedefault="directed">'), F.col("line")),
            (1, nodes, F.concat(F.lit('    <node id="'), x("id"), F.lit('"><data key="name">'), x("name"), F.lit('</data><data key="kind">'), x("kind"), F.lit('</data><data key="file">'), x("file_path"), F.lit("</data></node>"))),
            (2, edges, F.concat(F.lit('    <edge source="'), x("source_id"), F.lit('" target="'), x("target_id"), F.lit('"><data key="relation">'), x("kind"), F.lit("</data></edge>"))),
            (3, _fixed(spark, "  </graph>", "</graphml>"), F.col("line")),
        ],
        spark,
    )


def cypher(g: GraphTables, **only) -> DataFrame:  # noqa: ANN003
    nodes, edges = parts(g, **only)
    q = lambda c: F.concat(F.lit("'"), _escaped(F.coalesce(F.col(c), F.lit("")), ("\\", "\\\\"), ("'", "\\'")), F.lit("'"))
    label = F.replace(F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    spark = g.symbols.sparkSession
    return _lines(
        [
            (1, nodes, F.concat(F.lit("CREATE (:"), label, F.lit(" {id: "), q("id"), F.lit(", name: "), q("name"), F.lit(", file: "), q("file_path"), F.lit("});"))),
            (2, edges, F.concat(F.lit("MATCH (a {id: "), q("source_id"), F.lit("}), (b {id: "), q("target_id"), F.lit("}) CREATE (a)-[:"), F.upper("kind"), F.lit("]->(b);"))),
        ],
        spark,
    )


def mermaid(g: GraphTables, methods: int = 6, **only) -> DataFrame:  # noqa: ANN003
    """A class diagram: classes with their first methods, and inheritance."""
    nodes, edges = parts(g, **only)
    classes = nodes.where(F.col("kind").isin(*CLASS_LIKE))
    safe = lambda c: F.regexp_replace(c, r"[^\w]", "_")
    own = nodes.where("kind = 'method'").withColumn("owner", F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    own = own.withColumn("rn", F.row_number().over(Window.partitionBy("file_path", "owner").orderBy("start_line", "id"))).where(F.col("rn") <= methods)
    text = F.coalesce("signature", "name")
    own = own.join(classes.select("file_path", F.col("qualified_name").alias("owner"), F.col("name").alias("class")), ["file_path", "owner"])
    cut = F.when(F.length(text) > 60, F.concat(F.substring(text, 1, 57), F.lit("…"))).otherwise(text)
    names = classes.select("id", "name")
    kin = edges.where(F.col("kind").isin("inherits", "implements")).join(names.select(F.col("id").alias("source_id"), F.col("name").alias("s")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("name").alias("t")), "target_id").select("s", "t", "kind").distinct()
    spark = g.symbols.sparkSession
    return _lines(
        [
            (0, _fixed(spark, "classDiagram"), F.col("line")),
            (1, classes, F.concat(F.lit("  class "), safe("name"))),
            (2, own, F.concat(F.lit("  "), safe("class"), F.lit(" : "), cut)),
            (3, kin, F.concat(F.lit("  "), safe("t"), F.when(F.col("kind") == "inherits", " <|-- ").otherwise(" <|.. "), safe("s"))),
        ],
        spark,
    )


def json_lines(g: GraphTables, communities: DataFrame | None = None, **only) -> DataFrame:  # noqa: ANN003
    """One JSON object a node or link, with the community's colour."""
    nodes, edges = parts(g, **only)
    if communities is not None:
        nodes = nodes.join(communities, "id", "left").withColumn("color", colour(F.col("community")))
    else:
        nodes = nodes.withColumns({"community": F.lit(None).cast("string"), "color": F.lit(COLOURS[0])})
    node = F.to_json(F.struct(F.lit("node").alias("type"), "id", "name", "kind", F.col("file_path").alias("file"), "community", "color"))
    link = F.to_json(F.struct(F.lit("link").alias("type"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind", "confidence"))
    return _lines([(1, nodes, node), (2, edges, link)], g.symbols.sparkSession)


def csv_frames(g: GraphTables, **only) -> tuple[DataFrame, DataFrame]:  # noqa: ANN003
    nodes, edges = parts(g, **only)
    return nodes.select("id", "name", "qualified_name", "kind", "file_path", (F.col("start_line") + 1).alias("line"), "language"), edges.select("source_id", "target_id", "kind", "confidence", "file_path")


def sarif(findings: DataFrame, tool: str = "loomgraph") -> DataFrame:
    """One SARIF result a finding (location, rule_id, severity, message, snippet, line), with a stable fingerprint."""
    level = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    place = F.col("location").cast("string")
    mark = F.substring(F.sha2(F.concat_ws("\0", "rule_id", place, F.coalesce("snippet", F.lit(""))), 256), 1, 32)
    at = F.struct(F.struct(F.struct(place.alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(at).alias("locations"), F.struct(mark.alias("primary")).alias("partialFingerprints"))
    return findings.select("location", "rule_id", level.alias("level"), mark.alias("fingerprint"), severity_order(F.col("severity")).alias("order"), F.to_json(result).alias("result"))
