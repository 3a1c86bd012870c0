"""Registered queries of exports and security findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import context
from loomgraph.plans.catalogue import graph, query
from loomgraph.sources import sinks
from loomgraph.sources.warehouse import table


@query("export_csv_nodes", " SELECT id, name, qualified_name, kind, file_path, start_line + 1 AS line, language FROM symbols")
def export_csv_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_frames(graph(spark, sf_dir))[0]


@query("export_csv_edges", " SELECT source_id, target_id, kind, confidence, file_path FROM relationships")
def export_csv_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_frames(graph(spark, sf_dir))[1]


@query(
    "export_dot",
    """ SELECT 0 AS section, 'digraph code {' || chr(10) || '  rankdir=LR;' AS line UNION ALL SELECT 1, '  "' || id || '" [label="' || name || '", kind="' || kind || '"];' FROM symbols
UNION ALL SELECT DISTINCT 2, '  "' || source_id || '" -> "' || target_id || '" [label="' || kind || '"];' FROM relationships UNION ALL SELECT 3, '}'""",
)
def export_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dot(graph(spark, sf_dir))


_X = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(
    "export_graphml",
    """ SELECT 0 AS section, array_to_string(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
  '  <key id="name" for="node" attr.name="name" attr.type="string"/>', '  <key id="kind" for="node" attr.name="kind" attr.type="string"/>', '  <key id="file" for="node" attr.name="file" attr.type="string"/>', '  <key id="relation" for="edge" attr.name="relation" attr.type="string"/>',
  '  <graph edgedefault="directed">'], chr(10)) AS line
UNION ALL SELECT 1, '    <node id="' || {id} || '"><data key="name">' || {name} || '</data><data key="kind">' || {kind} || '</data><data key="file">' || {file_path} || '</data></node>' FROM symbols
UNION ALL SELECT 2, '    <edge source="' || {source_id} || '" target="' || {target_id} || '"><data key="relation">' || {kind} || '</data></edge>' FROM relationships
UNION ALL SELECT 3, '  </graph>' || chr(10) || '</graphml>'""".format(**{c: _X.format(c) for c in ("id", "name", "kind", "file_path", "source_id", "target_id")}),
)
def export_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.graphml(graph(spark, sf_dir))


@query(
    "export_json",
    f""" SELECT 1 AS section, '{{"type":"node","id":' || to_json(id)::VARCHAR || ',"name":' || to_json(name)::VARCHAR || ',"kind":' || to_json(kind)::VARCHAR || ',"file":' || to_json(file_path)::VARCHAR || ',"color":"{sinks.COLOURS[0]}"}}' AS line FROM symbols
UNION ALL SELECT 2, '{{"type":"link","source":' || to_json(source_id)::VARCHAR || ',"target":' || to_json(target_id)::VARCHAR || ',"kind":' || to_json(kind)::VARCHAR || ',"confidence":' || to_json(confidence)::VARCHAR || '}}' FROM relationships""",
)
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_lines(graph(spark, sf_dir))


@query(
    "export_cypher",
    """ SELECT 1 AS section, 'CREATE (:' || upper(kind[1]) || kind[2:] || ' {id: ''' || id || ''', name: ''' || name || ''', file: ''' || file_path || '''});' AS line FROM symbols
UNION ALL SELECT 2, 'MATCH (a {id: ''' || source_id || '''}), (b {id: ''' || target_id || '''}) CREATE (a)-[:' || upper(kind) || ']->(b);' FROM relationships""",
)
def export_cypher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.cypher(graph(spark, sf_dir))


@query("export_mermaid", " SELECT 0 AS section, 'classDiagram' AS line UNION ALL SELECT 1, '  class ' || replace(name, ' ', '_') FROM symbols WHERE kind IN ('class', 'interface', 'enum')")
def export_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.mermaid(graph(spark, sf_dir))


def _found_sql(rule: str, severity: str, message: str, pattern: str) -> str:
    """Findings of one rule: up to 32 characters to both sides of the first match, and its line."""
    return f"""SELECT doc_id AS location, '{rule}' AS rule_id, '{severity}' AS severity, '{message}' AS message,
  substring(replace(regexp_extract(text, '(?s)(.{{0,32}})((?-s){pattern})(.{{0,32}})', 0), chr(10), ' '), 1, 160) AS snippet,
  1 + length(regexp_replace(regexp_extract(text, '(?s)^(.*?)((?-s){pattern})', 1), '[^\n]', '', 'g')) AS line FROM documents WHERE regexp_matches(text, '{pattern}')"""


_LEVEL = "CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"
_SARIF = f"""WITH f AS ({" UNION ALL ".join(_found_sql(*r) for r in context.RULES)}),
m AS (SELECT *, {_LEVEL} AS level, substring(sha256(rule_id || chr(0) || location || chr(0) || snippet), 1, 32) AS mark FROM f)
SELECT location, rule_id, level, mark AS fingerprint, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS "order",
  to_json({{'ruleId': rule_id, 'level': level, 'message': {{'text': message}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': location::VARCHAR}}, 'region': {{'startLine': line}}}}}}],
    'partialFingerprints': {{'primary': mark}}}})::VARCHAR AS result FROM m"""


@query("sarif_findings", _SARIF, graph=False)
def sarif_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sarif(context.findings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("location"), "text")))


_SECRETS = [(p.removeprefix("(?i)"), "i" if p.startswith("(?i)") else "") for p in context.SECRET_PATTERNS]
_LEFT, _COUNT = "coalesce(text, '')", "0"
for _p, _f in _SECRETS:
    _COUNT += f" + len(regexp_extract_all({_LEFT}, '{_p}', 0, '{_f}'))"
    _LEFT = f"regexp_replace({_LEFT}, '{_p}', '{context.REDACTION}', 'g{_f}')"
_DENIED = r"regexp_matches(path, '(^|/)(node_modules|vendor|dist|build|\.venv|__pycache__|\.next)(/|$)|(^|/)(\.env(\..*)?|id_rsa|id_ed25519)$|\.(pem|key|p12|pfx|tfvars)$|(^|/)secrets/')"


@query("safety_report", f"WITH f AS (SELECT 'docs/' || source || '/' || doc_id AS path, ({_COUNT})::BIGINT AS n FROM documents) SELECT count(*) AS files, count(*) FILTER ({_DENIED}) AS denied, count(*) FILTER (n > 0) AS with_secrets, coalesce(sum(n), 0)::BIGINT AS redactions FROM f", graph=False)
def safety_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return context.safety_report(files)
