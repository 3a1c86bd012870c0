"""Registered queries of many change sets at once: each brand's change of its own files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import reach
from loomgraph.plans.catalogue import graph, query
from loomgraph.sources.warehouse import table


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand changes lines 1 to 9 of one file and all of another."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("set")).distinct()
    file = lambda kind: F.concat(F.lit("/src/"), F.col("set"), F.lit(f"/{kind}.py"))
    lines = brands.select("set", file("STANDARD").alias("file"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("line"))
    return lines.unionByName(brands.select("set", file("PROMO").alias("file"), F.lit(None).cast("int").alias("line")))


_SETS = """, sets AS (SELECT DISTINCT p_brand AS set FROM part),
files_ AS (SELECT set, '/src/' || set || '/STANDARD.py' AS file_path FROM sets UNION ALL SELECT set, '/src/' || set || '/PROMO.py' FROM sets)"""
_REACHED = (
    _SETS
    + """, e AS (SELECT DISTINCT source_id AS s, target_id AS t FROM relationships),
l0 AS (SELECT DISTINCT set, id FROM files_ JOIN symbols USING (file_path) WHERE contains(file_path, '/PROMO.py') OR start_line + 1 <= 9),
l1 AS (SELECT DISTINCT set, s AS id FROM l0 JOIN e ON t = id EXCEPT SELECT * FROM l0),
l2 AS (SELECT DISTINCT set, s AS id FROM l1 JOIN e ON t = id EXCEPT SELECT * FROM l0 EXCEPT SELECT * FROM l1),
every AS (SELECT 0 AS depth, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2)"""
)


@query(
    "affected_by_sets",
    _REACHED + " SELECT every.set, depth, count(*) AS n, count(DISTINCT file_path) FILTER ((every.set, file_path) NOT IN (SELECT set, file_path FROM files_)) AS n_files FROM every JOIN symbols USING (id) GROUP BY 1, 2",
)
def affected_by_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.affected_counts(graph(spark, sf_dir), _changes(spark, sf_dir), 2)


@query(
    "blast_radius",
    _SETS
    + """, changed AS (SELECT set, id FROM files_ JOIN symbols USING (file_path)),
near AS (SELECT DISTINCT set, s.id, qualified_name, s.file_path FROM changed c JOIN relationships r ON r.target_id = c.id JOIN symbols s ON s.id = r.source_id WHERE (set, s.file_path) NOT IN (SELECT set, file_path FROM files_)),
first_ AS (SELECT set, list(qualified_name || ' - ' || file_path ORDER BY place) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY set ORDER BY qualified_name, file_path, id) AS place FROM near) WHERE place <= 10 GROUP BY 1)
SELECT set, (SELECT count(*) FROM files_ f WHERE f.set = sets.set) AS n_files, (SELECT count(*) FROM changed c WHERE c.set = sets.set) AS n_symbols,
  (SELECT count(*) FROM near n WHERE n.set = sets.set) AS n_affected, (SELECT count(DISTINCT file_path) FROM near n WHERE n.set = sets.set) AS n_affected_files, coalesce(listed, []) AS listed,
  (SELECT count(*) FROM near n WHERE n.set = sets.set) - len(coalesce(listed, [])) AS more FROM sets LEFT JOIN first_ USING (set)""",
)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.blast_radius(graph(spark, sf_dir), _changes(spark, sf_dir))
