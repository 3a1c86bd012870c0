"""Registered query of resolution kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import resolve
from loomgraph.plans.catalogue import GRAPH_SQL, query
from loomgraph.plans.retrieval import _RESOLVE, _named
from loomgraph.schema import GraphTables
from loomgraph.sources import files

_AFTER = "NOT (substring(p_brand, 7)::INT % 5 = 1 AND p_type IN ('STANDARD', 'ECONOMY'))"


@query("resolve_delta", GRAPH_SQL.replace("FROM part\n)", f"FROM part WHERE {_AFTER}\n)", 1) + _RESOLVE + " SELECT * FROM res", graph=False)
def resolve_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References after some files were removed, some added and some had their symbols renamed: kept, not resolved anew."""
    g = _named(spark, sf_dir)
    brand = F.regexp_extract("file_path", r"Brand#(\d+)/", 1).cast("int") % 5
    kind = F.regexp_extract("file_path", r"/([A-Z]+)\.py$", 1)
    was = g.symbols.where(~((brand == 0) & (kind == "STANDARD"))).withColumn("name", F.when((brand == 2) & (kind == "LARGE"), F.concat(F.lit("old "), "name")).otherwise(F.col("name")))
    now = g.symbols.where(~((brand == 1) & kind.isin("STANDARD", "ECONOMY")))
    hashed = lambda s: s.groupBy(F.col("file_path").alias("path")).agg(F.sum(F.xxhash64(*s.drop("decorators").columns).cast("decimal(30,0)")).alias("content_hash"))
    paths = files.changed_paths(hashed(was), hashed(now))
    found = resolve.resolve(GraphTables(was, g.relationships, g.files))
    return resolve.resolve_again(found, was, GraphTables(now, g.relationships, g.files), paths)
