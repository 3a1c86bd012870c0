"""Registered queries of encoded texts and of the stored vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import vectors
from loomgraph.plans.catalogue import query
from loomgraph.plans.retrieval import _TOKENS, _VECTORS
from loomgraph.session import new_path
from loomgraph.sources.warehouse import table

DIMS = 64


@query(
    "build_vectors",
    f"""WITH tok AS (SELECT doc_id AS id, unnest({_TOKENS.format('text')}) AS term FROM documents), counted AS (SELECT id, term, count(*) AS n, md5(term) AS h FROM tok GROUP BY ALL),
parts AS (SELECT id, (('0x' || h[1:4])::INT % {DIMS}) AS dim, sum(CASE WHEN ('0x' || h[5])::INT % 2 = 1 THEN -n ELSE n END)::DOUBLE AS v FROM counted GROUP BY 1, 2)
SELECT id, dim, round((v / sqrt(sum(v * v) OVER (PARTITION BY id)))::FLOAT::DOUBLE, 5) AS weight FROM parts WHERE v <> 0""",
    graph=False,
)
def build_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents as vectors, in long form."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = vectors.encode(texts, vectors.hashing_encoder(DIMS)).select("id", F.posexplode("embedding").alias("dim", "v"))
    return found.where("v <> 0").select("id", "dim", F.round(F.col("v").cast("double"), 5).alias("weight"))


def _index(spark: SparkSession, sf_dir: str) -> tuple[vectors.VectorIndex, DataFrame]:
    """The stored index over all embeddings, and the queries: every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    where = new_path(spark, "vectors")
    vectors.VectorIndex.build(rows, where, cells=32)
    return vectors.VectorIndex(spark, where), rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


@query("vector_cells_exact", "WITH " + _VECTORS + " SELECT query_id, id, score, rank FROM vk", graph=False)
def vector_cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest dot products, by cells with bounds."""
    index, queries = _index(spark, sf_dir)
    return index.search(queries, 20, probe=2, exact=True).withColumn("score", F.round("score", 6))


@query("vector_cells", graph=False)
def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest dot products within the cells next to each query, as many as the index has measured to be enough."""
    index, queries = _index(spark, sf_dir)
    return index.search(queries, 20)
