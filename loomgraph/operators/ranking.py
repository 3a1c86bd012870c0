"""PageRank and communities: iterations whose state is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.relational import top_samples
from loomgraph.schema import GraphTables, page
from loomgraph.session import release, written


def pagerank(g: GraphTables, damping: float = 0.85, max_iter: int = 50, tol: float = 1e-6) -> DataFrame:
    """(id, rank) of all symbols; ranks sum to 1. Without usable edges there are no rows.

    Parallel edges count each, self-loops do not, and what dangling symbols hold is
    spread evenly. Iterations end when the sum of changes is below ``tol``.
    """
    ids = g.symbols.select("id").distinct()
    known = g.relationships.select("source_id", "target_id").where("source_id <> target_id")
    known = known.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    counted = written(known.groupBy("source_id", "target_id").agg(F.count("*").alias("n")), "counted")
    if not counted.head(1):
        return g.symbols.sparkSession.createDataFrame([], "id string, rank double")
    out = counted.groupBy("source_id").agg(F.sum("n").alias("out"))
    edges = written(counted.join(out, "source_id").select("source_id", F.col("target_id").alias("id"), (F.col("n") / F.col("out")).alias("share")), "edges")
    n = ids.count()
    base = ids.join(out.select(F.col("source_id").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling"))
    ranks = written(base.withColumns({"rank": F.lit(1.0 / n), "change": F.lit(1.0)}), "ranks")
    totals = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"), F.sum("change").alias("change")
    for i in range(max_iter):
        lost, change = ranks.agg(*totals).first()
        if i and tol > 0 and change < tol:
            break
        given = edges.join(ranks.select(F.col("id").alias("source_id"), "rank"), "source_id").groupBy("id").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))
        after = ranks.drop("change").join(given, "id", "left").select("id", "dangling", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change"))
        after = written(after, "ranks")
        release(ranks)
        ranks = after
    release(counted, edges)
    return ranks.select("id", "rank")


def ranking(g: GraphTables, limit: int = 20, kinds: tuple[str, ...] = (), ranks: DataFrame | None = None) -> DataFrame:
    found = (pagerank(g) if ranks is None else ranks).join(g.symbols.select("id", "name", "kind", "file_path"), "id")
    found = found.where(F.col("kind").isin(*kinds)) if kinds else found
    return found.withColumn("rank", F.round("rank", 6)).orderBy(F.desc("rank"), "id").limit(page(limit))


def communities(g: GraphTables, rounds: int = 30) -> DataFrame:
    """(id, community) by synchronous label propagation over the simple undirected graph of known ends.

    A symbol takes the label that most neighbours have (ties: the smallest), unless
    its own is as frequent. Symbols without edges are absent.
    """
    ids = g.symbols.select("id")
    known = g.relationships.select("source_id", "target_id").where("source_id <> target_id")
    known = known.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    edges = known.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionByName(known.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"))).distinct()
    edges = written(edges, "edges")
    labels = written(edges.select("id").distinct().select("id", F.col("id").alias("community")), "labels")
    for _ in range(rounds):
        votes = edges.join(labels.select(F.col("id").alias("other"), "community"), "other").groupBy("id", "community").agg(F.count("*").alias("n"))
        own = labels.select("id", F.col("community").alias("own"))
        rated = votes.join(own, "id").groupBy("id", "own").agg(F.max("n").alias("most"), F.min(F.struct(-F.col("n"), "community")).alias("best"), F.max(F.when(F.col("community") == F.col("own"), F.col("n"))).alias("mine"))
        after = rated.select("id", F.when(F.col("mine") == F.col("most"), F.col("own")).otherwise(F.col("best.community")).alias("community"), "own")
        after = written(after, "labels")
        moved = bool(after.where("community <> own").head(1))
        release(labels)
        labels = after.drop("own")
        labels.shared_path = after.shared_path
        if not moved:
            break
    return labels


def community_sizes(labels: DataFrame, min_size: int = 2, samples: int = 5) -> DataFrame:
    """Communities of at least ``min_size`` symbols, with the first few of each."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    few = top_samples(labels, "community", ["id"], samples).groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("samples"))
    return sizes.join(few, "community").orderBy(F.desc("n"), "community")
