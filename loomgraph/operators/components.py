"""Connected components of an undirected graph by contraction within tasks and alternating stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import release, written

#: Edges that a task contracts, about; and nodes that it remembers at once.
EDGES_AT_ONCE, NODES_AT_ONCE = 1_000_000, 1_000_000


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars around the smallest node that a task knows of each component."""
    up: dict = {}
    kind = None

    def root(x):  # noqa: ANN001, ANN202
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = y
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, r) for x in list(up) if (r := root(x)) != x]
        return pa.record_batch([pa.array([f[i] for f in found], kind) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        kind = batch.column("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
        if len(up) > NODES_AT_ONCE:
            yield stars()
            up.clear()
    if up:
        yield stars()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none, or only larger ones."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("lower"), F.lit(0).alias("higher")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("lower"), F.lit(1).alias("higher")))
    return not ends.groupBy("n").agg(F.sum("lower").alias("l"), F.max("higher").alias("h")).where("l > 1 or (l = 1 and h = 1)").head(1)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge; a component is named by its smallest node.

    Tasks first contract the edges that they hold, in bounded memory. Then each round links
    the larger neighbours of a node, then its smaller ones, to the smallest that it
    knows, until all edges are stars; the rounds needed grow with the logarithm of what is left.
    Nothing is gathered per node, so hubs of any size are only skewed join keys.
    Edges with a null end and self-loops are ignored.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(f"{src} is not null and {dst} is not null").where("u <> v")
    rows = written(e, "edges")
    tasks = max(1, rows.count() // EDGES_AT_ONCE)
    kinds = ", ".join(f"{name} {kind}" for name, kind in e.dtypes)
    current = written(rows.coalesce(tasks).mapInArrow(_contract, kinds).distinct(), "edges")
    release(rows)
    while not _are_stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "edges")
        release(current)
        current = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
