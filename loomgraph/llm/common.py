"""Helpers that several training-data operators share."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.session import written

#: A table is broadcast only if its counted rows are at most this many.
BROADCAST_ROWS = 1_000_000


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty.

    ``lower`` is much faster than ``translate`` and means the same for ASCII texts.
    """
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is made once, however often a lambda in it needs the value."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table with few, narrow rows may be broadcast: it is counted, not estimated."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table of narrow rows for broadcast if its count allows; else joins shuffle."""
    return F.broadcast(df) if small(df, rows) else df


def without(docs: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """Rows of docs for which no row of ``gone`` has the same keys (null is a key like any other).

    Keys are columns of ``gone`` by name, with what they mean in docs, whose own
    columns may have any names.
    """
    gone = maybe_broadcast(gone.select(*keys))
    match = F.lit(True)
    for name, own in keys.items():
        match = match & own.eqNullSafe(gone[name])
    return docs.join(gone, match, "left_anti")


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of trees, with their place ``at`` from 0 in the order of the tree and with n, the rows of the tree.

    Rows are sorted in ranges, so a large tree is spread over many tasks; the counts of
    its ranges, a small table, are summed up. Rows that are equal in all of ``order``
    may take each other's places.
    """
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange("tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie").drop("_tie")
    table = written(ranged.withColumn("_row", F.monotonically_increasing_id()), "sorted")
    table = table.withColumn("_range", F.shiftright("_row", 33))
    of_tree = Window.partitionBy("tree")
    runs = table.groupBy("tree", "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    runs = runs.select("tree", "_range", (F.sum("_rows").over(of_tree.orderBy("_range")) - F.col("_rows") - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_tree).alias("n"))
    runs = written(runs, "ranges")
    return table.join(maybe_broadcast(runs), ["tree", "_range"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_shift", "_range")


def remainder(doc_id: Column) -> Column:
    """crc32 of the identifier's text, mod 3; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def row_slices(batches: Iterable[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows, so that a worker never has more texts than these as Python strings."""
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
