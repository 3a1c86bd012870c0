"""Where paths close: pairs of ends and edges as blocks of short labels in the shared folder, which tasks read and compare.

A label is a hash of an identifier, so what is found holds all closed paths and perhaps some
others; who calls checks the few that are found. Nothing is made of the paths that do not close.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import new_path, written

#: Edges of a block, about, and paths that a task continues at once: they bound its memory.
EDGES_A_BLOCK, PATHS_AT_ONCE = 2_000_000, 1 << 21


def label(name: Column) -> Column:
    return F.hash(name)


def dealt(pairs: DataFrame, colours: int) -> str:
    """Pairs (a, b) as one folder of the shared one for each two colours of their labels."""
    path = new_path(pairs.sparkSession, "blocks")
    rows = pairs.select(label(F.col("a")).alias("a"), label(F.col("b")).alias("b"))
    rows = rows.withColumn("key", F.pmod("a", F.lit(colours)) * colours + F.pmod("b", F.lit(colours)))
    rows.repartition(colours * colours, "key").write.partitionBy("key").parquet(path)
    return path


def _block(uri: str, key: int) -> tuple[np.ndarray, np.ndarray]:
    from pyarrow import fs, parquet

    store, where = fs.FileSystem.from_uri(uri)
    files = [i.path for i in store.get_file_info(fs.FileSelector(f"{where}/key={key}", allow_not_found=True)) if i.path.endswith(".parquet")]
    tables = []
    for path in files:
        with store.open_input_file(path) as file:
            tables.append(parquet.ParquetFile(file).read(columns=["a", "b"]))
    return tuple(np.concatenate([np.zeros(0, np.int32), *(t.column(c).to_numpy() for t in tables)]) for c in ("a", "b"))


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.view(np.uint32).astype(np.uint64) << np.uint64(32) | b.view(np.uint32)


class _Edges:
    """Membership of edges in a block: a table of bits keeps most others from the search."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.keys = np.unique(_packed(a, b))
        self.shift = np.uint64(64 - max(10, (16 * len(self.keys)).bit_length()))
        self.bits = np.zeros(1 << int(64 - self.shift), bool)
        self.bits[self._place(self.keys)] = True

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def which(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = _packed(a, b)
        at = np.flatnonzero(self.bits[self._place(keys)])
        if not len(self.keys):
            return at
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        return at[self.keys[place] == keys[at]]


def _onward(first: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Paths (first, end) continued by edges (a, b): first, end, next, so many at once."""
    order = np.argsort(a)
    a, b = a[order], b[order]
    low, high = np.searchsorted(a, end, "left"), np.searchsorted(a, end, "right")
    some = np.flatnonzero(high > low)
    first, end, low, total = first[some], end[some], low[some], np.cumsum((high - low)[some])
    for at in range(0, int(total[-1]) if len(total) else 0, PATHS_AT_ONCE):
        nth = np.arange(at, min(at + PATHS_AT_ONCE, int(total[-1])))
        path = np.searchsorted(total, nth, "right")
        edge = low[path] + nth - np.where(path > 0, total[path - 1], 0)
        yield first[path], end[path], b[edge]


def closed(ends: DataFrame, edges: DataFrame, further: bool) -> DataFrame:
    """Labels (first, end, next) of paths (a, b) that an edge from b to a closes (next is null) or, if ``further``, two edges by way of another symbol.

    There are colours enough that a block of edges between two colours fits a task, which reads
    one block of paths and the edges of both ways at a time.
    """
    spark = edges.sparkSession
    colours = max(1, int(np.ceil(np.sqrt(edges.count() / EDGES_A_BLOCK))))
    paths, steps = dealt(ends, colours), dealt(edges, colours)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column("id").to_pylist():
                x, y, z = unit // colours**2, unit // colours % colours, unit % colours
                first, end = _block(paths, x * colours + y)
                if not len(first):
                    continue
                if z == 0:
                    hit = _Edges(*_block(steps, y * colours + x)).which(end, first)
                    yield pa.record_batch([pa.array(first[hit]), pa.array(end[hit]), pa.nulls(len(hit), pa.int32())], names=["first", "end", "next"])
                if further:
                    back = _Edges(*_block(steps, z * colours + x))
                    for f, e, n in _onward(first, end, *_block(steps, y * colours + z)):
                        hit = back.which(n, f)
                        yield pa.record_batch([pa.array(c[hit]) for c in (f, e, n)], names=["first", "end", "next"])

    units = spark.range(0, colours**3, 1, min(colours**3, 1000))
    return written(units.mapInArrow(find, "first int, end int, next int").distinct(), "closed")
