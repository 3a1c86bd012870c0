"""MinHash near-dedup (operator 12): an LSH forest over sets of word shingles.

1. A set's signature is its smallest hash in each of ``BINS`` ranges of hashes (one
   permutation; an empty range takes the value of another). An order sorts the sets by
   some of these values, one after the other: sets that are alike share long prefixes.
2. In the first orders only neighbours meet, which share the longest prefixes. That joins
   most near copies at the price of a sort.
3. In the other orders sets of one region meet that nothing has joined yet. A region is a
   prefix of two values or more: where more than ``REGION`` sets share a prefix, the
   region is cut one value deeper, as often as needed, unless nearly all of it is joined
   already. Sets in deep regions miss each other more often, so they take part in more
   orders: as many as make the chance to miss a linked pair less than ``MISS``.
4. Sets meet as hashed bitmaps, whose bit counts bound the overlap from above, so no linked
   pair that meets is lost. What bitmaps let pass falls into families, and within
   these links are confirmed on the full sets, as sorted arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bloom, jaccard
from loomgraph.llm.common import maybe_broadcast, read, row_slices
from loomgraph.operators.components import connected_components
from loomgraph.session import release, written

BINS = 128
DEPTH = 8
LEAST_DEPTH = 2
#: Sets of one prefix beyond which it is cut deeper; at the full depth a region of more is laid out in tiles.
REGION = 1024
#: Chance that a pair at the threshold shares no region.
MISS = 1e-6
#: Orders in which neighbours meet, before all others.
FIRST = 2
#: Orders of a later wave, after those that all sets take part in.
WAVE = 31

_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)).astype(np.uint64)
#: Where an empty bin looks for a value, in this order.
_PROBES = np.stack([np.random.default_rng(b).permutation(BINS) for b in range(BINS)])
_MIX = np.uint64(0xD6E8FEB86659FD93)


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest hashes of a sorted set in ``BINS`` ranges, 32 bits each; none for the empty set."""
    if not len(s):
        return np.zeros(0, np.int32)
    first = np.searchsorted(s, _EDGES)
    full = first < np.append(first[1:], len(s))
    values = ((s[np.minimum(first, len(s) - 1)] * _MIX) >> np.uint64(32)).astype(np.uint32)
    if not full.all():
        empty = np.flatnonzero(~full)
        values[empty] = values[_PROBES[empty, full[_PROBES[empty]].argmax(axis=1)]]
    return values.view(np.int32)


def order_bins(order: int) -> list[int]:
    """The bins whose values an order sorts by: the first orders have their own, later ones draw from all."""
    if (order + 1) * DEPTH <= BINS:
        return list(range(order * DEPTH, (order + 1) * DEPTH))
    return np.random.default_rng(order).permutation(BINS)[:DEPTH].tolist()


def orders_needed(depth: int, percent: int) -> int:
    """Orders in which a linked pair shares a prefix of this depth at least once, but for a chance of ``MISS``."""
    alike = (percent / 100) ** depth
    return 1 if alike >= 1 else math.ceil(math.log(MISS) / math.log(1 - alike))


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """row, id, n, a 128-bit name of the set (k1, k2), its signature and its bitmap, for each document."""

    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = jaccard._Hashes()
        for batch in row_slices(batches, jaccard.DOCS_AT_ONCE):
            sets = [jaccard.shingles(text, k, known) for text in batch.column("text").to_pylist()]
            names = np.array([jaccard._name(s) for s in sets], np.int64).reshape(-1, 2)
            mins = [signature(s) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in mins])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *mins])))
            bits = pa.array([jaccard.bitmap(s).tobytes() for s in sets], pa.binary())
            yield pa.record_batch({"id": batch.column("id"), "n": pa.array([len(s) for s in sets], pa.int64()), "k1": pa.array(names[:, 0]), "k2": pa.array(names[:, 1]), "mins": lists, "bits": bits})

    return docs.mapInArrow(profile, "id long, n long, k1 long, k2 long, mins array<int>, bits binary").withColumn("row", F.monotonically_increasing_id())


def _ordered(sets: DataFrame, orders: range) -> DataFrame:
    """(node, key, rest) of sets (node, mins): for each order the region of the least depth, and the values that follow."""
    one = lambda t, bins: F.struct(
        F.xxhash64(F.lit(t), *[F.get("mins", F.lit(b)) for b in bins[:LEAST_DEPTH]]).alias("key"), F.array(*[F.get("mins", F.lit(b)) for b in bins[LEAST_DEPTH:]]).alias("rest")
    )
    return sets.select("node", F.explode(F.array(*[one(t, order_bins(t)) for t in orders])).alias("o")).select("node", "o.key", "o.rest")


def _shared(rows: DataFrame, exact: bool = True) -> DataFrame:
    """Rows whose key others have too; or, if not exact, some more rows."""
    heads = written(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "heads")
    table, blocks = bloom.build(heads, "key")  # keeps most sets that are alone out of a join's shuffle
    some = bloom.possible(rows, F.col("key"), table, blocks)
    return some.join(heads, "key", "left_semi") if exact else some


def _regions(rows: DataFrame, labels: DataFrame | None, region: int) -> tuple[DataFrame, DataFrame]:
    """Rows (node, key, rest) of regions in which sets of different labels meet, with label, depth and whether the region is large.

    A region of more than ``region`` sets, most of which have one label, is laid out in
    parts of the sets with this label, each with all the others. The second table says
    how deep regions of a node were cut.
    """
    met = _shared(rows)
    label: Column = F.col("node")
    if labels is not None:
        met = met.join(maybe_broadcast(labels), "node", "left")
        label = F.coalesce("component", "node")
    now = written(met.select("node", "key", "rest", label.alias("label"), F.lit(LEAST_DEPTH).alias("depth")), "met")
    done: list[DataFrame] = []
    while True:
        own = now.columns
        sizes = now.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("c"), F.max("m").alias("m"), F.max_by("label", "m").alias("top")).where("m < c")
        half = region // 2
        parts = F.when(F.col("c") <= region, 1).when(F.col("c") - F.col("m") <= half, F.ceil(F.col("m") / half)).cast("int")
        marked = written(now.join(sizes.select("key", "top", parts.alias("parts")), "key").select(*own, "top", "parts"), "regions")
        release(now)
        which = F.when(F.col("label") == F.col("top"), F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        laid = marked.where("parts > 1").withColumn("part", F.explode(which)).withColumn("key", F.xxhash64("key", "part"))
        whole = marked.where("parts = 1").unionByName(laid.drop("part"))
        deeper = marked.where(F.col("parts").isNull() & (F.col("depth") < DEPTH))
        done += [whole.select(*own, F.lit(False).alias("large")), marked.where(F.col("parts").isNull() & (F.col("depth") == DEPTH)).select(*own, F.lit(True).alias("large"))]
        if not deeper.head(1):
            break
        now = written(deeper.select("node", F.xxhash64("key", F.get("rest", F.col("depth") - LEAST_DEPTH)).alias("key"), "rest", "label", (F.col("depth") + 1).alias("depth")), "deeper")
    every = reduce(DataFrame.unionByName, done)
    return every, every.where(F.col("depth") > LEAST_DEPTH).groupBy("node").agg(F.max("depth").alias("depth"))


def _neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of neighbours in the orders of rows (node, n, bits, key, rest) that share a key, if bitmaps let them pass."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        apart = np.arange(2)
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = (batch.column(c).to_pylist() for c in ("key", "node", "n", "bits"))
            for key, node, n, bits in zip(*columns, strict=True):
                bitmap = np.frombuffer(bits, np.uint64)
                if before is not None and before[0] == key and jaccard.tile_links(np.array([before[2], n]), apart, [before[3], bitmap], None, percent, jaccard._always):
                    out.append((before[1], node))
                before = (key, node, n, bitmap)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return rows.repartitionByRange("key", "rest", "node").sortWithinPartitions("key", "rest", "node").drop("rest").mapInArrow(compare, "a long, b long")


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (node, n, bits, label, key, rest) that join different labels of a region, if bitmaps let them pass."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in jaccard._groups(batches, "key"):
            out: list[tuple[int, int]] = []
            for nodes, n, bits, labels, _, _, _ in groups:
                maps = [np.frombuffer(x, np.uint64) for x in bits]
                names = labels.copy()
                for i in range(len(n) - 1):  # neighbours share the longest prefixes
                    if names[i] != names[i + 1] and jaccard.tile_links(n[i : i + 2], names[i : i + 2], maps[i : i + 2], None, percent, jaccard._always):
                        out.append((nodes[i], nodes[i + 1]))
                        names[names == names[i + 1]] = names[i]
                if (names != names[0]).any():
                    out += [(nodes[i], nodes[j]) for i, j in jaccard.tile_links(n, names, maps, None, percent, jaccard._always)]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "rest", "node")
    return dealt.drop("rest").mapInArrow(compare, "a long, b long")


def families(profiles: DataFrame, copies: DataFrame, percent: int, region: int = REGION) -> DataFrame:
    """(node, family) of the sets that bitmaps let pass with another one of a region; ``copies`` (row) of equal sets are left out."""
    sets = profiles.where("n > 0").select(F.col("row").alias("node"), "mins").join(maybe_broadcast(copies.withColumnRenamed("row", "node")), "node", "left_anti")
    maps = profiles.select(F.col("row").alias("node"), "n", "bits")
    edges: list[DataFrame] = []  # found so far: stars of all before, and what is new
    cuts: list[DataFrame] = []
    labels: DataFrame | None = None

    def relabel() -> DataFrame:
        fresh = written(connected_components(reduce(DataFrame.unionByName, edges), "a", "b").select("node", "component"), "labels")
        if labels is not None:
            release(labels)
        edges[:] = [fresh.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))]
        return fresh

    some = _shared(_ordered(sets, range(FIRST)), exact=False)
    edges.append(written(_neighbours(some.join(maps, "node").select("node", "n", "bits", "key", "rest"), percent), "found"))
    labels = relabel()
    at, width = FIRST, orders_needed(LEAST_DEPTH, percent)
    while True:
        orders = range(at, at + width)
        some = sets
        if cuts:  # only sets from deep regions need more orders
            needed = F.lit(0)
            for depth in range(LEAST_DEPTH + 1, DEPTH + 1):
                needed = F.when(F.col("depth") == depth, orders_needed(depth, percent)).otherwise(needed)
            left = written(reduce(DataFrame.unionByName, cuts).groupBy("node").agg(F.max("depth").alias("depth")).where(needed > at - FIRST).select("node"), "left")
            if not left.head(1):
                break
            some = sets.join(maybe_broadcast(left), "node", "left_semi")
        rows, deep = _regions(_ordered(some, orders), labels, region)
        cuts.append(written(deep, "cuts"))
        with_bits = lambda r: r.join(maps, "node")
        found = written(_met(with_bits(rows.where(~F.col("large"))).select("node", "n", "bits", "label", "key", "rest"), percent), "found")
        fresh = [found] if found.head(1) else []
        large = rows.where("large")
        if large.head(1):  # regions that all values share: tiles meet where their sizes and labels let them
            laid = large.select("node", F.col("key").alias("family"), "label", F.lit(0).cast("long").alias("pool"))
            tiles = written(jaccard._tiled(with_bits(laid), F.length("bits"), region), "tiles")
            inside = written(_met(tiles.select("node", "n", "bits", "label", "key", F.lit(0).alias("rest")), percent), "found")
            edges += [*fresh, inside]
            labels = relabel()
            again = tiles.drop("label").join(maybe_broadcast(labels), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
            again = written(again, "tiles")
            across = jaccard._across(again.select("node", "n", "bits", "label", "key"), written(jaccard._meetings(again, percent), "meetings"))
            fresh = [written(jaccard._compared(across.select("node", "n", "bits", "label", "side", "key"), percent).select("a", "b"), "found")]
            release(tiles)
        if fresh:
            edges += fresh
            labels = relabel()
        at, width = orders.stop, WAVE
    return labels.select("node", F.col("component").alias("family"))


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", region: int = REGION) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Sets a and b of k-word shingles link when 100 |a & b| >= percent |a | b|; percent
    is from 60 to 100, since lower ones need too many orders. Links that are told are
    right; a pair may be missed with a chance of ``MISS`` at most, less the more alike
    it is. ``component_id`` is the smallest identifier reachable by links, itself included. Null and
    empty texts, and those without words, have no shingles and link with nothing; a
    text with fewer than k words is one shingle. Repeated rows are linked like other
    equal documents; null identifiers name a component only if it has no other. No
    documents: no rows. Other columns are not read.
    """
    if not 60 <= percent <= 100:
        raise ValueError("percent is from 60 to 100")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    profiles = written(_profiles(docs, k), "profiles")
    some = profiles.where("n > 0").select("row", "id", "k1", "k2")
    classes = written(some.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("id").alias("low"), F.min_by("id", "row").alias("rep")), "classes")
    rows = written(profiles.select("row", "id", "n", "k1", "k2").join(classes.select("k1", "k2", "node"), ["k1", "k2"], "left").select("row", "id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), "rows")
    found = families(profiles, rows.where("row <> node").select("row"), percent, region)
    members = profiles.select(F.col("row").alias("node"), "n", "bits").join(maybe_broadcast(found), "node").join(classes.drop("low"), "node")
    members = written(members, "members")
    release(profiles)
    named = classes.select("node", "low")
    if members.head(1):
        links = jaccard._links(jaccard._sets(docs, members, k), percent, jaccard.TILE)
        named = named.join(connected_components(links.select("a", "b"), "a", "b"), "node", "left").withColumn("part", F.coalesce("component", "node"))
    else:
        named = named.withColumn("part", F.col("node"))
    names = named.groupBy("part").agg(F.min("low").alias("component_id"))
    out = rows.join(named.join(names, "part").select("node", "component_id"), "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at 80 % of four-word shingles."""
    found = near_copies(read(spark, sf_dir, "documents"), 4, 80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
