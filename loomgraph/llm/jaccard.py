"""N-gram Jaccard join (operator 7): documents linked when their sets of word shingles overlap enough.

1. Each set of shingle hashes is cut into hash ranges (parts), more than linked
   sets of its size can differ in. Two linked sets agree in a part exactly, so a
   join of part signatures finds all candidates; common passages alone rarely fill a part.
2. Candidates fall into families. Sets that share passages with many others chain into large
   ones; families of more than two are parted again by the rarest shingles, of which linked sets share one.
   A family is laid out in tiles of similar size, bounded in rows and bytes, and tiles meet where their sizes allow a link.
3. Only hashed bitmaps meet at first; they have two to four bits for an element, whatever the
   size of the set. Their bit counts bound the overlap from above, and what passes falls into
   closer families. Sets are made for these, and intersected exactly as sorted arrays. Pairs already joined by other links are skipped: components do not need them.
4. Families in more than one tile are first linked within tiles, then by one member of
   each group found so far. After that only tiles meet whose bitmaps let a pair of
   different groups pass, so a large family of near copies costs little more than its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.llm import bloom
from loomgraph.llm.common import maybe_broadcast, read, row_slices, small, without
from loomgraph.operators.components import connected_components
from loomgraph.session import release, sweep, written

BAND = 1.5
#: Parts beyond those that linked sets can differ in, at least and for each of these: a set may leave out so many.
SPARE_PARTS = 2
SPARE_SHARE = 0.1
#: A tile has about so many rows and bytes at most (a larger set is a tile by itself).
TILE = 512
TILE_BYTES = 8 << 20
#: Documents that a task works on at once, which bounds its memory.
DOCS_AT_ONCE = 64
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, k: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text.

    A-Z is lower-cased and words are parted by ASCII white space, as bytes do both.
    A text with fewer words is one shingle; without words there is none.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, n)
    if n < k:
        s = np.array([n], np.uint64)
        for x in h:
            s = (s ^ x) * _MULTIPLY[4]
        return s
    s = h[: n - k + 1] * _MULTIPLY[0]
    for i in range(1, k):
        s = (s << np.uint64(7)) | (s >> np.uint64(57))
        s = s + h[i : n - k + 1 + i] * _MULTIPLY[i % 5]
    s ^= s >> np.uint64(29)
    return np.unique(s * _MULTIPLY[3])


def _band(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(BAND) + 1e-9))


def _top(band: int) -> int:
    """The largest size in a band."""
    n = int(BAND ** (band + 1)) + 2
    while _band(n) > band:
        n -= 1
    return n


def differing(n: int, percent: int) -> int:
    """Most elements in which two linked sets of at most n differ: of sizes a + b and overlap o, 100 o >= percent (a + b - o)."""
    return 2 * n * (100 - percent) // (100 + percent)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of the parts of a set, in its own band and in all larger ones that it can be linked into."""
    n = len(s)
    out = []
    if n:
        for band in range(_band(n), _band(100 * n // percent) + 1):
            most = differing(_top(band), percent)
            if most < 1:
                continue  # only equal sets are linked
            spare = SPARE_PARTS + int(SPARE_SHARE * most)
            parts = most + 1 + spare
            edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
            at = np.concatenate([[0], np.searchsorted(s, edges), [n]])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((s ^ (s >> np.uint64(31))) * _MULTIPLY[1])])
            sig = sums[at[1:]] - sums[at[:-1]]
            count = np.diff(at)
            sig = (sig ^ (np.uint64(band) << np.uint64(48)) ^ (np.arange(parts, dtype=np.uint64) << np.uint64(20)) ^ count.astype(np.uint64)) * _MULTIPLY[2]
            sig ^= sig >> np.uint64(33)
            # Linked sets agree in more parts than are spare, so parts with few elements, which unlike sets share,
            # are left out as long as there are no more of them; by whole counts, so that two sets leave out the same ones
            out.append(sig[count >= np.partition(count, spare)[spare]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of a set as 64-bit words: a power of two of them, two to four for each element."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s >> np.uint64(11)) & np.uint64(size - 1)] = True
    return np.packbits(bits).view(np.uint64)


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    """The bitmap that the same set has with fewer words."""
    return words if len(words) == size else np.bitwise_or.reduce(words.reshape(-1, size))


def tile_links(n: np.ndarray, labels: np.ndarray, maps: list[np.ndarray], sides: np.ndarray | None, percent: int, linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs (positions) that join rows of different labels: sizes and bitmaps let them pass, and ``linked`` holds.

    With ``sides``, only rows of different sides are compared. A pair whose rows are
    joined by others already is left out.
    """
    if len(n) == 2:
        low, high = sorted(n.tolist())
        words = min(map(len, maps))
        apart = int(np.bitwise_count(_folded(maps[0], words) ^ _folded(maps[1], words)).sum())
        bound = (low + high - apart) // 2
        passes = labels[0] != labels[1] and (sides is None or sides[0] != sides[1]) and 100 * low >= percent * high and 100 * bound >= percent * (low + high - bound)
        return [(0, 1)] if passes and linked(0, 1) else []
    order = np.lexsort((np.arange(len(n)), n))
    sizes, labels = n[order], np.unique(labels, return_inverse=True)[1]
    last = np.searchsorted(sizes, 100 * sizes // percent, side="right")
    levels: dict[int, tuple[int, np.ndarray]] = {}

    def level(at: int) -> tuple[int, np.ndarray]:
        """Bitmaps of the rows, by size, that rows with as many words meet; and the first of these rows."""
        words = len(maps[order[at]])
        if words not in levels:
            top = at
            while top < len(order) and len(maps[order[top]]) == words:
                top += 1
            levels[words] = (at, np.stack([_folded(maps[i], words) for i in order[at : last[top - 1]]]))
        return levels[words]

    out = []
    for at, i in enumerate(order):
        js = order[at + 1 : last[at]]
        keep = labels[js] != labels[i]
        if sides is not None:
            keep &= sides[js] != sides[i]
        if not keep.any():
            continue
        js, places = js[keep], np.flatnonzero(keep) + at + 1
        first, rows = level(at)
        apart = np.bitwise_count(rows[places - first] ^ rows[at - first]).sum(axis=1)
        bound = (n[i] + n[js] - apart.astype(np.int64)) // 2
        for j in js[100 * bound >= percent * (n[i] + n[js] - bound)]:
            if labels[i] != labels[j] and linked(int(i), int(j)):
                labels[labels == labels[j]] = labels[i]
                out.append((int(i), int(j)))
    return out


def _overlap(sets: list[np.ndarray], percent: int) -> Callable[[int, int], bool]:
    """Whether two sets, as sorted arrays, are linked."""

    def linked(i: int, j: int) -> bool:
        a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    return linked


def _name(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(k1), int(k2)


def _profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """row, id, n, a 128-bit name of the set (k1, k2), the signatures of its parts and its bitmap, for each document."""

    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in row_slices(batches, DOCS_AT_ONCE):
            sets = [shingles(text, k, known) for text in batch.column("text").to_pylist()]
            names = np.array([_name(s) for s in sets], np.int64).reshape(-1, 2)
            parts = [signatures(s, percent).view(np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.record_batch({"id": batch.column("id"), "n": n, "k1": pa.array(names[:, 0]), "k2": pa.array(names[:, 1]), "signatures": lists, "bits": pa.array([bitmap(s).tobytes() for s in sets], pa.binary())})

    return docs.mapInArrow(profile, "id long, n long, k1 long, k2 long, signatures array<long>, bits binary").withColumn("row", F.monotonically_increasing_id())


def _families(profiles: DataFrame, copies: DataFrame) -> DataFrame:
    """(node, family) of the sets that agree with another in a part; ``copies`` (row) of an equal set are left out.

    Rows of one document follow each other and rows are numbered in order, so what is
    shuffled is little more than the signatures.
    """
    own = profiles.where("size(signatures) > 0").select(F.col("row").alias("node"), "signatures").join(maybe_broadcast(copies.withColumnRenamed("row", "node")), "node", "left_anti")
    tiles = own.select("node", F.explode("signatures").alias("signature"))
    heads = tiles.groupBy("signature").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("c")).where("a < b")
    heads = written(heads, "heads")
    sweep(profiles.sparkSession)
    pairs = heads.select("a", "b").distinct()
    # members of larger tiles are found by a join; a filter of the tiles' signatures keeps all others out of its shuffle
    more = heads.where("c > 2").select("signature", "a")
    table, blocks = bloom.build(more, "signature")
    members = bloom.possible(tiles, F.col("signature"), table, blocks).join(more, "signature").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    return connected_components(pairs.unionByName(members), "a", "b").select("node", F.col("component").alias("family"))


def _texts(docs: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """These columns of members (rep, ...) with the text of each document of that identifier."""
    if small(members):
        texts = docs.join(F.broadcast(members), docs["id"].eqNullSafe(members["rep"]))
    else:  # a filter keeps other documents out of the shuffle of texts
        table, blocks = bloom.build(members.select(F.coalesce("rep", F.lit(0)).alias("rep")), "rep")
        texts = bloom.possible(docs, F.coalesce("id", F.lit(0)), table, blocks).join(members, docs["id"].eqNullSafe(members["rep"]))
    return texts.select(*columns, "text")


def _own(sets: list[np.ndarray], batch: pa.RecordBatch) -> list[bool]:
    """Whether a set has the name of its row: else it is of another text of that identifier."""
    return [_name(s) == (k1, k2) for s, k1, k2 in zip(sets, batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)]


def _rare(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, family) of the members (node, n, rep, k1, k2) of families that share a rare shingle with another.

    All shingles have one order, from the rarest to the most frequent among these sets.
    A linked set has at least percent n / 100 of its n shingles in common with the other; the rarest
    of these is among the first shingles of both, however few of the last ones, less one, are left out.
    So passages that many sets have do not make a family, unless sets have little else.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in row_slices(batches, DOCS_AT_ONCE):
            sets = [shingles(text, k, known) for text in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
            yield batch.select(["node", "n"]).append_column("shingles", lists).filter(pa.array(_own(sets, batch), pa.bool_()))

    spark = docs.sparkSession
    rows = _texts(docs, members, "node", "n", "k1", "k2").mapInArrow(cut, "node long, n long, shingles array<long>").select("node", "n", F.explode("shingles").alias("shingle"))
    shared = written(rows.withColumn("sets", F.count("*").over(Window.partitionBy("shingle"))).where("sets > 1"), "shared")
    sweep(spark)
    # repeated documents have one rank for a shingle; shingles of one set only would come after all these
    last = F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("sets"), "shingle"))
    first = written(shared.withColumn("last", last).where(F.col("last") * 100 >= F.col("n") * percent).select("node", "shingle"), "rare")
    release(shared)
    sweep(spark)
    heads = first.groupBy("shingle").agg(F.min("node").alias("head"))
    edges = first.join(heads, "shingle").where("node <> head").select("head", "node").distinct()
    return connected_components(edges, "head", "node").select("node", F.col("component").alias("family"))


def _sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """node, family, n, bits, set (bytes) of each member (node, family, n, bits, rep, k1, k2), from the text of one document."""
    texts = _texts(docs, members, "node", "family", "n", "bits", "k1", "k2")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in row_slices(batches, DOCS_AT_ONCE):
            sets = [shingles(text, k, known) for text in batch.column("text").to_pylist()]
            rows = batch.select(["node", "family", "n", "bits"]).append_column("set", pa.array([s.tobytes() for s in sets], pa.binary()))
            yield rows.filter(pa.array(_own(sets, batch), pa.bool_()))

    return written(texts.mapInArrow(cut, "node long, family long, n long, bits binary, set binary").dropDuplicates(["node"]), "sets")


_Group = tuple[np.ndarray, np.ndarray, list, np.ndarray | None, np.ndarray | None, list | None, int]


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[list[_Group]]:
    """Groups of two rows or more that follow each other and have one key, a batch at a time: nodes, n, bits, labels, sides, sets, key."""

    def read(rows: pa.RecordBatch | pa.Table, cuts: list[int]) -> list[_Group]:
        column = lambda name: rows.column(name).to_numpy() if name in rows.schema.names else None
        keys, nodes, n, labels, sides = (column(c) for c in (key, "node", "n", "label", "side"))
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                some = rows.slice(a, b - a)
                sets = some.column("set").to_pylist() if "set" in some.schema.names else None
                out.append((nodes[a:b], n[a:b], some.column("bits").to_pylist(), None if labels is None else labels[a:b], None if sides is None else sides[a:b], sets, int(keys[a])))
        return out

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[0].column(key)[0].as_py() == keys[0]:
            held.append(batch.slice(0, cuts[1]))
            cuts = cuts[1:]
            if len(cuts) == 1:
                continue
        if held:
            whole = pa.Table.from_batches(held)
            yield read(whole, [0, whole.num_rows])
        held = [batch.slice(cuts[-2])]
        yield read(batch, cuts[:-1])
    if held:
        whole = pa.Table.from_batches(held)
        yield read(whole, [0, whole.num_rows])


def _always(i: int, j: int) -> bool:
    return True


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among rows (node, n, bits) of one key that may have a label, a side and a set; without sets all that bitmaps let pass."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _groups(batches, "key"):
            out: list[tuple[int, int, int]] = []
            for nodes, n, bits, labels, sides, sets, key in groups:
                maps = [np.frombuffer(x, np.uint64) for x in bits]
                linked = _always if sets is None else _overlap([np.frombuffer(x, np.uint64) for x in sets], percent)
                out += [(nodes[i], nodes[j], key) for i, j in tile_links(n, nodes if labels is None else labels, maps, sides, percent, linked)]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "key"])

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "a long, b long, key long")


def _tiled(rows: DataFrame, size: Column, tile: int) -> DataFrame:
    """Add key (of a tile), and spread: whether the family has more than one tile.

    Tiles of one family have rows of similar sizes, dealt out by hash, unless all of
    it fits one. ``family`` and ``pool`` part rows that need not share a tile.
    """
    rows = rows.withColumns({"slice": F.floor(F.log(F.col("n").cast("double")) * 8).cast("int"), "_size": size})
    slices = written(rows.groupBy("family", "pool", "slice").agg(F.count("*").alias("rows"), F.sum("_size").alias("bytes")), "slices")
    needed = lambda count, sums: F.greatest(F.ceil(count / tile), F.ceil(sums / TILE_BYTES))
    families = slices.groupBy("family").agg((needed(F.sum("rows"), F.sum("bytes")) > 1).alias("spread"))
    large = slices.join(families.where("spread"), "family").select("family", "pool", "slice", needed(F.col("rows"), F.col("bytes")).alias("tiles"))
    placed = rows.join(maybe_broadcast(written(large, "large")), ["family", "pool", "slice"], "left")
    own = F.xxhash64("family", "pool", "slice", F.pmod(F.xxhash64("node"), F.col("tiles")))
    return placed.withColumns({"spread": F.col("tiles").isNotNull(), "key": F.when(F.col("tiles").isNotNull(), own).otherwise(F.xxhash64("family"))}).drop("_size", "tiles", "slice")


def _meetings(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of tiles (l, r, key) of a family whose sizes allow a link; pairs all of one label are left out."""
    spans = tiles.groupBy("family", "key").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("g1"), F.max("label").alias("g2"))
    spans = written(spans, "spans")
    l, r = spans.alias("l"), spans.alias("r")
    sizes = 100 * F.least("l.hi", "r.hi") >= percent * F.greatest("l.lo", "r.lo")
    one = (F.col("l.g1") == F.col("l.g2")) & (F.col("r.g1") == F.col("r.g2")) & (F.col("l.g1") == F.col("r.g1"))
    pairs = l.join(r, (F.col("l.family") == F.col("r.family")) & (F.col("l.key") < F.col("r.key")) & sizes & ~one)
    return pairs.select(F.col("l.key").alias("l"), F.col("r.key").alias("r"), F.xxhash64("l.key", "r.key").alias("key"))


def _across(tiles: DataFrame, meetings: DataFrame) -> DataFrame:
    """Rows of tiles for each pair that they are in, with their side."""
    sides = meetings.select("key", F.explode(F.array(F.struct(F.col("l").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("r").alias("tile"), F.lit(1).alias("side")))).alias("s"))
    sides = sides.select("key", F.col("s.tile").alias("tile"), F.col("s.side").alias("side"))
    return tiles.withColumnRenamed("key", "tile").join(sides, "tile")


def _closer(rows: DataFrame, percent: int, tile: int) -> DataFrame:
    """(node, family) of rows (node, family, n, bits) that bitmaps let pass with another: linked sets stay together."""
    tiles = written(_tiled(rows.withColumns({"pool": F.lit(0).cast("long"), "label": F.col("node")}), F.length("bits"), tile), "maps")
    bits = tiles.select("node", "n", "bits", "key")
    across = _across(bits, _meetings(tiles.where("spread"), percent))
    edges = _compared(bits, percent).unionByName(_compared(across.select("node", "n", "bits", "key", "side"), percent))
    return connected_components(edges, "a", "b").select("node", F.col("component").alias("family"))


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the group that links have joined them to."""
    groups = connected_components(links, "a", "b")
    return rows.drop("label").join(maybe_broadcast(groups), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _links(sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links that connect all linked members of each family."""
    exact = ("node", "n", "bits", "set", "key", "label")
    alone = F.lit(0).cast("long")
    tiles = written(_tiled(sets.withColumns({"pool": alone, "label": F.col("node")}), F.length("set"), tile), "tiles")
    found = [written(_compared(tiles.select(*exact), percent), "links")]
    large = tiles.where("spread").select("node", "family", "n", "bits", "set")
    if not large.head(1):
        return found[0]
    every = lambda: reduce(DataFrame.unionByName, found)
    before = None
    while True:  # one member stands for its group
        grouped = written(_labelled(large, every()), "grouped")
        heads = written(grouped.groupBy("family", "label").agg(F.min("node").alias("node")), "heads")
        n = heads.count()
        if before is not None and 2 * n > before:
            break
        before = n
        rows = grouped.join(maybe_broadcast(heads.select("node")), "node", "left_semi").withColumn("pool", alone)
        found.append(written(_compared(_tiled(rows, F.length("set"), tile).select(*exact), percent), "links"))
    # large groups have tiles of their own, which do not meet
    large_groups = grouped.groupBy("family", "label").count().where(F.col("count") >= tile // 4).select("family", "label", F.col("label").alias("pool"))
    pooled = grouped.join(maybe_broadcast(large_groups), ["family", "label"], "left").withColumn("pool", F.coalesce("pool", F.lit(-1).cast("long")))
    tiles = written(_tiled(pooled, F.length("set"), tile), "tiles")
    found.append(written(_compared(tiles.select(*exact), percent), "links"))
    meetings = written(_meetings(tiles.where("spread"), percent), "meetings")
    bits = _across(tiles.select("node", "n", "bits", "label", "key"), meetings)
    passing = _compared(bits.select("node", "n", "bits", "label", "side", "key"), percent).select("key").distinct()
    meetings = meetings.join(maybe_broadcast(written(passing, "passing")), "key", "left_semi")
    found.append(written(_compared(_across(tiles.select(*exact), meetings).select(*exact, "side"), percent), "links"))
    return every()


def join(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per document: id, n_shingles, component_id, node.

    Sets a and b of k-word shingles link when 100 |a & b| >= percent |a | b|, for
    any percent from 1 to 100; low ones have more signatures and larger families.
    ``component_id`` is the smallest identifier reachable by links, itself included.
    Null and empty texts, and those without words, have no shingles and link with
    nothing; a text with fewer than k words is one shingle. Repeated rows are linked
    like other equal documents; null identifiers name a component only if it has no
    other. ``node`` stands for the set itself. No documents: no rows. Other columns
    are not read.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    profiles = written(_profiles(docs, k, percent), "profiles")
    some = profiles.where("n > 0").select("row", "id", "k1", "k2")
    classes = written(some.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("id").alias("low"), F.min_by("id", "row").alias("rep")), "classes")
    rows = written(profiles.select("row", "id", "n", "k1", "k2").join(classes.select("k1", "k2", "node"), ["k1", "k2"], "left").select("row", "id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), "rows")
    families = written(_families(profiles, rows.where("row <> node").select("row")), "families")
    sweep(docs.sparkSession)
    maps = written(profiles.select(F.col("row").alias("node"), "n", "bits"), "maps")
    release(profiles)  # signatures are most of it
    large = written(families.groupBy("family").count().where("count > 2").select("family"), "large")  # two are one pair
    if large.head(1):
        many = families.join(maybe_broadcast(large), "family", "left_semi").select("node").join(classes.select("node", "rep", "k1", "k2"), "node")
        many = written(many.join(maps.select("node", "n"), "node"), "many")
        families = written(families.join(maybe_broadcast(large), "family", "left_anti").select("node", "family").unionByName(_rare(docs, many, k, percent)), "families")
        sweep(docs.sparkSession)
    parted = written(_closer(maps.join(maybe_broadcast(families), "node"), percent, tile), "parted")
    members = maps.join(maybe_broadcast(parted), "node").join(classes.drop("low"), "node")
    members = written(members, "members")
    release(maps)
    sweep(docs.sparkSession)
    sets = _sets(docs, members, k)
    parts = connected_components(_links(sets, percent, tile).select("a", "b"), "a", "b")
    named = classes.select("node", "low").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    names = named.groupBy("part").agg(F.min("low").alias("component_id"))
    out = rows.join(named.join(names, "part").select("node", "component_id"), "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "node")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Documents with all their columns, less all but the smallest identifier of each component of near copies."""
    found = written(join(docs, k, percent), "components")
    # rows of one identifier and different texts may be in different components: the set decides
    gone = found.where("n_shingles > 0 and not (doc_id <=> component_id)").select("doc_id").distinct()
    stay = found.where("n_shingles = 0 or doc_id <=> component_id").select("doc_id")
    return without(docs, written(gone.join(stay, "doc_id", "left_anti"), "gone"), doc_id=docs["doc_id"])


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at 85 % of four-word shingles."""
    return join(read(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")
