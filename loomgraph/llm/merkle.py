"""Merkle dataset manifest (operator 11): trees of SHA-256 whose parents retain hash states.

A parent hashes the hexadecimal digests of up to three children, and each of those is
one block of SHA-256. So the state of the hash before a child's slot is eight words,
and a parent keeps a copy of it for every slot. With a replaced child the hash goes
on from the copy before its slot: it takes in the replacement and the siblings to
the right, never those to the left.

Trees are kept in pages, each a subtree of ``HEIGHT`` levels, so that a page is a row
of bounded size and a layer of pages is one shuffle. Roots of the pages of one layer
are the leaves of the next; the roots of all trees are the leaves of one tree above
them. A fold meets its page and the path from there to the root, which all rows of
the page share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import maybe_broadcast, placed, read, row_slices
from loomgraph.session import written

ARITY = 3
HEIGHT = 5
PAGE = ARITY**HEIGHT
#: A retained parent: the states before its slots, then its children, 32 bytes each.
RECORD = 2 * ARITY * 32
#: Pages that a task works on at once.
PAGES_AT_ONCE = 32


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _root_bits(n: int, degree: int) -> int:
    """The first 32 bits of the fraction of a root of n."""
    low, high = 0, 1 << 64
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**degree <= n << (32 * degree) else (low, middle)
    return low & 0xFFFFFFFF


_ROUNDS = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)
_START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32).reshape(8, 1)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def absorbed(states: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) of SHA-256 after a block (16, n) or (16, 1) of words: all rows at once."""
    w = list(block)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + w[i - 7] + (_turned(a, 7) ^ _turned(a, 18) ^ (a >> np.uint32(3))) + (_turned(b, 17) ^ _turned(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = states
    for k, x in zip(_ROUNDS, w, strict=True):
        first = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + (x + k)
        second = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return states + np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h))


def start(n: int) -> np.ndarray:
    return np.repeat(_START, n, axis=1)


def block_of(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) in hexadecimal, as words of a block each."""
    text = _HEX[np.stack([digests >> 4, digests & 15], axis=-1)].reshape(len(digests), 64)
    return np.ascontiguousarray(text.view(">u4").T).astype(np.uint32)


def _last(blocks: int) -> np.ndarray:
    """The padding after so many whole blocks."""
    words = np.zeros((16, 1), np.uint32)
    words[0], words[14], words[15] = 0x80000000, (blocks * 512) >> 32, (blocks * 512) & 0xFFFFFFFF
    return words


def _bytes(states: np.ndarray) -> np.ndarray:
    """States (8, n) as rows of 32 bytes."""
    return np.ascontiguousarray(states.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def _words(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(rows).view(">u4").T).astype(np.uint32)


def finished(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of hashes that have taken in so many blocks each."""
    out = np.empty((states.shape[1], 32), np.uint8)
    for count in np.unique(blocks):
        some = blocks == count
        out[some] = _bytes(absorbed(states[:, some], _last(int(count))))
    return out


def parents(digests: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level up: digests and records of the parents, and their number, for groups of so many children in a row."""
    ups = -(-counts // ARITY)
    group = np.repeat(np.arange(len(counts)), ups)
    index = np.arange(len(group)) - np.repeat(np.cumsum(ups) - ups, ups)
    first = (np.cumsum(counts) - counts)[group] + ARITY * index
    have = np.minimum(ARITY, counts[group] - ARITY * index)
    records = np.zeros((len(group), 2 * ARITY, 32), np.uint8)
    states = start(len(group))
    for slot in range(ARITY):
        some = have > slot
        records[:, slot] = _bytes(states)
        children = digests[first[some] + slot]
        records[some, ARITY + slot] = children
        states[:, some] = absorbed(states[:, some], block_of(children))
    return finished(states, have), records.reshape(-1, RECORD), ups


def levels(n: int) -> int:
    """Levels above n leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


def climbed(digests: np.ndarray, records: np.ndarray, slots: np.ndarray, have: np.ndarray, proofs: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level up for rows by themselves: the parents with these digests in these slots, and hashes of the siblings.

    Each row goes on from the copied state before its slot.
    """
    rows = np.arange(len(digests))
    records = records.reshape(-1, 2 * ARITY, 32)
    states = absorbed(_words(records[rows, slots]), block_of(digests))
    proofs, blocks = proofs.copy(), blocks.copy()
    for other in range(ARITY):
        some = (other < have) & (other != slots)
        if some.any():
            sibling = block_of(records[some, ARITY + other])
            proofs[:, some] = absorbed(proofs[:, some], sibling)
            blocks[some] += 1
            right = other > slots[some]
            if right.any():
                at = np.flatnonzero(some)[right]
                states[:, at] = absorbed(states[:, at], sibling[:, right])
    return finished(states, have), proofs, blocks


def _rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of so many bytes, and how many rows each has."""
    values = column.to_pylist()
    sizes = np.array([len(x) // width for x in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, width), sizes


PAGES = "tree string, chunk long, n long, leaves long, root binary, records binary"


def _pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of rows (tree, chunk, n, leaves in order): the records of all parents, level by level, and the root."""
    for batch in row_slices(batches, PAGES_AT_ONCE):
        lists = batch.column("leaves")
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        digests = _rows(lists.flatten().field("digest"), 32)[0]
        totals = batch.column("n").to_numpy()
        left = np.array([HEIGHT if n > PAGE else levels(int(n)) for n in totals], np.int64)
        sizes = counts.copy()
        parts: list[list[bytes]] = [[] for _ in sizes]
        roots = [b""] * len(sizes)
        live = np.arange(len(sizes))
        while len(live):
            done = left[live] == 0
            starts = np.cumsum(counts) - counts
            for i in np.flatnonzero(done):
                roots[live[i]] = digests[starts[i]].tobytes()
            stay = np.repeat(~done, counts)
            digests, counts, live = digests[stay], counts[~done], live[~done]
            if not len(live):
                break
            digests, records, counts = parents(digests, counts)
            ends = np.cumsum(counts)
            for i, page in enumerate(live):
                parts[page].append(records[ends[i] - counts[i] : ends[i]].tobytes())
            left[live] -= 1
        yield pa.record_batch(
            {"tree": batch.column("tree"), "chunk": batch.column("chunk"), "n": batch.column("n"), "leaves": pa.array(sizes), "root": pa.array(roots, pa.binary()), "records": pa.array([b"".join(p) for p in parts], pa.binary())}
        )


#: A step of a path: a record, the slot, and how many children there are.
STEP = RECORD + 2


@dataclass
class _Page:
    """What rows of a batch of pages need to climb: records, where each page's begin, leaves of each page."""

    records: np.ndarray
    first: np.ndarray
    leaves: np.ndarray
    heights: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Page:
        records, counts = _rows(batch.column("records"), RECORD)
        heights = np.array([HEIGHT if n > PAGE else levels(int(n)) for n in batch.column("n").to_numpy()], np.int64)
        return cls(records, np.cumsum(counts) - counts, batch.column("leaves").to_numpy(), heights)

    def steps(self, page: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For rows at places of pages, level by level: which of them climb, and their records, slots and numbers of children."""
        first, width, place = self.first[page], self.leaves[page], at.copy()
        for level in range(HEIGHT):
            some = np.flatnonzero(self.heights[page] > level)
            if not len(some):
                return
            up = place // ARITY
            slot, have = place - ARITY * up, np.minimum(ARITY, width - ARITY * up)
            yield some, self.records[first[some] + up[some]], slot[some], have[some]
            first, width, place = first + -(-width // ARITY), -(-width // ARITY), up


PATHS = "tree string, chunk long, path binary"


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path from each leaf of pages (with ``path``, theirs) to the root."""
    for batch in row_slices(batches, PAGES_AT_ONCE):
        pages = _Page.of(batch)
        page = np.repeat(np.arange(batch.num_rows), pages.leaves)
        at = np.arange(len(page)) - np.repeat(np.cumsum(pages.leaves) - pages.leaves, pages.leaves)
        paths: list[list[bytes]] = [[] for _ in page]
        for some, records, slots, have in pages.steps(page, at):
            rows = np.concatenate([records, slots.astype(np.uint8)[:, None], have.astype(np.uint8)[:, None]], axis=1)
            for i, row in zip(some, rows, strict=True):
                paths[i].append(row.tobytes())
        above = batch.column("path").to_pylist()
        trees, chunks = batch.column("tree").to_pylist(), batch.column("chunk").to_numpy()
        yield pa.record_batch(
            {"tree": pa.array([trees[i] for i in page], pa.string()), "chunk": pa.array(chunks[page] * PAGE + at), "path": pa.array([b"".join(p) + above[i] for p, i in zip(paths, page, strict=True)], pa.binary())}
        )


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pages climb to the root: ``rows`` has (place in the page, ref, digest) for each."""
    for batch in row_slices(batches, PAGES_AT_ONCE):
        pages = _Page.of(batch)
        lists = batch.column("rows")
        counts = lists.value_lengths().to_numpy()
        rows = lists.flatten()
        page = np.repeat(np.arange(batch.num_rows), counts)
        at = rows.field("at").to_numpy()
        digests = _rows(rows.field("digest"), 32)[0].copy()
        proofs, blocks = start(len(page)), np.zeros(len(page), np.int64)
        for some, records, slots, have in pages.steps(page, at):
            digests[some], proofs[:, some], blocks[some] = climbed(digests[some], records, slots, have, proofs[:, some], blocks[some])
        steps, sizes = _rows(batch.column("path"), STEP)
        first = np.cumsum(sizes) - sizes
        for step in range(int(sizes.max(initial=0))):
            some = np.flatnonzero(sizes[page] > step)
            taken = steps[first[page[some]] + step]
            digests[some], proofs[:, some], blocks[some] = climbed(digests[some], taken[:, :RECORD], taken[:, RECORD].astype(np.int64), taken[:, RECORD + 1].astype(np.int64), proofs[:, some], blocks[some])
        trees = batch.column("tree").to_pylist()
        yield pa.record_batch(
            {
                "tree": pa.array([trees[i] for i in page], pa.string()),
                "ref": rows.field("ref"),
                "folded": pa.array([x.tobytes() for x in digests], pa.binary()),
                "proof": pa.array([x.tobytes() for x in finished(proofs, blocks)], pa.binary()),
            }
        )


@dataclass
class Forest:
    """Layers of pages, from the leaves up."""

    layers: list[DataFrame] = field(default_factory=list)

    @classmethod
    def grown(cls, leaves: DataFrame) -> Forest:
        """Trees over leaves (tree, at, n, digest), as ``placed`` gives them."""
        forest = cls()
        while True:
            inside = F.sort_array(F.collect_list(F.struct((F.col("at") % PAGE).cast("int").alias("at"), "digest")))
            whole = leaves.groupBy("tree", F.floor(F.col("at") / PAGE).alias("chunk"), "n").agg(inside.alias("leaves"))
            layer = written(whole.mapInArrow(_pages, PAGES), "pages")
            forest.layers.append(layer)
            above = layer.where(F.col("n") > PAGE)
            if not above.head(1):
                return forest
            leaves = above.select("tree", F.col("chunk").alias("at"), F.ceil(F.col("n") / PAGE).alias("n"), F.col("root").alias("digest"))

    def roots(self) -> DataFrame:
        """(tree, root)."""
        found = self.layers[0].where(F.col("n") <= PAGE).select("tree", "root")
        for layer in self.layers[1:]:
            found = found.unionByName(layer.where(F.col("n") <= PAGE).select("tree", "root"))
        return found

    def with_paths(self, paths: DataFrame) -> DataFrame:
        """The pages of the first layer, each with the path from its root on; ``paths`` (tree, path) has those of whole trees."""
        above = None
        for layer in reversed(self.layers):
            ends = layer.where(F.col("n") <= PAGE).join(paths, "tree")
            if above is not None:
                ends = ends.unionByName(layer.where(F.col("n") > PAGE).join(above, ["tree", "chunk"]))
            if layer is self.layers[0]:
                return ends
            above = written(ends.mapInArrow(_paths, PATHS), "paths")
        raise ValueError("no layers")


class Manifest:
    """A forest of trees, one for each ``tree`` of the leaves, and a tree over their roots in the order of their names."""

    def __init__(self, leaves: DataFrame) -> None:
        self.trees = Forest.grown(leaves)
        self.subroots = written(placed(self.trees.roots().select(F.col("tree").alias("own"), F.col("root").alias("digest"), F.lit("").alias("tree")), "own"), "subroots")
        self.top = Forest.grown(self.subroots.select("tree", "at", "n", "digest"))

    def root(self) -> bytes | None:
        """The root of all; none without leaves."""
        first = self.top.roots().first()
        return None if first is None else bytes(first["root"])

    def fold(self, rows: DataFrame) -> DataFrame:
        """(tree, ref, folded, proof) of rows (tree, at, ref, digest): the root that a leaf leads to, and the hash of its siblings.

        Each row by itself replaces the leaf at its place, of which there is one row at
        most; ``ref`` is what the caller wants back.
        """
        start_of_all = rows.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(b"").alias("path"))
        tops = self.top.with_paths(start_of_all).mapInArrow(_paths, PATHS).select(F.col("chunk").alias("at"), "path")
        ends = written(self.subroots.join(tops, "at").select(F.col("own").alias("tree"), "path"), "ends")
        inside = F.collect_list(F.struct((F.col("at") % PAGE).alias("at"), "ref", "digest"))
        some = rows.groupBy("tree", F.floor(F.col("at") / PAGE).alias("chunk")).agg(inside.alias("rows"))
        ref = rows.schema["ref"].dataType.simpleString()
        return some.join(self.trees.with_paths(ends), ["tree", "chunk"]).mapInArrow(_folded, f"tree string, ref {ref}, folded binary, proof binary")


def encoded(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def tree_name(group: Column) -> Column:
    """A name for each value of a column, null included; names are in the order of the values, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def verified(rows: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof, folded and verified of rows (tree, id, leaf, changed).

    ``changed`` is the leaf as it is now, null if it is as before. A tree's leaves
    ascend by id (null first), then by leaf; repeated rows are leaves of their own.
    """
    table = placed(rows, "id", "leaf")
    table = written(table, "leaves")
    manifest = Manifest(table.select("tree", "at", "n", F.col("leaf").alias("digest")))
    root = manifest.root()
    found = manifest.fold(table.select("tree", "at", F.struct("id", "leaf").alias("ref"), F.coalesce("changed", "leaf").alias("digest")))
    subroots = manifest.trees.roots().select("tree", F.col("root").alias("subroot"))
    whole = found.join(maybe_broadcast(subroots), "tree").withColumn("root", F.lit(root).cast("binary"))
    return whole.select("ref.id", "ref.leaf", "subroot", "root", "proof", "folded", (F.col("folded") == F.col("root")).alias("verified"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tree for each source; of documents with an even crc32 of the identifier the line ends of the text are deleted.

    A null identifier counts as empty text for that, so it is even. No documents: no rows.
    """
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    values = [F.col(c) for c in FIELDS]
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    changed = F.when(even & F.contains("text", F.lit("\n")), leaf(*values[:-1], F.replace("text", F.lit("\n"), F.lit(""))))
    rows = written(docs.select(tree_name(F.col("source")).alias("tree"), F.col("doc_id").alias("id"), leaf(*values).alias("leaf"), changed.alias("changed")), "digests")
    named = lambda c: F.lower(F.hex(c))
    found = verified(rows)
    return found.select(F.col("id").alias("doc_id"), *[named(c).alias(c) for c in ("leaf", "subroot", "root")], named("proof").alias("proof_sha256"), named("folded").alias("folded_root"), "verified")


OP11_SQL = """
WITH RECURSIVE enc AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, text,
    coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents
), crc AS (
  SELECT range::BIGINT AS byte, list_reduce(list_concat([range::BIGINT], range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) AS entry FROM range(256)
), ids AS (
  SELECT DISTINCT doc_id, coalesce(doc_id::VARCHAR, '') AS name FROM documents
), sums AS (
  SELECT doc_id, name, 0 AS i, 4294967295 AS c FROM ids
  UNION ALL
  SELECT doc_id, name, i + 1, xor(c >> 8, entry) FROM sums JOIN crc ON byte = xor(c & 255, ord(name[i + 1])) WHERE i < length(name)
), even AS (
  SELECT doc_id FROM sums WHERE i = length(name) AND xor(c, 4294967295) % 2 = 0
), leaves AS (
  SELECT e.doc_id, tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN even.doc_id IS NOT NULL THEN replace(text, chr(10), '') ELSE text END AS now, head
  FROM enc e LEFT JOIN even ON e.doc_id = even.doc_id
), placed AS (
  SELECT *, sha256(head || coalesce(octet_length(encode(now)) || ':' || now, '-')) AS changed,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), up AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 3, n
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), over_all AS (
  SELECT 0 AS lvl, pos, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM over_all WHERE n > 1 GROUP BY lvl, pos // 3, n
), runs AS (
  SELECT tree, lvl, pos // 3 AS run, list(digest ORDER BY pos) AS kids FROM up WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT lvl, pos // 3 AS run, list(digest ORDER BY pos) AS kids FROM over_all WHERE n > 1 GROUP BY ALL
), climb AS (
  SELECT doc_id, leaf, tree, 0 AS lvl, pos, changed AS digest, '' AS proof, row_number() OVER () AS row FROM placed
  UNION ALL
  SELECT doc_id, leaf, c.tree, c.lvl + 1, pos // 3, sha256(array_to_string(list_transform(kids, lambda k, i: CASE WHEN i = pos % 3 + 1 THEN digest ELSE k END), '')),
    proof || array_to_string(list_filter(kids, lambda k, i: i <> pos % 3 + 1), ''), row
  FROM climb c JOIN runs r ON r.tree = c.tree AND r.lvl = c.lvl AND r.run = pos // 3
), crowns AS (
  SELECT c.*, s.digest AS subroot, s.pos AS place FROM climb c JOIN subroots s USING (tree)
  WHERE c.lvl = (SELECT max(lvl) FROM up WHERE up.tree = c.tree)
), last AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, place AS pos, digest, proof FROM crowns
  UNION ALL
  SELECT doc_id, leaf, subroot, c.lvl + 1, pos // 3, sha256(array_to_string(list_transform(kids, lambda k, i: CASE WHEN i = pos % 3 + 1 THEN digest ELSE k END), '')),
    proof || array_to_string(list_filter(kids, lambda k, i: i <> pos % 3 + 1), '')
  FROM last c JOIN top_runs r ON r.lvl = c.lvl AND r.run = pos // 3
), root AS (SELECT digest AS root, lvl AS top FROM over_all WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM last, root WHERE lvl = top
"""
