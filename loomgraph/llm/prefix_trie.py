"""Conversation prefix trie (operator 13): adaptive radix trees over turn ids of fixed width.

A turn's id is 16 bytes of the SHA-256 of its role and text, and its text's code points
in four bytes, big end first. A conversation is a key, the ids of its turns in a row.

* Keys are parted by their first turn. A part of many keys is parted again behind the
  longest prefix that all of its keys share, which its smallest and largest key tell.
* A task builds one adaptive radix tree for each of its parts, one after the other: inner nodes
  have room for 4, 16, 48 or 256 children and grow as needed, and a node holds the
  bytes that all keys below it share. Only depths at whole turns are nodes of the trie.
* What a part knows of its own first turns, which other parts have too, is added up in
  a last aggregation over these few nodes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import maybe_broadcast, placed, read, row_slices
from loomgraph.llm.merkle import encoded
from loomgraph.session import release, written

HASH = 16
WIDTH = HASH + 4
#: A part of more keys than this is parted again.
KEYS = 250
#: Identifiers that are joined to one text before they are hashed.
IDS_AT_ONCE = 10_000


class Node:
    """An inner node: the bytes that follow its branch in all keys below, its children, and the key that ends here, if one does.

    Layouts are 4 and 16 (sorted bytes beside children), 48 (a slot for each byte) and 256 (a child for each byte).
    """

    __slots__ = ("end", "keys", "kids", "layout", "low", "n", "path")

    def __init__(self, path: bytes) -> None:
        self.path, self.layout, self.keys, self.kids = path, 4, bytearray(), []
        self.end: tuple | None = None
        self.n, self.low = 0, None

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = bisect_left(self.keys, byte)
            return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None
        if self.layout == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Add a child, or replace that of the same byte; a full node takes the next layout."""
        if self.layout <= 16:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = kid
                return
            if len(self.keys) < self.layout:
                self.keys.insert(at, byte)
                self.kids.insert(at, kid)
                return
            self._grow()
            self.put(byte, kid)
        elif self.layout == 48:
            at = self.keys[byte]
            if at:
                self.kids[at - 1] = kid
            elif len(self.kids) < 48:
                self.kids.append(kid)
                self.keys[byte] = len(self.kids)
            else:
                self._grow()
                self.put(byte, kid)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        pairs = self.children()
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            self.layout, self.keys = 48, bytearray(256)
            for slot, (byte, _) in enumerate(pairs, 1):
                self.keys[byte] = slot
        else:
            self.layout, self.keys, self.kids = 256, bytearray(), [None] * 256
            for byte, kid in pairs:
                self.kids[byte] = kid

    def children(self) -> list[tuple[int, Node]]:
        """Children and their bytes, in order."""
        if self.layout <= 16:
            return list(zip(self.keys, self.kids, strict=True))
        if self.layout == 48:
            return [(byte, self.kids[at - 1]) for byte, at in enumerate(self.keys) if at]
        return [(byte, kid) for byte, kid in enumerate(self.kids) if kid is not None]


def _shared(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of a path the key has from a place on."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:  # the longest prefix of the path that the key has there
        middle = (low + high + 1) // 2
        low, high = (middle, high) if key.startswith(path[:middle], at) else (low, middle - 1)
    return low


class Tree:
    """An adaptive radix tree of distinct keys; nodes know how many members are below, and the smallest."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def insert(self, key: bytes, n: int, low: int, end: object) -> None:
        """A key with its number of members, the smallest of them, and what is to be told where it ends."""
        fresh = None
        if self.root is None:
            self.root = fresh = Node(key)
        node, above, byte, at = self.root, None, 0, 0
        while fresh is None:
            same = _shared(node.path, key, at)
            if same < len(node.path):  # the compressed path parts here
                upper = Node(node.path[:same])
                upper.n, upper.low = node.n, node.low
                upper.put(node.path[same], node)
                node.path = node.path[same + 1 :]
                if above is None:
                    self.root = upper
                else:
                    above.put(byte, upper)
                node = upper
            at += same
            node.n += n
            node.low = low if node.low is None else min(node.low, low)
            if at == len(key):
                node.end = (end,)
                return
            above, byte = node, key[at]
            below = node.child(byte)
            at += 1
            if below is None:
                fresh = Node(key[at:])
                above.put(byte, fresh)
            else:
                node = below
        fresh.n, fresh.low, fresh.end = n, low, (end,)

    def turns(self) -> Iterator[tuple[int, int, int, int, int, object]]:
        """The nodes at whole turns, each before those below: own index of the parent (-1: none), depth, members, smallest, code points, end."""
        count = 0
        stack = [] if self.root is None else [(self.root, b"", 0, -1, True)]
        while stack:
            node, rest, depth, parent, first = stack.pop()
            span = rest + node.path
            if first:  # the trie's root
                yield -1, 0, node.n, node.low, 0, node.end[0] if node.end and not span else None
                parent, count = 0, 1
            whole = len(span) // WIDTH
            for i in range(whole):
                depth += 1
                length = int.from_bytes(span[i * WIDTH + HASH : (i + 1) * WIDTH], "big")
                ends = node.end is not None and (i + 1) * WIDTH == len(span)
                yield parent, depth, node.n, node.low, length, node.end[0] if ends else None
                parent, count = count, count + 1
            rest = span[whole * WIDTH :]
            for byte, kid in reversed(node.children()):
                stack.append((kid, rest + bytes((byte,)), depth, parent, False))


NODES = "part binary, prefix binary, depth long, low long, parent long, n long, length long, children long, leaves long, saved long, ends binary"


def _trie(rows: list[tuple[bytes, int, int, bytes]], part: bytes) -> Iterator[tuple]:
    """The columns of ``NODES`` of one part: nodes of its own whole, and for those of the part's prefix what it knows of them."""
    tree = Tree()
    for key, n, low, ends in rows:
        tree.insert(key, n, low, ends)
    nodes = list(tree.turns())
    children, leaves, saved = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    own = len(part) // WIDTH
    for i in range(len(nodes) - 1, -1, -1):
        up, depth, n, _, length, _ = nodes[i]
        if depth <= own:
            continue
        leaves[i] += not children[i]
        saved[i] += (n - 1) * length
        children[up] += 1
        leaves[up] += leaves[i]
        saved[up] += saved[i]
    for i, (up, depth, n, low, length, ends) in enumerate(nodes):
        shared = depth <= own
        yield part, part[: depth * WIDTH] if shared else None, depth, low, None if shared else nodes[up][3], n, length, children[i], leaves[i], saved[i], ends


def _runs(batches: Iterable[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple[bytes, list[tuple]]]:
    """Rows that follow each other and have one key."""
    held: list[tuple] = []
    now: bytes | None = None
    for batch in row_slices(batches, 512):
        for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(tuple(row))
    if held:
        yield now, held


def _tries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in NODES.split(", ")])
    rows: list[tuple] = []
    for part, keys in _runs(batches, "part", ["key", "n", "low", "ends"]):
        for row in _trie(keys, part):
            rows.append(row)
            if len(rows) == 4096:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _prefix(key: Column | str, turns: Column) -> Column:
    return F.substring(key, F.lit(1), (turns * WIDTH).cast("int"))


def _cuts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part the turns that all its keys share, and one more."""
    for batch in batches:
        out = []
        for a, b in zip(batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True):
            out.append(_shared(a, b, 0) // WIDTH + 1)
        yield pa.record_batch({"part": batch.column("part"), "turns": pa.array(out, pa.int64())})


def parted(keys: DataFrame, limit: int = KEYS) -> DataFrame:
    """Keys with ``part``, a prefix of whole turns (or all of a key that is no longer).

    A part of more than ``limit`` keys is cut after one turn more than its keys share,
    until none is left: distinct keys always part in the end.
    """
    now = written(keys.withColumn("part", _prefix("key", F.lit(1))), "parts")
    while True:
        sizes = now.groupBy("part").agg(F.count("*").alias("c"), F.min("key").alias("first"), F.max("key").alias("last"))
        large = written(sizes.where(F.col("c") > limit).mapInArrow(_cuts, "part binary, turns long"), "cuts")
        if not large.head(1):
            return now
        after = now.join(maybe_broadcast(large), "part", "left").withColumn("part", F.when(F.col("turns").isNull(), F.col("part")).otherwise(_prefix("key", F.col("turns"))))
        after = written(after.select(*now.columns), "parts")
        release(now, large)
        now = after


def joined_digests(rows: DataFrame) -> DataFrame:
    """(key, ends) of rows (tree, value): SHA-256 of the values of each tree, ascending, comma-joined in decimal.

    Values are sorted in ranges and joined to texts of some thousand each, so that
    even for a tree of many values one task only hashes texts as they come.
    """
    ranged = rows.repartitionByRange("tree", "value").sortWithinPartitions("tree", "value")

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["tree", "first", "values"])

        now, held = None, []
        for some in batches:
            for tree, value in zip(some.column("tree").to_pylist(), some.column("value").to_pylist(), strict=True):
                if held and (tree != now or len(held) == IDS_AT_ONCE):
                    found.append((now, held[0], ",".join(map(str, held))))
                    held = []
                    if len(found) == 1024:
                        yield batch()
                        found = []
                now = tree
                held.append(value)
        if held:
            found.append((now, held[0], ",".join(map(str, held))))
        if found:
            yield batch()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in row_slices(batches, 256):
            out = []
            for tree, text in zip(batch.column("tree").to_pylist(), batch.column("values").to_pylist(), strict=True):
                if state is None or tree != now:
                    if state is not None:
                        out.append((now, state.digest()))
                    now, state = tree, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if out:
                yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["key", "ends"])
        if state is not None:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([state.digest()], pa.binary())], names=["key", "ends"])

    blocks = ranged.mapInArrow(texts, "tree binary, first long, values string")
    return blocks.repartition("tree").sortWithinPartitions("tree", "first").mapInArrow(hashed, "key binary, ends binary")


def trie(sequences: DataFrame, limit: int = KEYS) -> DataFrame:
    """The nodes of the trie over sequences (conv_id, key): one row a node, the root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. No sequences: no rows.
    """
    named = sequences.withColumn("tree", F.unhex(F.sha2("key", 256)))
    named = written(named.select("tree", "conv_id", "key"), "named")
    ends = joined_digests(named.select("tree", F.col("conv_id").alias("value")))
    keys = named.groupBy("tree").agg(F.first("key").alias("key"), F.count("*").alias("n"), F.min("conv_id").alias("low"))
    keys = keys.join(ends.withColumnRenamed("key", "tree"), "tree").drop("tree")
    parts = parted(keys, limit)
    nodes = written(parts.repartition("part").sortWithinPartitions("part").mapInArrow(_tries, NODES), "nodes")
    own = nodes.where("prefix is null").select(F.col("low").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n", "children", "leaves", "saved", "ends")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    upper = written(nodes.where("prefix is not null").groupBy("prefix", "depth").agg(F.min("low").alias("low"), F.max("ends").alias("ends"), F.max("length").alias("length"), *sums), "upper")
    above = F.when(F.col("depth") > 0, _prefix("prefix", F.col("depth") - 1)).alias("above")
    some = upper.where("depth > 0").groupBy(above).agg(F.count("*").alias("more"))
    counted = upper.join(maybe_broadcast(written(some, "some").withColumnRenamed("above", "prefix")), "prefix", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    counted = counted.withColumns({"leaves": F.col("leaves") + (F.col("children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("length")})
    counted = written(counted, "counted")
    tops = F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth"))).alias("k")
    totals = counted.select("prefix", "leaves", "saved", tops).groupBy(_prefix("prefix", F.col("k")).alias("prefix")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    lows = counted.where("children > 0").select(F.col("prefix").alias("above"), F.col("low").alias("parent"))
    whole = counted.drop("leaves", "saved").join(totals, "prefix").withColumn("above", above)
    whole = whole.join(maybe_broadcast(lows), "above", "left").select(F.col("low").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n", "children", "leaves", "saved", "ends")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = own.unionByName(whole)
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce(F.lower(F.hex("ends")), empty).alias("ends_sha256")
    )


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn in hexadecimal."""
    return F.concat(F.sha2(F.concat(encoded(role), encoded(text)), 256).substr(1, 2 * HASH), F.lower(F.lpad(F.hex(F.length(text)), 8, "0")))


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, at, id) of rows (conv_id, turn, role, text): the places of turns from 0, null turns first.

    Null roles and texts are empty. Ties of one turn are taken in order of their ids.
    Rows without a conversation are left out. A large conversation is sorted in ranges, by many tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    ids = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), turn_id(role, text).alias("id"))
    return placed(written(ids, "ids"), "turn", "id").select(F.col("tree").alias("conv_id"), "at", "id")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key) of turns (conv_id, at, id), where a null id only says that there is such a conversation.

    A conversation's ids are one value, of 20 bytes a turn; texts are not moved.
    """
    each = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id"))))
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(each, lambda x: x["id"]), "")).alias("key"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of conversations that begin like the first of their hundred: crc32 of the identifier, mod 6, says how many turns."""
    many = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("long")
    own = turns.select("conv_id", "at", F.when(F.col("at") >= many, F.col("id")).alias("id"))
    convs = turns.select("conv_id").distinct().withColumn("many", many).where("many > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    heads = turns.where((F.col("at") < 5) & (F.col("conv_id") % 100 == 0)).select(F.col("conv_id").alias("base"), "at", "id")
    return own.unionByName(convs.join(heads, "base").where("at < many").select("conv_id", "at", "id"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each of which begins like the first of its hundred."""
    turns = written(numbered(read(spark, sf_dir, "conversations")), "turns")
    return trie(sequences(rebuilt(turns)))


OP13_SQL = """
WITH RECURSIVE crc AS (
  SELECT range::BIGINT AS byte, list_reduce(list_concat([range::BIGINT], range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) AS entry FROM range(256)
), ids AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS name FROM conversations WHERE conv_id IS NOT NULL
), sums AS (
  SELECT conv_id, name, 0 AS i, 4294967295 AS c FROM ids
  UNION ALL
  SELECT conv_id, name, i + 1, xor(c >> 8, entry) FROM sums JOIN crc ON byte = xor(c & 255, ord(name[i + 1])) WHERE i < length(name)
), heads AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(c, 4294967295) % 6 AS h FROM sums WHERE i = length(name)
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(r)) || ':' || r || octet_length(encode(t)) || ':' || t)) AS p, {'r': r, 't': t} AS t
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
), parts AS (
  SELECT conv_id, p, t FROM own JOIN heads USING (conv_id) WHERE p > h
  UNION ALL
  SELECT heads.conv_id, p, t FROM heads JOIN own ON own.conv_id = base WHERE p <= h
), seqs AS (
  SELECT conv_id, coalesce(list(t ORDER BY p) FILTER (p IS NOT NULL), []) AS ts FROM heads LEFT JOIN parts USING (conv_id) GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS depth FROM seqs
), nodes AS (
  SELECT ts[1:depth] AS pre, depth, min(conv_id) AS low, count(*) AS n, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(ts) = depth) AS ends,
    (count(*) - 1) * CASE WHEN depth > 0 THEN length(any_value(ts)[depth].t) ELSE 0 END AS saved
  FROM prefixes GROUP BY 1, 2
), kids AS (
  SELECT pre[1:depth - 1] AS pre, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (pre)
), totals AS (
  SELECT pre[1:d] AS pre, sum((k = 0)::BIGINT)::BIGINT AS leaves, sum(saved)::BIGINT AS saved
  FROM (SELECT pre, k, saved, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY 1
)
SELECT c.low AS conv_id, c.depth::BIGINT AS depth, up.low AS parent_conv_id, c.n AS n_convs, c.k AS n_children, t.leaves AS n_leaves, t.saved AS saved_tokens,
       sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN totals t ON c.pre = t.pre LEFT JOIN counted up ON c.depth > 0 AND up.pre = c.pre[1:c.depth - 1]
"""
