"""Sharding (operator 9): balanced label propagation in iterative joins.

Documents are linked through keys that they share, such as a text. In each round a
document learns which shard most of its neighbours are in and asks to move there;
a shard takes in as many as its quota leaves free. A last step evens the counts
out, moving documents without links first, and numbers the rows of each shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.llm.common import read
from loomgraph.session import release, written

#: A key of more than this part of all linked rows is hot.
HOT_SHARE = 1_000
#: Rows to number in one task in the last step.
ROWS_PER_BUCKET = 100_000


def joined(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows with a written table of one row a key, which has in n how many rows it meets.

    Keys that meet more than a thousandth of all these are a thousand at most: they are
    broadcast, so that no task gets the rows of a large group. The others are shuffled.
    """
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    large = F.col("n") * HOT_SHARE > total
    hot = table.where(large)
    some = F.broadcast(hot.select(F.col(key).alias("hot_key"), F.struct(*[c for c in hot.columns if c != key]).alias("hot")))
    marked = rows.join(some, F.col(key) == F.col("hot_key"), "left").drop("hot_key")
    apart = marked.where("hot is not null").select(*rows.columns, "hot.*")
    return apart.unionByName(marked.where("hot is null").drop("hot").join(table.where(~large), key, how).select(*apart.columns))


def edges_cut(placed: DataFrame) -> DataFrame:
    """One row: pairs of rows (key, shard) with one key, and how many of them are in different shards."""
    inside = placed.groupBy("key", "shard").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    groups = inside.groupBy("key").agg(pairs(F.sum("n").cast("double")).alias("edges"), F.sum(pairs(F.col("n").cast("double"))).alias("kept"))
    return groups.agg(F.coalesce(F.sum("edges"), F.lit(0.0)).cast("long").alias("edges"), F.coalesce(F.sum(F.col("edges") - F.col("kept")), F.lit(0.0)).cast("long").alias("cut"))


def _loads(placed: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def propagate(nodes: DataFrame, shards: int, rounds: int = 6, slack: float = 0.25) -> DataFrame:
    """Rounds of label propagation over nodes (row, key, linked), with column shard added.

    Shards may hold up to ``1 + slack`` of the mean while rounds last; the last step
    takes back what is over, nodes without links first. It ends before ``rounds`` where no
    node wants to move; ``edges_cut`` tells what is left. Only linked nodes take part. Nodes move
    towards the shard with room that holds most nodes with their key (ties: by hash).
    """
    start = nodes.withColumn("shard", F.pmod(F.xxhash64(F.lit("start"), "row"), F.lit(shards)).cast("int"))
    alone, placed = written(start.where("not linked"), "alone"), written(start.where("linked"), "linked")
    fixed = _loads(alone, shards)
    for turn in range(rounds):
        loads = [a + b for a, b in zip(fixed, _loads(placed, shards), strict=True)]
        quota = [max(0, int(sum(loads) / shards * (1 + slack)) - n) for n in loads]
        votes = placed.groupBy("key", "shard").agg(F.count("*").alias("n"))
        open_ = F.col("shard").isin([s for s in range(shards) if quota[s] > 0])
        wish = votes.groupBy("key").agg(F.max_by("shard", F.struct(open_, "n", F.xxhash64("key", "shard"))).alias("to"), (F.sum("n") - F.max("n")).alias("away"), F.sum("n").alias("n"))
        asks = joined(placed, written(wish, "wish"), "key").where("to <> shard").select("row", "key", "to", "away")
        asked = {r["to"]: r["n"] for r in asks.groupBy("to").agg(F.count("*").alias("n")).collect()}
        if not asked:
            break
        # a shard with more askers than room takes a fixed share of them, by hash: groups that fit are taken whole
        share = {s: min(1.0, quota[s] / n) for s, n in asked.items()}
        shares = F.create_map(*[F.lit(x) for s in sorted(share) for x in (s, int(share[s] * (1 << 20)))])
        rooms = F.create_map(*[F.lit(x) for s in sorted(share) for x in (s, quota[s])])
        drawn = F.when(F.col("away") <= F.element_at(rooms, F.col("to")), F.xxhash64(F.lit(turn), "key")).otherwise(F.xxhash64(F.lit(turn), "row"))
        taken = asks.where(F.pmod(drawn, F.lit(1 << 20)) < F.element_at(shares, F.col("to"))).select("row", "to")
        after = placed.join(taken, "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
        after = written(after.select(*alone.columns), "linked")
        release(placed)
        placed = after
    return alone.unionByName(placed)


def _numbered(placed: DataFrame, n: int) -> DataFrame:
    """Add a gapless number within each shard, documents with links first.

    Rows are numbered in buckets of bounded size, and the buckets' counts, a small
    table, are summed up.
    """
    buckets = max(1, n // ROWS_PER_BUCKET)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "row"), F.lit(buckets)) + F.when(F.col("linked"), 0).otherwise(buckets))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).select("shard", "bucket", "before")
    inside = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "row")) - 1)
    return inside.join(before, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("at")).drop("bucket", "before", "at")


def _evened(placed: DataFrame, shards: int) -> DataFrame:
    """Move rows beyond a shard's target to shards below theirs: counts then differ by one at most."""
    loads = _loads(placed, shards)
    n = sum(loads)
    target = [n // shards + (s < n % shards) for s in range(shards)]
    numbered = written(_numbered(placed, n), "slots")
    surplus, room, out, into = 0, 0, [], []
    for s in range(shards):
        if loads[s] > target[s]:
            out.append((s, target[s], surplus))
            surplus += loads[s] - target[s]
        elif loads[s] < target[s]:
            into.append((s, room, loads[s]))
            room += target[s] - loads[s]
    if not out:
        return numbered
    slot, shard = F.col("slot"), F.col("shard")
    pool = F.lit(None).cast("long")
    for s, keep, first in out:
        pool = F.when((shard == s) & (slot >= keep), slot - keep + first).otherwise(pool)
    moved = numbered.withColumn("pool", pool)
    to, at = shard, slot
    for s, first, have in into:  # ascending: the last one whose first place is at or before wins
        to = F.when(F.col("pool") >= first, F.lit(s)).otherwise(to)
        at = F.when(F.col("pool") >= first, F.col("pool") - first + have).otherwise(at)
    return moved.withColumns({"shard": to, "slot": at}).drop("pool")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6) -> DataFrame:
    """Place documents: id, size, text_crc32, shard, slot. Linked are documents with equal texts.

    Law ``rows``: counts of shards differ by one at most. A null text has no bytes
    and links to other null or empty texts. Repeated rows and null identifiers are
    placed like others. An empty table gives no rows; fewer rows than shards leave
    shards empty. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    base = written(base, "base")
    base = base.withColumn("key", F.xxhash64("hash", "text_crc32", "size"))
    linked = written(base.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    nodes = joined(base, linked, "key", "left").select("row", "id", "size", "text_crc32", "key", F.col("n").isNotNull().alias("linked"))
    placed = _evened(propagate(nodes, shards, rounds), shards)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards, linked by equal texts."""
    rows = shard(read(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
