import zlib
from collections import Counter, defaultdict

from loomgraph.llm.sharding import edges_cut, joined, op9_sharding, shard
from loomgraph.session import written
from pyspark.sql import functions as F


def test_counts_slots_and_groups(spark):
    texts = [f"copy {i // 7}" if i < 140 else f"single {i}" for i in range(397)] + [None, "", "", "é" * 50_000] + ["hot"] * 100
    rows = [(i if i % 50 else None, t, 1) for i, t in enumerate(texts)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 16).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    where = defaultdict(set)
    ids = {i: t for i, t, _ in rows if i is not None and t and t.startswith("copy")}
    for r in got:
        if r.doc_id in ids:
            where[ids[r.doc_id]].add(r.shard)
    assert sum(len(v) - 1 for v in where.values()) <= 24  # of 120 links cut at most


def test_empty_and_few(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    assert shard(docs.limit(0), 16).count() == 0
    assert sorted(r.slot for r in shard(docs, 16).collect()) == [0, 0]


def test_large_groups_meet_their_wish_like_others(spark):
    rows = spark.createDataFrame([(i, 7 if i < 60 else i % 40 + 100) for i in range(300)], "row long, key long")
    table = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 6").withColumn("to", F.col("key") + 1), "table")
    want = sorted((r.row, r.key, r.n, r.to) for r in rows.join(table, "key").collect())
    assert sorted((r.row, r.key, r.n, r.to) for r in joined(rows, table, "key").collect()) == want
    left = joined(rows, table, "key", "left")
    assert left.count() == 300 and left.where("n is not null").count() == len(want)


def test_edges_cut(spark):
    placed = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 5), (2, 5), (3, 4)], "key long, shard int")
    assert tuple(edges_cut(placed).first()) == (4, 2)
    assert tuple(edges_cut(placed.limit(0)).first()) == (0, 0)


def test_query_places_every_document(spark, sf):
    got = op9_sharding(spark, sf).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and {r.law for r in got} == {"rows"}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
