import hashlib
from collections import defaultdict

from loomgraph.llm import bloom
from loomgraph.llm.exact_dedup import DigestIndex, deduplicate, resolve
from pyspark.sql import functions as F

ROWS = [(1, "Abc", "a"), (2, "aBC", "b"), (3, "ÉA", "c"), (4, "éA", "d"), (5, None, "e"), (6, "", "f"), (7, "x" * 200_000, "g"), (8, "X" * 200_000, "h"), (9, "solo", "i"), (9, "solo", "i"), (9, "other", "j"), (None, "abc", "k"), (None, "null id", "l"), (11, "abc", "m")]
SCHEMA = "doc_id long, text string, keep string"


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        seen = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == best and not seen
            seen |= kept
            out.append((i, best, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.withColumn("digest", F.lower(F.hex("digest"))).collect()), key=repr)


def test_groups_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert got(resolve(docs, keep="largest")) == brute(ROWS, max)
    assert got(resolve(docs)) == brute(ROWS, min)


def test_equal_digests_are_told_apart_by_their_bytes(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    weak = lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0)  # noqa: E731  all texts share it
    rows = [(i, k, n, kept) for i, k, n, kept, _ in brute(ROWS, max)]
    found = [tuple(r)[:4] for r in resolve(docs, keep="largest", digest=weak).collect()]
    assert sorted(found, key=repr) == sorted(rows, key=repr)


def test_empty_and_documents_that_stay(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert resolve(docs.limit(0)).count() == 0
    assert deduplicate(docs.limit(0)).count() == 0
    docs = docs.withColumns({"_gone_id": F.lit(1), "digest": F.lit(2), "id": F.lit(3), "_digest": F.lit(4), "row": F.lit(5)})
    stay = deduplicate(docs, keep="largest")
    assert stay.columns == docs.columns
    kept = sorted([r[0] for r in brute(ROWS, max) if r[3]], key=repr)
    assert sorted([r.doc_id for r in stay.collect()], key=repr) == kept


def test_several_memtables(spark):
    docs = spark.createDataFrame(ROWS[:5], SCHEMA)
    later = [spark.createDataFrame(x, SCHEMA) for x in (ROWS[5:10], [], ROWS[10:])]
    assert got(resolve(docs, keep="largest", later=later)) == brute(ROWS, max)
    weak = lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0)  # noqa: E731  all texts share it
    found = [tuple(r)[:4] for r in resolve(docs, keep="largest", digest=weak, later=later).collect()]
    assert sorted(found, key=repr) == sorted([(i, k, n, kept) for i, k, n, kept, _ in brute(ROWS, max)], key=repr)


def test_an_index_of_two_flushes(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    index = DigestIndex()
    for part in (docs.where("_id < 5"), docs.where("_id >= 5"), docs.where("_id is null")):
        index.flush(part)
        index.compact()
    assert index.rows().count() == len(ROWS)
    assert index.level.agg(F.sum("size")).first()[0] == len(ROWS)
    alone = dict(index.level.where("size > 1").select(F.hex("digest"), "size").collect())
    assert set(alone.values()) == {2}


def test_only_hits_pass_the_filter(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2999).alias("text"))
    table, blocks = bloom.build(docs.where("doc_id in (0, 2999)"), "text")
    rows = bloom.flagged(docs, F.col("text"), table, blocks, "maybe")
    assert rows.count() == 3000 and {r.doc_id for r in rows.where("maybe").collect()} >= {0, 2999}
    assert rows.where("maybe").count() < 100
    assert resolve(docs).where("group_size > 1").count() == 2
