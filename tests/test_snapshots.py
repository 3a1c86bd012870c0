"""Snapshot tables: batches in any order give what all changes at once give."""

import random

from loomgraph.session import new_path
from loomgraph.sources.snapshots import SnapshotTable

SCHEMA = "k string, op string, at int, v string"


def brute(rows):
    last = {}
    for k, op, at, v in rows:
        last.setdefault(k, []).append((at, op == "delete", v))
    return {k: max(x) for k, x in last.items()}


def test_any_cut_and_order_gives_the_same(spark):
    rng = random.Random(2)
    rows = [(rng.choice([*"abcdefgh", None]), rng.choice(["put", "put", "delete"]), i, f"v{i}") for i in range(60)]
    want = {(k, v) for k, (_, gone, v) in brute(rows).items() if not gone}
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        t = SnapshotTable(spark, new_path(spark, "t"), "k", ("at",), buckets=4)
        for i in range(0, 60, 20):
            t.apply(spark.createDataFrame(rows[i : i + 20], SCHEMA))
        got = t.read().collect()
        assert {(r.k, r.v) for r in got} == want and len(got) == len(want)


def test_only_touched_buckets_are_written_and_old_versions_go(spark):
    t = SnapshotTable(spark, new_path(spark, "t"), "k", ("at",), buckets=16)
    all_ = t.apply(spark.createDataFrame([(f"k{i}", "put", 0, "x" * 50) for i in range(2000)], SCHEMA))
    assert len(all_) == 16
    one = t.apply(spark.createDataFrame([("k7", "put", 1, "y")], SCHEMA))
    assert len(one) == 1 and t.bytes_written(1) * 8 < t.bytes_written(0)
    assert t.apply(spark.createDataFrame([("k7", "put", 9, "never")], SCHEMA), 1) == one  # run again: as before
    assert {r.v for r in t.read().where("k = 'k7'").collect()} == {"y"} and {r.v[0] for r in t.read(0).where("k = 'k7'").collect()} == {"x"}
    two = t.apply(spark.createDataFrame([("k7", "delete", 2, None)], SCHEMA))
    t.expire(keep=1)
    assert t.versions() == [2] and t.read().count() == 1999
    assert t.store.names("data/v000000000001") == [] and f"_part={one[0]}" not in t.store.names("data/v000000000000")
    assert two == one
    t.apply(spark.createDataFrame([("k7", "put", 1, "late")], SCHEMA))
    assert t.read().where("k = 'k7'").count() == 0  # the deletion is newer
    assert t.forget("_at.at < 3") == one
    t.apply(spark.createDataFrame([("k7", "put", 1, "late")], SCHEMA))
    assert t.read().where("k = 'k7'").count() == 1 and t.read().count() == 2000


def test_ties_new_columns_and_empty_batches(spark):
    t = SnapshotTable(spark, new_path(spark, "t"), "k", ("at",))
    assert t.read() is None and t.apply(spark.createDataFrame([], SCHEMA)) == [] and t.read().count() == 0
    tied = [("a", "put", 1, "p"), ("a", "put", 1, "q"), ("b", "delete", 1, None), ("b", "put", 1, "z")]
    got = set()
    for rows in (tied, tied[::-1]):
        u = SnapshotTable(spark, new_path(spark, "t"), "k", ("at",))
        for row in rows:
            u.apply(spark.createDataFrame([row], SCHEMA))
        got.add(frozenset((r.k, r.v) for r in u.read().collect()))
    assert len(got) == 1 and {k for k, _ in next(iter(got))} == {"a"}
    t.apply(spark.createDataFrame([("a", "put", 1, "p")], SCHEMA))
    t.apply(spark.createDataFrame([("b", "put", 1, "p", 7)], SCHEMA + ", more int"))
    assert {(r.k, r.more) for r in t.read().collect()} == {("a", None), ("b", 7)}
