"""Streams over files, run to their end."""

from loomgraph.session import new_path
from loomgraph.streaming import feeds
from pyspark.sql import functions as F


def stream(spark, rows, schema, files=2):
    path = new_path(spark, "events")
    df = spark.createDataFrame(rows, schema)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(second):
    return f"2024-01-01 00:00:{second:02d}"


def timed(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_debounce_and_dedupe(spark):
    rows = [("p", "modify", at(1), "d1"), ("p", "delete", at(2), "d2"), ("p", "modify", at(40), "d2"), ("q", "create", at(3), "d3"), ("z", "end", "2024-01-01 01:00:00", "d9")]
    s = timed(stream(spark, rows, "path string, op string, ts string, delivery_id string", 1))
    out = spark.read.parquet(feeds.run_to_table(feeds.debounced(s, "path", "5 seconds", "1 second")))
    assert {(r.path, r.last_op, r.n) for r in out.collect()} == {("p", "delete", 2), ("p", "modify", 1), ("q", "create", 1)}
    s = timed(stream(spark, rows, "path string, op string, ts string, delivery_id string"))
    assert spark.read.parquet(feeds.run_to_table(feeds.deduplicated(s))).count() == 4


def test_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    s = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = spark.read.parquet(feeds.run_to_table(feeds.windowed(s, "1 day")))
    whole = events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert out.join(whole, ["start", "event_type", "n"]).count() == out.count() > 100


def test_upserts(spark):
    rows = [("a", "put", 1, at(1)), ("a", "put", 2, at(2)), ("b", "put", 5, at(1)), ("b", "delete", None, at(3)), ("c", "put", 7, at(1))]
    s = stream(spark, rows, "k string, op string, v int, ts string", 1)
    table = new_path(spark, "table")
    feeds.into_table(s, table, "k", new_path(spark, "state")).awaitTermination()
    assert {(r.k, r.v) for r in feeds.current(spark, table, "k").collect()} == {("a", 2), ("c", 7)}


def test_buckets_and_lifecycle(spark):
    rows = [(i, "k", at(i)) for i in range(6)]
    s = timed(stream(spark, rows, "id int, user string, ts string", 1))
    got = spark.read.parquet(feeds.run_to_table(feeds.token_bucket(s, "user", 2, 0.5))).orderBy("id").collect()
    assert [r.allowed for r in got] == [True, True, True, False, True, False]
    rows = [("r", x, at(i)) for i, x in enumerate(["pending", "cloning", "ready", "indexing", "ready"])]
    s = timed(stream(spark, rows, "repo string, status string, ts string", 1))
    got = spark.read.parquet(feeds.run_to_table(feeds.lifecycle(s, "repo")))
    assert {(r.after, r.allowed) for r in got.collect()} == {("pending", True), ("cloning", True), ("ready", False), ("indexing", True), ("ready", True)}
