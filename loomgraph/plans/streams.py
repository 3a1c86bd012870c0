"""Registered queries that run streams over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.catalogue import query
from loomgraph.session import new_path
from loomgraph.sources.warehouse import table
from loomgraph.streaming import feeds

BATCHES = 3


def stream_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows as a stream of a few batches, cut by a hash of the rows, so that later batches hold earlier events too."""
    path = new_path(spark, "batches")
    cut = F.pmod(F.xxhash64(*rows.columns), F.lit(BATCHES))
    rows.repartition(BATCHES, cut).write.option("maxRecordsPerFile", 1_000_000).parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "upsert_stream",
    """SELECT user_id, event_id, epoch_us(ts) AS ts_us, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'""",
    graph=False,
)
def upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, upserted by a stream into a table of buckets; an error deletes the user's row."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_type", "value")
    changes = stream_of(spark, events.withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("put")))
    where = new_path(spark, "users")
    feeds.into_table(changes, where, "user_id", new_path(spark, "progress"), ("ts_us", "event_id")).awaitTermination()
    return feeds.current(spark, where, "user_id", ("ts_us", "event_id")).select("user_id", "event_id", "ts_us", "event_type", "value")
