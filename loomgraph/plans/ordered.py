"""Registered queries of orders within keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import ordered
from loomgraph.plans.catalogue import query
from loomgraph.sources.warehouse import table

_SHARES = (0.5, 0.95)


@query(
    "latency_quantiles",
    " UNION ALL ".join(
        f"SELECT '{name}' AS feed, {key} AS key, {s}::DOUBLE AS share, round(quantile_cont({value}, {s}), 6) AS value FROM {name} GROUP BY {key}"
        for name, key, value in (("lineitem", "l_returnflag", "l_extendedprice"), ("events", "event_type", "value"))
        for s in _SHARES
    ),
    graph=False,
)
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and 95th percentiles of prices by flag and of values by type of event."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("lineitem "), "l_returnflag").alias("key"), F.col("l_extendedprice").alias("v"))
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("events "), "event_type").alias("key"), F.col("value").alias("v"))
    found = ordered.quantiles(lines.unionByName(events), "key", "v", _SHARES)
    return found.select(F.split_part("key", F.lit(" "), F.lit(1)).alias("feed"), F.split_part("key", F.lit(" "), F.lit(2)).alias("key"), "share", F.round("value", 6).alias("value"))


@query(
    "asof_join",
    """SELECT l.event_id, arg_max(r.event_id, (r.ts, r.event_id)) AS commit_id, arg_max(r.value, (r.ts, r.event_id)) AS value
FROM events l LEFT JOIN events r ON r.user_id = l.user_id AND r.event_type IN ('click', 'view') AND r.ts <= l.ts WHERE l.event_type = 'purchase' GROUP BY l.event_id""",
    graph=False,
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase of a user what they saw last before."""
    e = table(spark, sf_dir, "events")
    found = ordered.asof(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type in ('click', 'view')").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id")
    return found.select("event_id", F.col("found.event_id").alias("commit_id"), F.col("found.value").alias("value"))


@query(
    "freshness",
    """WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY 1),
seen AS (SELECT user_id, max((c.ts, c.event_id)) AS x FROM c JOIN r USING (user_id) WHERE c.ts <= r.ts GROUP BY 1)
SELECT user_id, arg_max(event_id, (ts, event_id)) AS head, max(x[2]) AS last_indexed, CASE WHEN max(x[2]) IS NOT NULL THEN count(*) FILTER ((ts, event_id) > x) END AS behind,
  CASE WHEN max(x[2]) IS NOT NULL THEN arg_max(event_id, (ts, event_id)) <> max(x[2]) END AS stale FROM c LEFT JOIN seen USING (user_id) GROUP BY 1""",
    graph=False,
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks are a user's commits, purchases are runs of the indexer."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ordered.freshness(e.where("event_type in ('click', 'view')"), e.where("event_type = 'purchase'"), "user_id", "ts", "event_id")
