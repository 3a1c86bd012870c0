"""Feeds of events in batch form: debouncing, deduplication, limits, lifecycle and activation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def micros(at: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at) if isinstance(at, str) else at)


def dedupe(events: DataFrame, key: list[str], at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The first event of each key."""
    first = F.min(F.struct(at, tie, *[c for c in events.columns if c not in (at, tie, *key)])).alias("f")
    return events.groupBy(*key).agg(first).select(*key, "f.*")


def debounce(events: DataFrame, key: str, gap_seconds: int, at: str = "ts", tie: str = "event_id", op: str = "event_type") -> DataFrame:
    """Sessions of events that follow each other within a gap: start, end, count and the last operation."""
    w = Window.partitionBy(key).orderBy(at, tie)
    apart = F.lag(at).over(w).isNull() | ((micros(at) - micros(F.lag(at).over(w))) > gap_seconds * 1_000_000)
    marked = events.withColumn("session", F.sum(apart.cast("int")).over(w))
    return marked.groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"), F.max_by(op, F.struct(at, tie)).alias("last_op")).drop("session")


def latest_state(events: DataFrame, key: str, state: str, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last state of each key: its place in a lifecycle."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, tie)).alias("state"), F.max(at).alias("since"))


def activation(events: DataFrame, key: str = "user_id", kind: str = "event_type", success: str = "purchase", error: str = "error") -> DataFrame:
    """One row: keys, keys with a success, successes, failures and the rate of activation."""
    ok = F.col(kind) == success
    row = events.agg(F.count_distinct(key).alias("repos"), F.count_distinct(F.when(ok, F.col(key))).alias("activated"), F.count_if(ok).alias("successes"), F.count_if(F.col(kind) == error).alias("failures"))
    return row.withColumn("activation_rate", F.round(F.when(F.col("repos") > 0, F.col("activated") / F.col("repos")).otherwise(0.0), 4))


def changes_only(rows: DataFrame, key: str, value: str, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Rows at which a key's value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(at, tie))
    return rows.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def token_bucket(events: DataFrame, key: str, capacity: float, per_second: float, cost: float = 1.0, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """(tie, key, allowed, left): each key's bucket is filled over time and emptied by its events in order.

    Rows are sorted within a key and folded as they come, so a key of any size needs
    one number of memory.
    """
    rows = events.select(F.col(tie).alias("tie"), F.col(key).alias("key"), (micros(at) / 1e6).alias("at")).repartition("key").sortWithinPartitions("key", "at", "tie")

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, left, last = object(), 0.0, 0.0
        for batch in batches:
            allowed, lefts = [], []
            for k, t in zip(batch["key"], batch["at"], strict=True):
                if k != owner:
                    owner, left, last = k, capacity, t
                left, last = min(capacity, left + (t - last) * per_second), t
                ok = left >= cost
                left -= cost * ok
                allowed.append(bool(ok))
                lefts.append(left)
            yield pd.DataFrame({"tie": batch["tie"], "key": batch["key"], "allowed": allowed, "left": lefts})

    kinds = dict(rows.dtypes)
    out = rows.mapInPandas(fold, f"tie {kinds['tie']}, key {kinds['key']}, allowed boolean, left double")
    return out.select(F.col("tie").alias(tie), F.col("key").alias(key), "allowed", "left")
