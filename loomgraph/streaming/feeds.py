"""The feeds as Structured Streaming: debouncing, deduplication, windows, upserts, buckets and lifecycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.session import new_path
from loomgraph.sources.snapshots import SnapshotTable


def debounced(events: DataFrame, key: str, gap: str = "500 milliseconds", late: str = "1 minute", at: str = "ts", op: str = "op") -> DataFrame:
    """Per key, what was done last in each burst of events that follow each other within a gap."""
    bursts = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("burst"), key)
    return bursts.agg(F.max_by(op, at).alias("last_op"), F.count("*").alias("n")).select(key, F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "last_op", "n")


def deduplicated(deliveries: DataFrame, key: str = "delivery_id", late: str = "1 hour", at: str = "ts") -> DataFrame:
    return deliveries.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", at: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums of values in windows of time."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return events.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), by, "n", "value")


def into_table(changes: DataFrame, table: str, key: str, checkpoint: str, order: str | tuple[str, ...] = "ts", buckets: int = 64, keep: int = 2):  # noqa: ANN201
    """Apply changes (key, op, order, columns) to a ``SnapshotTable``, batch by batch; ``delete`` removes a key.

    A batch rewrites the buckets of its keys only. A batch that is run again gives the
    same version; versions before the last ones are deleted.
    """
    order = (order,) if isinstance(order, str) else order

    def apply(batch: DataFrame, number: int) -> None:
        snapshots = SnapshotTable(batch.sparkSession, table, key, order, buckets)
        snapshots.apply(batch, number)
        snapshots.expire(keep)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, table: str, key: str, order: str | tuple[str, ...] = "ts") -> DataFrame | None:  # noqa: ANN001
    """The newest version of a table, or None."""
    return SnapshotTable(spark, table, key, (order,) if isinstance(order, str) else order).read()


def token_bucket(requests: DataFrame, key: str, capacity: float, per_second: float, cost: float = 1.0, at: str = "ts", tie: str = "id") -> DataFrame:
    """Per request whether its key's bucket allowed it; buckets are kept as state."""
    kinds = dict(requests.dtypes)

    def fold(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(frames)).sort_values([at, tie])
        allowed = []
        for t in rows[at]:
            now = t.timestamp()
            left = min(capacity, left + max(0.0, now - (last if last is not None else now)) * per_second)
            last = now
            ok = left >= cost
            left -= cost * ok
            allowed.append(bool(ok))
        state.update((left, last))
        yield pd.DataFrame({tie: rows[tie], key: names[0], "allowed": allowed})

    return requests.groupBy(key).applyInPandasWithState(fold, f"{tie} {kinds[tie]}, {key} {kinds[key]}, allowed boolean", "left double, last double", "append", GroupStateTimeout.NoTimeout)


#: Which states may follow which in the lifecycle of a sync.
LIFECYCLE = {"never": ("pending",), "pending": ("cloning", "failed"), "cloning": ("indexing", "failed"), "indexing": ("ready", "failed"), "ready": ("pending",), "failed": ("pending",)}


def lifecycle(events: DataFrame, key: str, at: str = "ts", status: str = "status") -> DataFrame:
    """Per key the transitions that the lifecycle allows; others are reported as refused."""
    kinds = dict(events.dtypes)

    def fold(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "never"
        out = []
        for s in pd.concat(list(frames)).sort_values(at)[status]:
            ok = s in LIFECYCLE.get(now, ())
            out.append((names[0], now, s, ok))
            now = s if ok else now
        state.update((now,))
        yield pd.DataFrame(out, columns=[key, "before", "after", "allowed"])

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {kinds[key]}, before string, after string, allowed boolean", "status string", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Run a stream over what is available and return the folder it was written to."""
    spark = stream.sparkSession
    out, at = new_path(spark, "stream"), new_path(spark, "stream-state")
    frame = prepare(stream) if prepare else stream
    frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return out
