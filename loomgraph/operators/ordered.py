"""Operations that need an order within keys, without one task for a key: as-of joins, freshness, exact quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.session import written

#: Parts into which a range of values is cut in each pass over the rows.
BINS = 4096


def asof(left: DataFrame, right: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Rows of left with ``found``: the last row of right (at, tie and its other columns) of the same key that is not later.

    Both have key, at and tie; of rows of right at one time the one with the largest
    tie counts, and a row at the same time as that of left is not later. Null if there
    is none. Both feeds are sorted together in ranges, values are carried on within a
    range, and what a range begins with is taken from the ranges before it, of which each has
    one row a key. So a key of any size is spread over many tasks. Rows without a time have null found.
    """
    whole = F.struct(at, tie, *[c for c in right.columns if c not in (key, at, tie)])
    kind = right.select(whole.alias("x")).schema["x"].dataType
    rows = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_value"))
    values = right.where(F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), whole.alias("_value"))
    order = ("_key", "_at", "_side", "_tie")
    both = rows.unionByName(values).repartitionByRange(*order).sortWithinPartitions(*order)
    both = written(both.withColumn("_place", F.monotonically_increasing_id()), "feeds").withColumn("_range", F.shiftright("_place", 33))
    inside = Window.partitionBy("_key", "_range").orderBy("_place")
    carried = both.withColumn("_last", F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_side = 1")
    ends = both.groupBy("_key", "_range").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_place"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_before", before).select(F.col("_key").alias("_k"), F.col("_range").alias("_r"), "_before")
    joined = carried.join(ends, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")), "left")
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_last", "_before"))
    return joined.select("_row.*", found.alias("found"))


def freshness(commits: DataFrame, runs: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """(key, head, last_indexed, behind, stale): the last commit of each key, that which its last run has seen, and the commits since.

    Commits and runs have key, at and tie, which names a commit. Without a run, or with
    one before the first commit, last_indexed is null, and so are behind and stale.
    """
    last = runs.groupBy(key).agg(F.max_by(tie, F.struct(at, tie)).alias(tie), F.max(at).alias(at))
    seen = asof(last, commits, key, at, tie).select(F.col(key).alias("_k"), F.col(f"found.{at}").alias("_at"), F.col(f"found.{tie}").alias("last_indexed"))
    rows = commits.join(seen, F.col(key).eqNullSafe(F.col("_k")), "left")
    later = F.struct(F.col(at).alias("a"), F.col(tie).alias("t")) > F.struct(F.col("_at").alias("a"), F.col("last_indexed").alias("t"))
    out = rows.groupBy(key).agg(F.max_by(tie, F.struct(at, tie)).alias("head"), F.max("last_indexed").alias("last_indexed"), F.count_if(later).alias("_behind"))
    known = F.col("last_indexed").isNotNull()
    return out.select(key, "head", "last_indexed", F.when(known, F.col("_behind")).alias("behind"), F.when(known, F.col("head") != F.col("last_indexed")).alias("stale"))


def quantiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, share, value): exact quantiles of each group, interpolated between the two values next to the place share * (n - 1).

    Values are selected by rank: each pass counts the rows of a range in parts and goes
    on with the part that holds the rank, until that is one value. No group is
    sorted or gathered. Null and not-a-number values are left out; groups without others give no rows.
    """
    v = F.col(value).cast("double")
    rows = written(rows.select(F.col(by).alias("key"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v)), "values")
    ends = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = lambda share: F.lit(float(share)) * (F.col("n") - 1)
    asked = reduce(DataFrame.unionByName, [ends.select("key", F.lit(float(s)).alias("share"), place(s).alias("place"), "low", "high") for s in shares])
    ranks = F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))
    todo = written(asked.select("key", ranks.alias("rank"), "low", "high", F.lit(0).cast("long").alias("below")).distinct(), "ranks")
    done = []
    while True:
        done.append(todo.where("low = high").select("key", "rank", F.col("low").alias("v")))
        wide = todo.where("low < high")
        if not wide.head(1):
            break
        met = rows.join(wide, rows["key"].eqNullSafe(wide["key"]) & rows["v"].between(F.col("low"), F.col("high"))).drop(rows["key"])
        # halves do not overflow; the ends of a range are parts of their own, so that each pass leaves less
        part = F.floor(F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2) * (BINS - 1)) + 1
        part = F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), BINS + 1).otherwise(F.coalesce(part, F.lit(1)))
        parts = met.groupBy("key", "rank", "below", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("c").over(Window.partitionBy("key", "rank").orderBy("part")) - F.col("c")  # a row a part
        held = parts.withColumn("first", F.col("below") + before).where((F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("first") + F.col("c")))
        todo = written(held.select("key", "rank", "low", "high", F.col("first").alias("below")), "ranks")
    found = reduce(DataFrame.unionByName, done)
    lower, upper = (found.select(F.col("key").alias(f"k{i}"), F.col("rank").alias(f"r{i}"), F.col("v").alias(f"v{i}")) for i in (0, 1))
    out = asked.join(lower, F.col("key").eqNullSafe(F.col("k0")) & (F.floor("place") == F.col("r0"))).join(upper, F.col("key").eqNullSafe(F.col("k1")) & (F.ceil("place") == F.col("r1")))
    return out.select(F.col("key").alias(by), "share", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("place") - F.floor("place"))).alias("value"))
