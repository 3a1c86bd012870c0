"""Reachability from many sets of seeds at once, as for many change sets.

A node's row holds a bit for each set that has reached it, up to 63 sets in one number. So
a level of the search is one join of the frontier with the edges for all sets, and
sets that meet the same nodes share its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.operators.changes import changed_lines_of
from loomgraph.schema import GraphTables
from loomgraph.session import release, written

BITS = 63


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def numbered_sets(seeds: DataFrame) -> DataFrame:
    """(set, block, place): a block and a bit of it for each set. Sets are dealt into blocks by hash; no task gets them all."""
    sets = written(seeds.select("set").distinct(), "sets")
    buckets = max(1, sets.count() // (BITS // 2))
    bucket = F.pmod(F.xxhash64("set"), F.lit(buckets))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("set")) - 1
    return sets.withColumn("bucket", bucket).withColumn("at", at).select("set", F.struct("bucket", F.floor(F.col("at") / BITS).alias("part")).alias("block"), (F.col("at") % BITS).alias("place"))


def reached_by(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """Levels (id, block, mask, depth) of what sets reach from their seeds (set, id), and the sets' places in the masks.

    A bit is set at the smallest depth at which the set reaches the node: 0 for its
    seeds. Each edge is followed once for a block of sets and level, if that brings it any.
    """
    near, far = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    pairs = written(edges.select(F.col(near).alias("near"), F.col(far).alias("id")).where("near <> id").distinct(), "pairs")
    sets = written(numbered_sets(seeds), "numbered")
    first = seeds.select("set", "id").distinct().join(sets, "set").groupBy("id", "block").agg(F.bit_or(_bit(F.col("place"))).alias("mask"))
    level = written(first.withColumn("depth", F.lit(0)), "level")
    levels, seen = [level], level.select("id", "block", "mask")
    for depth in range(1, max_depth + 1):
        step = pairs.join(level.select(F.col("id").alias("near"), "block", "mask"), "near").groupBy("id", "block").agg(F.bit_or("mask").alias("mask"))
        had = seen.select("id", "block", F.col("mask").alias("had"))
        fresh = step.join(had, ["id", "block"], "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))).where("mask <> 0")
        level = written(fresh.select("id", "block", "mask", F.lit(depth).alias("depth")), "level")
        if not level.head(1):
            break
        levels.append(level)
        if depth < max_depth:
            after = seen.unionByName(level.select("id", "block", "mask")).groupBy("id", "block").agg(F.bit_or("mask").alias("mask"))
            after = written(after, "seen")
            if depth > 1:
                release(seen)
            seen = after
    return reduce(DataFrame.unionByName, levels), sets


def told_apart(levels: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, id, depth): a row for each bit."""
    places = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda p: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p)) != 0)
    bits = levels.select("id", "block", "depth", F.explode(places).alias("place"))
    return bits.join(sets, ["block", "place"]).select("set", "id", "depth")


def affected(g: GraphTables, changes: DataFrame, max_depth: int = 3) -> DataFrame:
    """(set, id, depth) of the symbols that depend on what change sets (set, file, line) change; depth 0 is what they change.

    A null line means that all symbols of the file may have changed. Lines count from 1.
    Dependents that are no known symbols lead on, but are not listed.
    """
    seeds = written(changed_lines_of(g, changes), "seeds")
    levels, sets = reached_by(g.relationships, seeds, max_depth, reverse=True)
    return told_apart(levels, sets).join(g.symbols.select("id"), "id").select("set", "id", "depth")


def affected_counts(g: GraphTables, changes: DataFrame, max_depth: int = 3) -> DataFrame:
    """(set, depth, n, n_files): affected symbols by depth, and the files they are in other than changed ones."""
    files = changes.select("set", F.col("file").alias("file_path"), F.lit(True).alias("own")).distinct()
    rows = affected(g, changes, max_depth).join(g.symbols.select("id", "file_path"), "id").join(files, ["set", "file_path"], "left")
    return rows.groupBy("set", "depth").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("own").isNull(), F.col("file_path"))).alias("n_files"))


def blast_radius(g: GraphTables, changes: DataFrame, listed: int = 10) -> DataFrame:
    """One row for each change set (set, file): files, symbols in them, direct dependents outside them, their files, and the first dependents by name.

    ``listed`` has at most so many names with their files, and more says how many are left.
    """
    files = changes.select("set", F.col("file").alias("file_path")).distinct()
    changed = files.join(g.symbols.select("id", "file_path"), "file_path").select("set", F.col("id").alias("target_id"))
    other = g.symbols.select(F.col("id").alias("source_id"), "qualified_name", "file_path")
    near = changed.join(g.relationships.select("source_id", "target_id"), "target_id").select("set", "source_id").distinct().join(other, "source_id")
    near = written(near.join(files, ["set", "file_path"], "left_anti").select("set", "source_id", "qualified_name", "file_path"), "dependents")
    place = F.row_number().over(Window.partitionBy("set").orderBy("qualified_name", "file_path", "source_id"))
    first = near.withColumn("place", place).where(F.col("place") <= listed)
    first = first.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("place", "qualified_name", "file_path"))).alias("first"))
    lines = F.transform("first", lambda x: F.concat(x["qualified_name"], F.lit(" - "), x["file_path"]))
    sizes = near.groupBy("set").agg(F.count("*").alias("n_affected"), F.count_distinct("file_path").alias("n_affected_files"))
    out = files.groupBy("set").agg(F.count("*").alias("n_files")).join(changed.groupBy("set").agg(F.count("*").alias("n_symbols")), "set", "left").join(sizes, "set", "left").join(first.select("set", lines.alias("listed")), "set", "left")
    out = out.na.fill(0, ["n_symbols", "n_affected", "n_affected_files"])
    return out.select("set", "n_files", "n_symbols", "n_affected", "n_affected_files", F.coalesce("listed", F.array().cast("array<string>")).alias("listed"), (F.col("n_affected") - F.size(F.coalesce("listed", F.array().cast("array<string>")))).alias("more"))


def comments(radius: DataFrame) -> DataFrame:
    """(set, text): the rows of ``blast_radius`` as Markdown."""
    number = lambda c: F.concat(F.lit("**"), F.col(c).cast("string"), F.lit("**"))
    head = F.concat(F.lit("Changes "), number("n_files"), F.lit(" files with "), number("n_symbols"), F.lit(" symbols."))
    size = F.concat(F.lit("Depending on these: "), number("n_affected"), F.lit(" symbols in "), number("n_affected_files"), F.lit(" other files."))
    items = F.concat(F.transform("listed", lambda x: F.concat(F.lit("- "), x)), F.when(F.col("more") > 0, F.array(F.concat(F.lit("- and "), F.col("more").cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>")))
    some = F.concat_ws("\n", head, size, F.lit(""), F.array_join(items, "\n"))
    return radius.select("set", F.when(F.col("n_affected") > 0, some).otherwise(F.concat_ws("\n", head, F.lit("Nothing outside depends on them."))).alias("text"))
