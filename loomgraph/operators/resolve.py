"""Resolution of targets that extraction could only name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.schema import EXTERNAL, UNRESOLVED, GraphTables, is_sentinel, last_part, parent_dir
from loomgraph.session import written


def resolve(g: GraphTables) -> DataFrame:
    """(source_id, file, ref, target_id, confidence) for each distinct named target of a known source.

    Rules, the first that finds something counts:

    1. a symbol with that qualified name;
    2. where the caller's file imports the name, or else its last part: symbols of it;
    3. a symbol whose qualified name is the last part;
    4. symbols of the name, or else of its last part.

    Among several symbols one in the caller's directory wins, then the first in order
    of file, line and id, and the match is ambiguous; by qualified name the last in
    that order wins. A match is ambiguous too if several symbols have the last part
    as their name. Unmatched targets have a null target_id. Imports are no candidates.
    """
    sources = g.symbols.select(F.col("id").alias("source_id"), F.col("file_path").alias("file"))
    named = g.relationships.where(is_sentinel(F.col("target_id"))).select("source_id", F.regexp_replace("target_id", f"^({EXTERNAL}|{UNRESOLVED})", "").alias("ref"))
    wanted = named.join(sources, "source_id").distinct().withColumns({"last": last_part(F.col("ref")), "dir": parent_dir(F.col("file"))})

    seq = F.struct("file_path", "start_line", "id")
    known = g.symbols.where("kind <> 'import'")
    by_qname = known.groupBy("qualified_name").agg(F.max(seq)["id"].alias("target"))
    counts = known.groupBy("name").agg(F.count("*").alias("n"))
    imported = g.symbols.where("kind = 'import'").select(F.col("file_path").alias("file"), "name").distinct()
    keys = ["file", "ref", "last", "dir"]
    asked = wanted.select(*keys).distinct()

    exact = asked.join(by_qname, F.col("ref") == F.col("qualified_name")).select("file", "ref", F.lit(1).alias("rule"), "target", F.lit(1).cast("long").alias("n"))
    tail = asked.where("last <> ref").join(by_qname, F.col("last") == F.col("qualified_name")).select("file", "ref", F.lit(3).alias("rule"), "target", F.lit(1).cast("long").alias("n"))

    # rules 2 and 4 look for candidates by a name: the reference, or else its last part
    own, end = imported.withColumn("_own", F.lit(True)), imported.withColumn("_end", F.lit(True))
    via = asked.join(own.withColumnRenamed("name", "ref"), ["file", "ref"], "left").join(end.withColumnRenamed("name", "last"), ["file", "last"], "left")
    via = via.where("_own or _end").select(*keys, F.lit(2).alias("rule"), F.when(F.col("_own"), F.col("ref")).otherwise(F.col("last")).alias("name"))
    some = asked.join(counts.select(F.col("name").alias("ref"), F.lit(True).alias("_own")), "ref", "left")
    free = some.select(*keys, F.lit(4).alias("rule"), F.when(F.col("_own"), F.col("ref")).otherwise(F.col("last")).alias("name"))
    looked = via.unionByName(free)
    # homonyms are cut down before any reference meets them: to one a file, then to the first of all and the first of each directory
    per_file = known.groupBy("name", "file_path").agg(F.min(F.struct("file_path", "start_line", "id")).alias("s"), F.count("*").alias("n"))
    per_name = per_file.groupBy("name").agg(F.min("s").alias("first"), F.sum("n").alias("n"))
    dirs = looked.select("name", "dir").distinct()
    # in order of paths, the first file at or after a directory's name is in it, or else none is
    places = per_file.select("name", F.col("file_path").alias("at"), F.lit(None).cast("string").alias("dir"), "s").unionByName(dirs.select("name", F.col("dir").alias("at"), "dir", F.lit(None).cast(per_file.schema["s"].dataType).alias("s")))
    behind = Window.partitionBy("name").orderBy(F.desc("at"), F.col("dir").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = places.withColumn("near", F.min("s").over(behind)).where("dir is not null").where(F.col("near.file_path").startswith(F.col("dir"))).select("name", "dir", "near")
    picked = looked.join(per_name, "name").join(near, ["name", "dir"], "left").select("file", "ref", "rule", F.coalesce("near", "first")["id"].alias("target"), "n")

    found = exact.unionByName(tail).unionByName(picked)
    best = found.groupBy("file", "ref").agg(F.min(F.struct("rule", "target", "n")).alias("m"))
    named_last = counts.select(F.col("name").alias("last"), F.col("n").alias("same"))
    out = wanted.join(best, ["file", "ref"], "left").join(named_last, "last", "left")
    several = (F.col("m.n") > 1) | (F.coalesce("same", F.lit(0)) > 1)
    return out.select("source_id", "file", "ref", F.col("m.target").alias("target_id"), F.when(F.col("m.target").isNotNull(), F.when(several, "ambiguous").otherwise("inferred")).alias("confidence"))


def touched_refs(old: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """(name) of all that symbols of changed files (path) are or were called, by which a reference can find them.

    Imports are no candidates; they count in their own file, which has changed itself.
    """
    own = paths.select(F.col("path").alias("file_path")).distinct()
    both = old.select("file_path", "name", "qualified_name", "kind").unionByName(new.select("file_path", "name", "qualified_name", "kind"))
    inside = both.where("kind <> 'import'").join(own, "file_path", "left_semi")
    return inside.select(F.explode(F.array("name", "qualified_name")).alias("name")).where("name is not null").distinct()


def resolve_again(found: DataFrame, old: DataFrame, g: GraphTables, paths: DataFrame) -> DataFrame:
    """What ``resolve`` gives for g, from what it gave before (found) with the symbols of then (old).

    ``paths`` (path) are the files that were added, changed or removed since. A reference
    is looked up again if its own file is one of these, or if it or its last part is a name that
    symbols of these files have or had. All others keep what they had. Only symbols
    that these references can meet take part.
    """
    names = written(touched_refs(old, g.symbols, paths), "names")
    changed = paths.select(F.col("path").alias("file")).distinct()
    hit = lambda rows: rows.join(names.withColumnRenamed("name", "ref"), "ref", "left_semi")
    tail = lambda rows: rows.withColumn("_last", last_part(F.col("ref"))).join(names.withColumnRenamed("name", "_last"), "_last", "left_semi").drop("_last")

    kept = found.join(changed, "file", "left_anti")
    stale = written(hit(kept).unionByName(tail(kept)).select("source_id", "ref").distinct(), "stale")
    kept = kept.join(stale, ["source_id", "ref"], "left_anti")
    # references to look up: all of changed files, and those of others that the names touch
    refs = g.relationships.where(is_sentinel(F.col("target_id"))).withColumn("ref", F.regexp_replace("target_id", f"^({EXTERNAL}|{UNRESOLVED})", ""))
    sources = g.symbols.select(F.col("id").alias("source_id"), F.col("file_path").alias("file"))
    of_changed = refs.join(sources.join(changed, "file", "left_semi").select("source_id"), "source_id", "left_semi")
    again = of_changed.select(*g.relationships.columns).unionByName(refs.join(stale, ["source_id", "ref"], "left_semi").select(*g.relationships.columns))
    again = written(again, "again")
    asked = again.select(F.regexp_replace("target_id", f"^({EXTERNAL}|{UNRESOLVED})", "").alias("ref"))
    wanted = written(asked.select(F.explode(F.array("ref", last_part(F.col("ref")))).alias("name")).distinct(), "wanted")
    owners = again.select(F.col("source_id").alias("id")).distinct()
    asking = written(g.symbols.select("id", "file_path").join(owners, "id", "left_semi"), "asking")
    some = g.symbols.join(wanted, "name", "left_semi").unionByName(g.symbols.join(wanted.withColumnRenamed("name", "qualified_name"), "qualified_name", "left_semi"))
    some = some.unionByName(g.symbols.join(asking.select("id"), "id", "left_semi")).unionByName(g.symbols.where("kind = 'import'").join(asking.select("file_path"), "file_path", "left_semi"))
    fresh = resolve(GraphTables(written(some.dropDuplicates(["id"]), "some"), again, g.files))
    return kept.select(*fresh.columns).unionByName(fresh)


def resolved(g: GraphTables, found: DataFrame) -> DataFrame:
    """All edges, with targets that were found in place of their names."""
    names = found.where("target_id is not null").select("source_id", "ref", F.col("target_id").alias("_to"), F.col("confidence").alias("_confidence"))
    edges = g.relationships.withColumn("ref", F.when(is_sentinel(F.col("target_id")), F.regexp_replace("target_id", f"^({EXTERNAL}|{UNRESOLVED})", "")))
    joined = edges.join(names, ["source_id", "ref"], "left")
    return joined.withColumns({"target_id": F.coalesce("_to", "target_id"), "confidence": F.coalesce("_confidence", "confidence")}).select(*g.relationships.columns)


def resolve_stats(g: GraphTables, found: DataFrame) -> DataFrame:
    """How many edges were resolved and how many were not; edges of unknown sources count as not."""
    after = resolved(g, found)
    before = g.relationships.where(is_sentinel(F.col("target_id"))).agg(F.count("*").alias("named"))
    left = after.where(is_sentinel(F.col("target_id"))).agg(F.count("*").alias("unresolved"))
    return before.join(F.broadcast(left)).select((F.col("named") - F.col("unresolved")).alias("resolved"), "unresolved")
