"""What a change touches: symbol diffs, hunks of a diff, review risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import GraphTables


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, qualified_name, change) of two snapshots of symbols: added, removed or modified (signature or lines).

    Of several symbols with one qualified name in a file the last by line and id counts.
    """
    key = ["file_path", "qualified_name"]

    def last(s: DataFrame, name: str) -> DataFrame:
        return s.groupBy(*key).agg(F.max(F.struct("start_line", "id", "end_line", "signature")).alias(name))

    both = last(old, "o").join(last(new, "n"), key, "full_outer")
    same = F.col("o.signature").eqNullSafe(F.col("n.signature")) & (F.col("o.start_line") == F.col("n.start_line")) & F.col("o.end_line").eqNullSafe(F.col("n.end_line"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~same, "modified")
    return both.select(*key, change.alias("change")).where("change is not null")


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(file, line) of the new lines of unified diffs (file, text): one row for each line of a hunk; a count of 0 has none."""
    heads = diffs.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"), F.lit(1))).alias("h"))
    start = F.split("h", ",")[0].cast("int")
    count = F.coalesce(F.try_element_at(F.split("h", ","), F.lit(2)).cast("int"), F.lit(1))
    spans = heads.select("file", start.alias("start"), count.alias("count")).where("count > 0")
    return spans.select("file", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("line")).distinct()


def changed_lines_of(g: GraphTables, changes: DataFrame) -> DataFrame:
    """(set, id) of the symbols that change sets (set, file, line) touch; lines count from 1, and a null line is the whole file."""
    spans = g.symbols.select("id", F.col("file_path").alias("file"), "start_line", "end_line")
    hit = changes.select("set", "file", "line").distinct().join(spans, "file")
    return hit.where(F.col("line").isNull() | F.col("line").between(F.col("start_line") + 1, F.col("end_line") + 1)).select("set", "id").distinct()


def risk_score(changed: Column, impacted: Column, high: Column, untested: Column) -> Column:
    """0 to 10, to one decimal."""
    score = F.least(F.lit(4.0), changed * 0.3) + F.least(F.lit(3.0), impacted * 0.2) + F.least(F.lit(2.0), high * 1.0) + F.when(untested, 1.0).otherwise(0.0)
    return F.round(F.least(F.lit(10.0), score), 1)


def risk_band(score: Column) -> Column:
    return F.when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def review(g: GraphTables, changes: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row for each change set of ``changes`` (pr, file): counts of changed symbols, dependents, tests, untested symbols, and risk.

    Dependents are those one edge away, outside the changed files and tests.
    ``findings`` (pr, severity) of a security scan count if high.
    """
    files = changes.select("pr", F.col("file").alias("file_path")).distinct()
    changed = g.symbols.where("kind <> 'import'").join(files, "file_path").select("pr", F.col("id").alias("target_id"), "name", "is_test")
    other = g.symbols.select(F.col("id").alias("source_id"), F.col("file_path").alias("dep_file"), F.col("is_test").alias("dep_test"))
    near = changed.select("pr", "target_id").join(g.relationships.select("source_id", "target_id"), "target_id").join(other, "source_id").distinct()
    inside = files.select("pr", F.col("file_path").alias("dep_file"), F.lit(True).alias("inside"))
    near = near.join(inside, ["pr", "dep_file"], "left")
    hit = near.where(~F.col("dep_test") & F.col("inside").isNull())
    impacted = hit.groupBy("pr").agg(F.count_distinct("source_id").alias("n_impacted"))
    tests = near.where("dep_test").groupBy("pr").agg(F.count_distinct("dep_file").alias("n_tests"))
    covered = near.where("dep_test").select("pr", "target_id").distinct()
    bare = changed.where(~F.col("is_test") & ~F.col("name").startswith("_")).join(covered, ["pr", "target_id"], "left_anti").groupBy("pr").agg(F.count("*").alias("n_untested"))
    out = files.groupBy("pr").agg(F.count("*").alias("n_files")).join(changed.groupBy("pr").agg(F.count("*").alias("n_changed")), "pr", "left")
    out = out.join(impacted, "pr", "left").join(tests, "pr", "left").join(bare, "pr", "left")
    if findings is not None:
        out = out.join(findings.where("severity = 'high'").groupBy("pr").agg(F.count("*").alias("n_high")), "pr", "left")
    else:
        out = out.withColumn("n_high", F.lit(0).cast("long"))
    out = out.na.fill(0, ["n_changed", "n_impacted", "n_tests", "n_untested", "n_high"])
    risk = risk_score(F.col("n_changed"), F.col("n_impacted"), F.col("n_high"), F.col("n_untested") > 0)
    return out.withColumn("risk", risk).withColumn("band", risk_band(F.col("risk")))
