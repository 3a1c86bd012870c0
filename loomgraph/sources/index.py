"""The index of a code base: parsed files and resolved references, kept from one run to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import resolve
from loomgraph.schema import GraphTables
from loomgraph.session import written
from loomgraph.sources import extract, files
from loomgraph.sources.snapshots import SnapshotTable

_FOUND = "source_id string, file string, ref string, target_id string, confidence string"


class CodeIndex:
    """Two tables below a path: what parsing gave for each file, and what its references were resolved to.

    A run parses files that are new or differ, takes out files that are gone, and looks up
    only references that these can change. After any runs the index is what one run over
    the last files makes of them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark = spark
        self.parsed = SnapshotTable(spark, f"{path.rstrip('/')}/parsed", "path", ("run",), buckets)
        self.references = SnapshotTable(spark, f"{path.rstrip('/')}/references", "path", ("run",), buckets)

    def _rows(self) -> DataFrame:
        found = self.parsed.read()
        return self.spark.createDataFrame([], extract.PARSED) if found is None else found.drop("run")

    def found(self) -> DataFrame:
        """(source_id, file, ref, target_id, confidence), as ``resolve`` gives them."""
        rows = self.references.read()
        if rows is None:
            return self.spark.createDataFrame([], _FOUND)
        return rows.select(F.col("path").alias("file"), F.explode("refs").alias("r")).select("r.source_id", "file", "r.ref", "r.target_id", "r.confidence")

    def extracted(self) -> GraphTables:
        """The graph as it was parsed, with targets that are only named."""
        return extract.tables(self._rows())

    def graph(self) -> GraphTables:
        """The graph with resolved targets."""
        g = self.extracted()
        return GraphTables(g.symbols, resolve.resolved(g, self.found()), g.files)

    def update(self, texts: DataFrame) -> dict[str, int]:
        """Bring the index to the files (path, text); counts of files and of references that are new or lead elsewhere.

        Files that do not parse are indexed with what could be read of them, and counted.
        """
        run = self.parsed.versions()[-1] + 1 if self.parsed.versions() else 0
        known = texts.where(F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).isin(*sorted(extract.REGISTRY)))
        now = known.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
        before = self._rows()
        paths = written(files.changed_paths(before.select("path", "content_hash"), now), "changes")
        counts = {r["change"]: r["n"] for r in paths.groupBy("change").agg(F.count("*").alias("n")).collect()}
        out = {c: counts.get(c, 0) for c in ("added", "modified", "removed")} | {"errors": 0, "references": 0}
        if not counts:
            return out
        old = written(self.extracted().symbols, "old")
        fresh = written(extract.parse(known.join(paths.where("change <> 'removed'"), "path", "left_semi")), "parsed")
        out["errors"] = fresh.where(F.size("errors") > 0).count()
        gone = paths.where("change = 'removed'").select("path", F.lit("delete").alias("op"))
        put = fresh.withColumn("op", F.lit("put")).unionByName(gone, allowMissingColumns=True)
        found = written(self.found(), "found")
        self.parsed.apply(put.withColumn("run", F.lit(run).cast("long")))
        g = self.extracted()
        after = written(resolve.resolve_again(found, old, g, paths), "found")
        # files whose references changed, or that have none any more
        row = F.struct("source_id", "ref", "target_id", "confidence")
        gather = lambda rows, name: rows.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list(row)).alias(name))  # noqa: E731  a file's references
        both = gather(after, "refs").join(gather(found, "had"), "path", "full_outer").where(~F.col("refs").eqNullSafe(F.col("had")))
        refs = both.select("path", "refs", F.when(F.col("refs").isNull(), "delete").otherwise("put").alias("op"))
        out["references"] = after.subtract(found.select(*after.columns)).count()
        self.references.apply(refs.withColumn("run", F.lit(run).cast("long")))
        return out
