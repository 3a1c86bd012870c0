"""Exact dedup (operator 3): a log-structured merge index of text digests, in DataFrame functions only.

* Memtable: each scan task digests its rows, sorts them by digest and flushes them
  as a run. There may be any number of memtables.
* Compaction: the level and the runs since merge into one level, a row for each
  digest with the identifier to keep and the number of rows.
* Hits: rows of digests with more than one row. The rows of all runs are probed with
  a Bloom filter of those digests; what may be a hit meets the level in an exact
  join. Texts of hits are read again and compared byte by byte; texts that only
  share a digest are grouped by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bloom
from loomgraph.llm.common import lower_az, read, without
from loomgraph.session import release, written


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs and levels of (digest, identifier, copies) in the shared folder."""

    def __init__(self, digest: Callable[[Column], Column] = sha256, keep: str = "smallest") -> None:
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is smallest or largest")
        self.digest, self.pick = digest, F.min if keep == "smallest" else F.max
        self.runs: list[DataFrame] = []
        self.fresh: list[DataFrame] = []
        self.level: DataFrame | None = None

    def flush(self, docs: DataFrame) -> DataFrame:
        """Write one sorted run for each scan task; nothing is shuffled."""
        rows = docs.select(self.digest(docs["_text"]).alias("digest"), docs["_id"].alias("id"))
        run = written(rows.sortWithinPartitions("digest"), "run")
        self.runs.append(run)
        self.fresh.append(run)
        return run

    def rows(self) -> DataFrame:
        """The rows of all runs."""
        return reduce(DataFrame.unionByName, self.runs)

    def compact(self) -> DataFrame:
        """Merge the level and the runs flushed since into one level: digest, keep (identifier) and size (rows)."""
        parts = [run.groupBy("digest").agg(self.pick("id").alias("keep"), F.count("*").alias("size")) for run in self.fresh]
        rows = reduce(DataFrame.unionByName, parts if self.level is None else [self.level, *parts])
        if len(parts) > 1 or self.level is not None:
            rows = rows.groupBy("digest").agg(self.pick("keep").alias("keep"), F.sum("size").alias("size"))
        level = written(rows.sortWithinPartitions("digest"), "level")
        self.fresh = []
        if self.level is not None:
            release(self.level)
        self.level = level
        return level


def _unequal(index: DigestIndex, docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests of hits whose texts are not all the same bytes; ``hits`` are the rows that may be some.

    Texts are equal if their smallest and their largest are, which each task can
    tell of its own rows first: a large group is not gathered anywhere.
    """
    many = index.level.where("size > 1").select("digest")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    rows = hits.join(many, "digest", "left_semi").select(name(F.col("id")).alias("k")).distinct()
    # only texts that may be hits are moved: the filter of their identifiers is probed in the scan
    table, blocks = bloom.build(written(rows, "hits"), "k")
    texts = bloom.possible(docs, name(docs["_id"]), table, blocks)
    ends = texts.groupBy(index.digest(F.col("_text")).alias("digest")).agg(F.min("_text").alias("a"), F.max("_text").alias("b"))
    return ends.where("a <> b").select("digest")


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = sha256, later: Sequence[DataFrame] = ()) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty. ``keep`` says whether the smallest or the largest identifier stays; a
    null identifier stays only in groups without any other. Rows that repeat both
    identifier and text are a group too, and one of them stays. An empty table
    gives no rows. Columns other than the two named are not read. Documents that
    came ``later`` are further memtables, each flushed and merged into the level.
    """
    memtables = [d.select(F.col(id_col).alias("_id"), lower_az(F.col(text_col)).alias("_text")) for d in (docs, *later)]
    docs = reduce(DataFrame.unionByName, memtables)
    index = DigestIndex(digest, keep)
    for memtable in memtables:
        index.flush(memtable)
        level = index.compact()
    # rows that the filter of the level's hits does not pass are alone with their digest, and are not moved
    table, blocks = bloom.build(level.where("size > 1"), "digest")
    probed = bloom.flagged(index.rows(), F.col("digest"), table, blocks, "_maybe")
    hits = probed.where("_maybe").drop("_maybe")
    each = hits.groupBy("digest", "id").agg(F.count("*").alias("n"))
    bad = None
    if level.where("size > 1").head(1):
        checked = written(_unequal(index, docs, hits), "unequal")
        bad = checked if checked.head(1) else None
    many = level.where("size > 1").select("digest", "keep", "size")
    if bad is not None:
        many = many.join(bad, "digest", "left_anti")
        each = each.join(bad, "digest", "left_anti")
    rows = each.join(many, "digest", "left")
    single = probed.where("not _maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("n"), "digest")
    same = rows.select("id", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", "n").alias("group_size"), "n", "digest").unionByName(single)
    if bad is not None:
        # texts that share a digest without being equal: the text itself is the key
        texts = docs.withColumn("digest", digest(docs["_text"])).join(bad, "digest", "left_semi")
        parts = texts.groupBy("digest", "_text").agg(index.pick("_id").alias("keep_id"), F.count("*").alias("group_size"))
        unequal = texts.groupBy("digest", "_text", "_id").agg(F.count("*").alias("n")).join(parts, ["digest", "_text"])
        same = same.unionByName(unequal.select(F.col("_id").alias("id"), "keep_id", "group_size", "n", "digest"))
    numbered = same.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return numbered.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        "digest",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts."""
    found = written(resolve(docs, id_col, text_col, keep), "decisions")
    digest = sha256(lower_az(docs[text_col]))
    again = found.groupBy(F.col(id_col).alias("id"), "digest").agg(F.max("kept").alias("keeps"), F.count("*").alias("n")).where("n > 1 or not keeps")
    again = written(again, "again")
    stay = without(docs, again, id=docs[id_col], digest=digest)
    if again.where("keeps").head(1):  # repeated rows of one identifier and text: the first of those that a task meets, then of all
        repeated = again.where("keeps")
        rows = docs.join(repeated.select("id", "digest"), docs[id_col].eqNullSafe(repeated["id"]) & (digest == repeated["digest"]), "left_semi")
        whole = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
        one = rows.select(docs[id_col].alias("id"), digest.alias("digest"), whole.alias("row")).dropDuplicates(["id", "digest"])
        stay = stay.unionByName(one.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
    return stay


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; of equal texts the row with the largest doc_id stays."""
    rows = resolve(read(spark, sf_dir, "documents"), keep="largest")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
