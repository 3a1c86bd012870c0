"""Labelled documents for the classifiers: held-out split and bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import remainder

#: A classifier is fitted on about this many labelled documents at most.
SAMPLE_ROWS = 20_000


def training_labels(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and label (0 or 1) of rows that may be learned from: crc32 mod 3 is not 1.

    Null identifiers and labels are left out; of repeated rows the largest label
    counts. Beyond ``rows`` a share of the identifiers is taken by hash, so about
    that many remain and the table can be broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(remainder(F.col("doc_id")) != 1)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return known


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label of the sample; texts are filtered in the scan, not shuffled."""
    known = F.broadcast(training_labels(labels, label, rows))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id")
