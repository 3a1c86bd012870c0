"""The graph tables seen over a parts-and-orders warehouse.

Parts are symbols. Consecutive lines of an order relate their parts. For resolution,
the first part of an order names the others, which are yet to be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schema import UNRESOLVED, GraphTables

KIND_OF_TYPE = {"STANDARD": "function", "ECONOMY": "method", "MEDIUM": "class", "PROMO": "import", "LARGE": "constant", "SMALL": "variable"}
KIND_OF_FLAG = {"A": "calls", "N": "imports", "R": "references"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def _file_of(brand: str = "p_brand", kind: str = "p_type") -> Column:
    return F.concat(F.lit("/src/"), F.col(brand), F.lit("/"), F.col(kind), F.lit(".py"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("kind", _mapped(F.col("p_type"), KIND_OF_TYPE))
    brand = F.substring("p_brand", 7, 9).cast("int")
    return p.select(
        F.concat(F.lit("part::"), "p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat_ws(".", "p_brand", "p_name", F.col("p_partkey").cast("string")).alias("qualified_name"),
        "kind",
        _file_of().alias("file_path"),
        F.col("p_size").alias("start_line"),
        F.lit(0).alias("start_col"),
        (F.col("p_size") + 3).alias("end_line"),
        F.lit(0).alias("end_col"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat("p_name", F.lit(" of "), "p_brand")).alias("docstring"),
        F.when(F.col("kind").isin("function", "method"), F.concat("p_name", F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).alias("signature"),
        F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("cached"), F.lower("p_type"))).otherwise(F.array().cast("array<string>")).alias("decorators"),
        F.when(brand % 3 == 0, "python").when(brand % 3 == 1, "go").otherwise("rust").alias("language"),
        (F.col("p_size") % 10 == 0).alias("is_test"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _lines(spark, sf_dir)
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), _file_of().alias("file_path"))
    pairs = a.join(b, ["l_orderkey", "l_linenumber"]).where(F.col("l_partkey") != F.col("to")).join(files, "l_partkey")
    return pairs.select(
        F.concat(F.lit("part::"), "l_partkey").alias("source_id"),
        F.concat(F.lit("part::"), "to").alias("target_id"),
        _mapped(F.col("l_returnflag"), KIND_OF_FLAG).alias("kind"),
        "file_path",
        F.col("l_linenumber").cast("int").alias("start_line"),
        F.when(F.col("l_linestatus") == "O", "extracted").otherwise("inferred").alias("confidence"),
    )


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from the first part of an order to the names of its other parts."""
    a = _lines(spark, sf_dir)
    first = a.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("from"))
    p = table(spark, sf_dir, "part")
    named = a.where("l_linenumber > 1").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    ref = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_brand", F.lit("."), "p_name"))
    files = p.select(F.col("p_partkey").alias("from"), _file_of().alias("file_path"))
    return named.join(first, "l_orderkey").join(files, "from").select(F.concat(F.lit("part::"), "from").alias("source_id"), F.concat(F.lit(UNRESOLVED), ref).alias("target_id"), F.lit("calls").alias("kind"), "file_path", F.lit("extracted").alias("confidence"))


def graph(spark: SparkSession, sf_dir: str) -> GraphTables:
    s, r = symbols(spark, sf_dir), relationships(spark, sf_dir)
    counts = s.groupBy("file_path").agg(F.count("*").alias("symbol_count"), F.min("language").alias("language"))
    files = counts.select(F.col("file_path").alias("path"), "language", "symbol_count")
    return GraphTables(s, r, files)
