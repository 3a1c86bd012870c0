"""A blocked Bloom filter as a DataFrame: one row a block, four 64-bit words in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4
BITS_PER_KEY = 16
#: 2**18 blocks of five longs: the filter is broadcast, and this is its proven size bound (about 10 MB).
MAX_BLOCKS = 1 << 18


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(word), key), F.lit(64)).cast("int"))


def build(keys: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of a column of keys (null keys are left out) and its number of blocks.

    Beyond ``max_blocks`` the filter only gets denser: it then passes more rows
    to the exact join, and never loses one.
    """
    listed = keys.select(F.col(key).alias("_k")).where("_k is not null")
    n = listed.count()
    blocks = max(1, min(max_blocks, n * BITS_PER_KEY // (64 * WORDS) + 1))
    table = listed.groupBy(_block(F.col("_k"), blocks).alias("_block")).agg(*[F.bit_or(_mask(F.col("_k"), w)).alias(f"_w{w}") for w in range(WORDS)])
    return table, blocks


def possible(df: DataFrame, key: Column, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be listed. The filter is broadcast; its size is bounded by ``MAX_BLOCKS``."""
    probe = df.withColumn("_block", _block(key, blocks))
    hit = probe.join(F.broadcast(bloom), "_block")
    for w in range(WORDS):
        hit = hit.where(F.col(f"_w{w}").bitwiseAND(_mask(key, w)) != 0)
    return hit.select(*df.columns)


def flagged(df: DataFrame, key: Column, bloom: DataFrame, blocks: int, name: str) -> DataFrame:
    """All rows, with a column that says whether their key may be listed."""
    probe = df.withColumn("_block", _block(key, blocks)).join(F.broadcast(bloom), "_block", "left")
    hit = F.lit(True)
    for w in range(WORDS):
        hit = hit & (F.col(f"_w{w}").bitwiseAND(_mask(key, w)) != 0)
    return probe.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(name))
