"""A blocked Bloom filter as a table: one row per block of 8 words of 32 bits, built and probed with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, WORD_BITS = 8, 32
BITS_PER_KEY = 16
# A filter up to this size is sent to every executor; a larger one is joined by its block number.
BROADCAST_BYTES = 32 * 1024 * 1024
BLOCK_BYTES = WORDS * WORD_BITS // 8


def block_count(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """Blocks for so many keys; about one false positive in a thousand at 16 bits a key."""
    return max(1, -(-keys * bits_per_key // (WORDS * WORD_BITS)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    """One bit per word: five bits each of a second hash."""
    second = F.xxhash64(F.lit(1), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(second, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7): bits of all keys, combined before the shuffle. Null keys take no part."""
    rows = keys.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("_block"), *[m.alias(f"_m{i}") for i, m in enumerate(_masks(F.col(key)))])
    return rows.groupBy("_block").agg(*[F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(WORDS)])


def probe(df: DataFrame, key: str, filter_table: DataFrame, blocks: int, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: true for every key of the filter, and for few others; false for null keys."""
    table = F.broadcast(filter_table) if blocks * BLOCK_BYTES <= BROADCAST_BYTES else filter_table
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col(key))):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(mask) != 0)
    joined = df.join(table, _block(F.col(key), blocks) == F.col("_block"), "left")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_block", *[f"_w{i}" for i in range(WORDS)])
