"""A Bloom filter as a table: rows that cannot match are dropped before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block is a row of eight words of 64 bits; a key sets some bits of one block.
WORDS, HASHES = 8, 5
MOST_BLOCKS = 1 << 18


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _positions(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(WORDS * 64)).cast("int") for i in range(HASHES)]


def block_count(keys: int, bits_per_key: int = 12) -> int:
    """Blocks for so many keys, at most MOST_BLOCKS: as a broadcast those have some 30 MB."""
    return max(1, min(MOST_BLOCKS, -(-keys * bits_per_key // (WORDS * 64))))


def build_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7): a row for each block in which a key sets bits."""
    spread = keys.select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_positions(F.col(key)))).alias("at"))
    bit = F.expr("shiftleft(1L, at % 64)")
    words = [F.coalesce(F.bit_or(F.when(F.expr("at div 64") == j, bit)), F.lit(0)).cast("long").alias(f"w{j}") for j in range(WORDS)]
    return spread.groupBy("block").agg(*words)


def might_match(rows: DataFrame, key: Column, built: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be among the filter's: all that are, and about one in 200 others.

    Where the filter has its full size and more keys than that is meant for, more others
    pass; none that matches is lost. A NULL key matches nothing. Rows are not moved.
    """
    names = [f"w{j}" for j in range(WORDS)]
    probe = built.select("block", F.array(*names).alias("__words")).withColumnRenamed("block", "__block")
    joined = rows.withColumn("__block_of", _block(key, blocks)).join(
        F.broadcast(probe), F.col("__block_of") == F.col("__block")
    )
    hits = [F.getbit(F.get("__words", F.shiftright(at, 6)), at.bitwiseAND(63)) == 1 for at in _positions(key)]
    held = key.isNotNull()
    for hit in hits:
        held &= hit
    return joined.where(held).drop("__block_of", "__block", "__words")
