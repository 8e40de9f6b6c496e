"""Blocked Bloom filter in built-in functions: a small broadcast table that
lets all wanted keys pass and few others, in front of an exact join."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 18           # 64-bit blocks: at most 4 MB of filter, whatever the keys
KEYS_PER_BLOCK = 4
BITS_PER_KEY = 4


def blocks_for(keys: int) -> int:
    """Blocks of a filter for so many keys, within the bound."""
    return min(MAX_BLOCKS, 1 << max(4, math.ceil(math.log2(max(1, keys / KEYS_PER_BLOCK)))))


def probe(key: Column, blocks: int):
    """(block, 64-bit mask) of a key."""
    h = F.xxhash64(key)
    bits = F.lit(0).cast("long")
    for k in range(BITS_PER_KEY):
        at = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)), bits


def bloom(keys: DataFrame, blocks: int = MAX_BLOCKS) -> DataFrame:
    """Filter of the column ``key``: (block, word), at most ``blocks`` rows;
    combined before the shuffle."""
    block, mask = probe(F.col("key"), blocks)
    return keys.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(
        F.bit_or("mask").alias("word"))


def mark(df: DataFrame, key: Column, filt: DataFrame, name: str, blocks: int = MAX_BLOCKS) -> DataFrame:
    """``df`` with the boolean column ``name``: whether ``key`` may be among
    the filter's keys (false: surely not; null keys: false). The filter is
    broadcast: at most ``blocks`` rows of 16 bytes."""
    block, mask = probe(key, blocks)
    f = F.broadcast(filt.select(F.col("block").alias(f"{name}_block"), F.col("word").alias(f"{name}_word")))
    d = df.withColumn(f"{name}_at", F.when(key.isNotNull(), block)).withColumn(f"{name}_mask", mask)
    d = d.join(f, F.col(f"{name}_at") == F.col(f"{name}_block"), "left")
    hit = F.coalesce(F.col(f"{name}_word").bitwiseAND(F.col(f"{name}_mask")) == F.col(f"{name}_mask"), F.lit(False))
    return d.withColumn(name, hit).drop(f"{name}_at", f"{name}_mask", f"{name}_block", f"{name}_word")


def possible(df: DataFrame, key: Column, keys: DataFrame, blocks: int = MAX_BLOCKS) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys`` (column ``key``)."""
    return mark(df, key, bloom(keys, blocks), "_may", blocks).filter("_may").drop("_may")


# --- the same idea for tasks that work on numpy arrays ---------------------------------

PY_BITS = 27                   # bits of the filter as a power of two: 16 MB at most


def bit_table(keys: DataFrame):
    """Broadcast bit table of the long column ``key``: at most 2**PY_BITS
    bits, gathered as 64-bit words combined before the shuffle."""
    bit = F.col("key").bitwiseAND(F.lit((1 << PY_BITS) - 1).cast("long"))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    got = keys.select(F.shiftright(bit, 6).alias("at"), word.alias("w")).groupBy("at").agg(F.bit_or("w").alias("w")).toArrow()
    table = np.zeros(1 << (PY_BITS - 6), dtype=np.uint64)
    table[got.column("at").to_numpy()] = got.column("w").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def in_table(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in a bit table."""
    bit = key & np.uint64((1 << PY_BITS) - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
