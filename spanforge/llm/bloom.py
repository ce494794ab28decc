"""A blocked Bloom filter made of DataFrame functions: built by aggregation, tested by a broadcast join of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import free_name

BLOCK_BITS = 32768
#: Bits set for a key within its block.
PROBES = 3


def n_blocks(rows: int, bits_per_row: int, max_bits: int) -> int:
    """Blocks for so many rows; max_bits bounds the broadcast at any input size (beyond it only more rows pass the filter)."""
    return max(1, min(-(-rows * bits_per_row // BLOCK_BITS), max_bits // BLOCK_BITS))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks)).cast("int")


def probes_of(key: Column) -> list[Column]:
    mixed = F.xxhash64(key)
    return [F.pmod(F.shiftright(mixed, 16 * i), F.lit(BLOCK_BITS)).cast("int") for i in range(PROBES)]


def build(keys: DataFrame, key: str, blocks: int, at_least: int = 1) -> DataFrame:
    """(block, bits): the bits that at least so many of the keys set."""
    probes = keys.select(block_of(F.col(key), blocks).alias("block"), F.explode(F.array_distinct(F.array(*probes_of(F.col(key))))).alias("probe"))
    counted = probes.groupBy("block", "probe").count()
    return counted.where(F.col("count") >= at_least).groupBy("block").agg(F.bitmap_construct_agg(F.col("probe").cast("long")).alias("bits"))


def _bit(bits: Column, probe: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(probe / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.expr("1").bitwiseAND(F.call_function("shiftright", byte, F.pmod(probe, F.lit(8)))) == 1


def mark(df: DataFrame, key: str, filter_: DataFrame, blocks: int, name: str) -> DataFrame:
    """df and a boolean column: false only if the key was surely not among those that the filter holds."""
    at, block, bits = free_name(df, "at", "block", "bits")
    held = F.broadcast(filter_.select(F.col("block").alias(block), F.col("bits").alias(bits)))
    joined = df.withColumn(at, block_of(F.col(key), blocks)).join(held, F.col(at) == F.col(block), "left")
    found = F.lit(True)
    for probe in probes_of(F.col(key)):
        found = found & _bit(F.col(bits), probe)
    return joined.withColumn(name, F.coalesce(F.col(bits).isNotNull() & found, F.lit(False))).drop(at, block, bits)


# The same filter for keys that are evenly spread 64-bit numbers already: built by Spark, tested with numpy in workers.


def build_even(keys: DataFrame, key: str, blocks: int) -> bytes:
    """The filter's bits, block after block; blocks bounds what reaches the driver."""
    k = F.col(key)
    probes = F.array(*(F.shiftrightunsigned(k, s).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for s in EVEN_SHIFTS))
    set_ = keys.select(F.pmod(k, F.lit(blocks)).cast("int").alias("block"), F.explode(F.array_distinct(probes)).alias("probe")).distinct()
    rows = set_.groupBy("block").agg(F.bitmap_construct_agg(F.col("probe").cast("long")).alias("bits")).collect()
    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for r in rows:
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


EVEN_SHIFTS = (49, 34, 19)


def maybe_in(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 keys may be among those that the filter was built of."""
    table = np.frombuffer(bits, np.uint8)
    block = np.mod(keys, len(table) * 8 // BLOCK_BITS) * (BLOCK_BITS // 8)
    found = np.ones(len(keys), bool)
    for s in EVEN_SHIFTS:
        probe = ((keys.view(np.uint64) >> np.uint64(s)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
        found &= (table[block + (probe >> 3)] >> (probe & 7).astype(np.uint8) & 1).astype(bool)
    return found
