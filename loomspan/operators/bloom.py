"""A Bloom filter that cuts wide rows where they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A Bloom filter has this many slots of 64 bits, whatever the number of keys.
BLOOM_SLOTS = 1 << 20


def _slot_and_bits(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key, F.lit(77))
    bits = F.lit(0).cast("long")
    for k in range(4):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 20 + 7 * k), F.lit(64)).cast("int")))
    return F.pmod(h, F.lit(BLOOM_SLOTS)), bits


def may_be_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be among ``keys[key]``: a Bloom filter, no row of ``keys`` is missed.

    The filter is a table of at most BLOOM_SLOTS slots (16 bytes each), or-ed
    together map-side and broadcast, so ``rows`` are cut where they are read
    and only what may be wanted is ever shuffled. Ten bits a key up to seven
    million keys; beyond, more rows pass, and the join that follows sorts
    them out in the same way.
    """
    slot, bits = _slot_and_bits(F.col(key))
    table = keys.select(slot.alias("bloom_slot"), bits.alias("bloom_bits")).groupBy("bloom_slot").agg(F.bit_or("bloom_bits").alias("bloom_mask"))
    hit = rows.withColumns({"bloom_slot": slot, "bloom_bits": bits}).join(F.broadcast(table), "bloom_slot")
    return hit.filter(F.col("bloom_mask").bitwiseAND(F.col("bloom_bits")) == F.col("bloom_bits")).select(*rows.columns)
