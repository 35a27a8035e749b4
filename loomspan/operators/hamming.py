"""Perceptual fingerprints: difference hash, and pairs within a Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference_hash(pixels: Column, side: int = 8) -> Column:
    """64 bits of an image given as ``side`` rows of ``side + 1`` grey values: is a value below its right neighbour?"""
    bits = F.sequence(F.lit(0), F.lit(side * side - 1))
    at = lambda i: (F.floor(i / side) * (side + 1) + i % side + 1).cast("int")
    bit = lambda i: F.when(F.element_at(pixels, at(i)) < F.element_at(pixels, at(i) + 1), F.lit(1)).otherwise(0).cast("long")
    return F.when(F.size(pixels) == side * (side + 1), F.aggregate(bits, F.lit(0).cast("long"), lambda s, i: F.shiftleft(s, 1).bitwiseOR(bit(i))))


def hamming_pairs(rows: DataFrame, id_col: str, fp_col: str, most: int = 8, blocks: int = 16) -> DataFrame:
    """(a, b, distance) of fingerprints at most ``most`` bits apart, found exactly.

    The 64 bits are cut into ``blocks``; fingerprints within ``most`` bits
    agree on at least blocks - most of them, so they meet on one of the
    first most // 2 + 1 pairs of neighbouring blocks whenever differences do
    not break every pair: with blocks >= 2 * most + 2 one pair always stays
    whole. Equal fingerprints are one row first.
    """
    if blocks < 2 * most + 2:
        blocks = 2 * most + 2
    edges = [round(64 * k / (blocks // 2)) for k in range(blocks // 2 + 1)]
    masks = []
    for lo, hi in zip(edges, edges[1:]):
        m = sum(1 << b for b in range(lo, hi))
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    classes = rows.filter(F.col(fp_col).isNotNull()).groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("rep"))
    keyed = classes.select("rep", "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("x")).select("rep", "fp", "x.t", "x.key")
    l, r = keyed.select("t", "key", F.col("rep").alias("a"), F.col("fp").alias("fa")), keyed.select("t", "key", F.col("rep").alias("b"), F.col("fp").alias("fb"))
    d = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    pairs = l.join(r, ["t", "key"]).filter("a < b").withColumn("distance", d).filter(F.col("distance") <= most).select("a", "b", "distance").distinct()
    copies = rows.select(F.col(id_col).alias("b"), F.col(fp_col).alias("fp")).join(classes, "fp").filter("b <> rep").select(F.col("rep").alias("a"), "b", F.lit(0).alias("distance"))
    return pairs.union(copies)
