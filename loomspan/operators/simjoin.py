"""Exact set-similarity self-join: partition signatures and a parity filter, then verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.bloom import may_be_in
from loomspan.session import materialize

#: Low bits of a token's hash that hold its length, by which parts are ranked.
LENGTH_BITS = 6
#: Bits of the parity sketch that travels with a set's signatures, and of the one its candidate pairs are sifted by.
SKETCH_BITS, WIDE_BITS = 128, 512

_SIGNATURES = "sig long, h long, n int, p0 long, p1 long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bounds(threshold: float, most: int) -> np.ndarray:
    """Smallest sizes of the size groups up to ``most``: a set's partners are of its own group or of one beside it."""
    out = [1]
    while out[-1] <= most:
        out.append(int(out[-1] / threshold + 1e-9) + 1)
    return np.array(out + [int(out[-1] / threshold + 1e-9) + 1], np.int64)


def _parity(w: np.ndarray, row: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Per row one bit for every residue of its tokens' hashes: whether their number is odd.

    Two sketches differ in at most as many bits as the sets do in tokens.
    """
    odd = np.bincount(row * bits + (w >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=rows * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, bits), axis=1, bitorder="little").view(np.int64)


def _wide_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, w = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sketch = _parity(w, np.repeat(np.arange(len(n)), n), len(n), WIDE_BITS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(sketch.ravel(), WIDE_BITS // 64).cast(pa.list_(pa.int64()))], names=["h", "n", "s"])


def _signatures(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (h, n, tokens as hashes) to signatures of which two similar sets share one.

    In family g meet the pairs whose smaller set is of size group g. They
    differ in at most d tokens, so if every token is put into one of
    d + 1 + e parts by its hash, at least e + 1 parts are the same in both
    (Deng et al., 2015). Each set leaves out its e parts of fewest letters:
    the best part that two sets share is among the others in both. A set
    is in the family of its own group and, with ``n`` negated, in the one
    below, where it can be the larger one only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(2)
            h, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            if not len(h):
                continue
            w = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(h)), n)
            sketch = _parity(w, row, len(h), SKETCH_BITS)
            bounds = _bounds(threshold, int(n.max()))
            group = np.searchsorted(bounds, n, side="right") - 1
            content, letters = _mixed(w), (w & np.uint64((1 << LENGTH_BITS) - 1)).astype(np.int64)
            for below in (0, 1):
                family = group - below
                d = np.floor((1 - threshold) / threshold * (bounds[np.maximum(family, 0) + 1] - 1) + 1e-6).astype(np.int64)
                d[family < 0] = 0  # sets that may differ in nothing are copies of each other
                extra = (d + 1) // 8
                parts = np.where(d > 0, d + 1 + extra, 0)
                base = np.cumsum(parts) - parts
                on = d[row] > 0
                r, x = row[on], w[on]
                slot = base[r] + ((x >> np.uint64(LENGTH_BITS)) % parts[r].astype(np.uint64)).astype(np.int64)
                total = int(parts.sum())
                if not total:
                    continue
                order = np.argsort(slot)
                slot = slot[order]
                first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                value, size = np.zeros(total, np.uint64), np.zeros(total, np.int64)
                value[slot[first]] = np.add.reduceat(content[on][order], first)
                size[slot[first]] = np.add.reduceat(letters[on][order], first)
                owner = np.repeat(np.arange(len(h)), parts)
                place = np.arange(total) - base[owner]
                rank = np.lexsort((value, size, owner))  # equal parts in the order of their places
                kept = np.sort(rank[np.arange(total) - base[owner] >= extra[owner]])
                own = owner[kept]
                sig = _mixed(value[kept] + _mixed((family[own] << 32 | place[kept]).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), pa.array(h[own]), pa.array((-n if below else n)[own].astype(np.int32)), pa.array(sketch[own, 0]), pa.array(sketch[own, 1])],
                    names=["sig", "h", "n", "p0", "p1"],
                )

    return run


def _hashed(sets: DataFrame) -> DataFrame:
    """(h, n, w): each token as a hash whose low bits are its length."""
    token = lambda w: F.shiftleft(F.shiftright(F.xxhash64(w), LENGTH_BITS), LENGTH_BITS).bitwiseOR(F.least(F.length(w.cast("string")), F.lit((1 << LENGTH_BITS) - 1)).cast("long"))
    return sets.select("h", "n", F.transform("t", token).alias("w"))


def _sides(rows: DataFrame) -> list[DataFrame]:
    """``rows`` for either side of a pair, all columns but ``sig`` with the side's letter."""
    return [rows.select(*(F.col(c).alias(c if c == "sig" else c + side) for c in rows.columns)) for side in "ab"]


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(ha, na, hb, nb) of the sets that share a signature and whose sizes and sketches do not rule them out."""
    # copies have the same rows: one of each is left behind the shuffle
    l, r = _sides(_hashed(sets).mapInArrow(_signatures(threshold), _SIGNATURES).repartition("sig").distinct())
    na, nb = F.abs("na"), F.abs("nb")
    most = (1 - threshold) / (1 + threshold) * (na + nb) + 1e-6  # tokens in which they may differ
    once = (F.col("ha") < F.col("hb")) | ((F.col("ha") == F.col("hb")) & (na < nb))
    size = (na >= threshold * nb) & (nb >= threshold * na) & ((F.col("na") > 0) | (F.col("nb") > 0))
    apart = F.bit_count(F.col("p0a").bitwiseXOR(F.col("p0b"))) + F.bit_count(F.col("p1a").bitwiseXOR(F.col("p1b")))
    cand = materialize(l.join(r, "sig").filter(once & size & (apart <= most)).select("ha", na.alias("na"), "hb", nb.alias("nb")).distinct(), "simp")
    # sets of many words pass a narrow sketch by chance: a wide one is fetched once a candidate before any token is
    wide = materialize(_hashed(may_be_in(sets.select("h", "n", "t"), _members(cand), "h")).mapInArrow(_wide_sketches, "h long, n int, s array<long>").dropDuplicates(["h", "n"]), "sims")
    l, r = _sides(wide)
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return cand.join(l, ["ha", "na"]).join(r, ["hb", "nb"]).filter(apart <= most).select("ha", "na", "hb", "nb")


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("ha").alias("h"), F.col("na").alias("n")).union(pairs.select("hb", "nb")).distinct()


def similar_pairs(rows: DataFrame, id_col: str, tokens: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of rows whose distinct tokens are at least ``threshold`` alike (Jaccard).

    Rows with equal token sets form one class, so copies meet once and are
    given as (copy, representative) pairs; classes meet where a part of
    their tokens is the same (``_signatures``), and what their sketches leave
    is verified on the tokens. Rows without tokens are in no pair. Exact: no
    candidate is dropped.
    """
    sets = rows.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("t")).filter(F.size("t") > 0)
    keyed = materialize(sets.select("id", "t", F.xxhash64("t").alias("h"), F.size("t").alias("n")), "sim")
    classes = materialize(keyed.groupBy("h", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "simc")
    cand = materialize(_candidates(keyed, threshold), "simv")
    wanted = materialize(classes.join(_members(cand), ["h", "n"]).select("h", "n", "rep"), "simw")
    t = materialize(may_be_in(keyed.select("h", "n", F.col("id").alias("rep"), "t"), wanted, "rep").join(wanted, ["h", "n", "rep"]).dropDuplicates(["h", "n"]), "simt")
    l, r = _sides(t.select("h", "n", "rep", "t"))
    both = cand.join(l, ["ha", "na"]).join(r, ["hb", "nb"]).filter(F.col("repa") != F.col("repb"))
    common = F.size(F.array_intersect("ta", "tb"))
    sim = common / (F.col("na") + F.col("nb") - common)
    first = F.col("repa") < F.col("repb")
    linked = both.select(F.when(first, F.col("repa")).otherwise(F.col("repb")).alias("a"), F.when(first, F.col("repb")).otherwise(F.col("repa")).alias("b"), sim.alias("similarity")).filter(F.col("similarity") >= threshold)
    copies = keyed.select("id", "h", "n").join(classes.filter("copies > 1").select("h", "n", "rep"), ["h", "n"]).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return linked.union(copies)
