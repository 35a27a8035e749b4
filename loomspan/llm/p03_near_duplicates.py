"""Problem 3: near-duplicate reads with small edits.

Method: circulant MinHash. One permutation scatters the hashed words, a
second one, shifted circularly by 1, 2, 3, ..., gives all coordinates of
the signature; signatures are banded, and candidates verified by their
exact Jaccard similarity over distinct words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import attach_by_key, components, may_be_in
from loomspan.llm.simhash import Hasher, mix
from loomspan.session import materialize, read_table

MIN_WORDS = 60
THRESHOLD = 0.7
#: Universe of the two permutations.
DOMAIN = 1 << 18
#: BANDS x ROWS coordinates. A pair of similarity 0.7 is a candidate with
#: probability 1 - (1 - 0.7**9)**96 = 0.98, of 0.72 with 0.994, of 0.75 with
#: 0.9994. Unrelated texts of one language are up to 0.33 alike and meet with
#: probability 0.004 at most; corpora far beyond 10**7 texts take more ROWS
#: and BANDS (12 and 280 keep the same recall).
BANDS, ROWS = 96, 9
#: Before words are compared, candidates that differ in more than
#: MAX_DIFFERENT of SKETCH one-bit coordinates are dropped: at similarity 0.7
#: 19.2 are expected (standard deviation 4.0), at 0.33 it is 42.9 (5.3).
SKETCH, MAX_DIFFERENT = 128, 32
SEED = 20240817

_WORD = re.compile(r"[^\W_]+")
_SIGNED = "read_id long, n int, set1 long, set2 long, sketch1 long, sketch2 long, bands array<long>"


def permutations(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(sigma, pi extended so that every circular shift is a slice)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    sigma, pi = rng.permutation(DOMAIN).astype(np.int32), rng.permutation(DOMAIN).astype(np.int32)
    return sigma, np.concatenate([pi, pi[: BANDS * ROWS]])


def signature(places: np.ndarray, window: np.ndarray, step: int = 64) -> np.ndarray:
    """Minimum over the words of the circularly shifted second permutation."""
    out = window[places[:step]].min(axis=0)
    for k in range(step, len(places), step):
        np.minimum(out, window[places[k : k + step]].min(axis=0), out=out)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sigma, pi = permutations()
    window = np.lib.stride_tricks.sliding_window_view(pi, BANDS * ROWS)
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    hasher = Hasher()
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), []
        for i, text in zip(ids, batch.column(1).to_pylist()):
            words = list(set(_WORD.findall(text.lower())))
            if len(words) < MIN_WORDS:
                continue
            h = hasher.words(words)
            sig = signature(sigma[(h & np.uint64(DOMAIN - 1)).astype(np.int64)], window)
            bands = mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * weights).sum(axis=1) ^ salt) >> np.uint64(16)
            sketch = np.packbits((mix(sig[:SKETCH].astype(np.uint64)) >> np.uint64(17)).astype(np.uint8) & 1)
            rows.append((i, len(words), int(mix(h).sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(h * np.uint64(3))).view(np.int64)), *map(int, sketch.view(np.int64)), bands.view(np.int64)))
        cols = list(zip(*rows)) if rows else [[]] * 7
        flat = np.concatenate(cols[6]) if rows else np.array([], dtype=np.int64)
        arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(cols[k], pa.int64()) for k in (2, 3, 4, 5))]
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["read_id", "n", "set1", "set2", "sketch1", "sketch2", "bands"])


def sign_reads(reads: DataFrame) -> DataFrame:
    """Signatures of the texts with at least MIN_WORDS distinct words, whole texts read."""
    return reads.select("read_id", "text").filter(F.col("text").isNotNull() & (F.length("text") >= 2 * MIN_WORDS - 1)).mapInArrow(_sign, _SIGNED)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        # 48 bits a word: two of a pair's words collide once in 10**10 pairs
        sets = [(hasher.words(list(set(_WORD.findall(t.lower())))) >> np.uint64(16)).view(np.int64) for t in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.array([], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["rep", "words"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        av, ao, bv, bo = a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy(), b.values.to_numpy(zero_copy_only=False), b.offsets.to_numpy()
        keep = np.zeros(len(batch), dtype=bool)
        for k in range(len(batch)):
            x, y = av[ao[k] : ao[k + 1]], bv[bo[k] : bo[k + 1]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep[k] = 10 * common >= 7 * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


class NearDuplicates:
    """Classes of equal word sets and the verified links between them.

    Texts below MIN_WORDS, null and empty ones are in no class. Copies
    (equal word sets, 128 bits and the count) form one class, whose smallest
    read id stands for it, so a group of copies of any size costs one row.
    A repeated row with the same id is one read. No link is capped.
    """

    def __init__(self, reads: DataFrame) -> None:
        signed = materialize(sign_reads(reads), "p3sig")
        self.members = signed.select("read_id", "n", "set1", "set2").distinct()
        once = signed.groupBy("n", "set1", "set2", "read_id").agg(F.first("sketch1").alias("sketch1"), F.first("sketch2").alias("sketch2"))
        groups = once.groupBy("n", "set1", "set2").agg(F.min(F.struct("read_id", "sketch1", "sketch2")).alias("m"), F.count("*").alias("copies"))
        key = F.shiftrightunsigned("set1", 24)  # 40 bits stand for a class where its text meets others
        classes = materialize(groups.select("n", "set1", "set2", key.alias("c"), F.col("m.read_id").alias("rep"), "m.sketch1", "m.sketch2", "copies"), "p3cls")
        self.classes = classes.select("n", "set1", "set2", "rep", "copies")
        # a band's row is two hashes: copies fall together map-side, and nothing else travels for texts that never meet
        banded = signed.select(key.alias("c"), F.explode("bands").alias("band")).distinct()
        met = banded.select("band", F.col("c").alias("a")).join(banded.select("band", F.col("c").alias("b")), "band").filter("a < b").select("a", "b").distinct()
        l, r = (classes.select(F.col("c").alias(x), F.col("rep").alias(f"rep_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch1", "sketch2"))) for x in "ab")
        size = (10 * F.col("n_a") >= 7 * F.col("n_b")) & (10 * F.col("n_b") >= 7 * F.col("n_a"))
        differ = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
        near = differ("sketch1") + differ("sketch2") <= MAX_DIFFERENT
        # classes that agree in these 40 bits by chance are other classes, and pairs of their own
        same = classes.groupBy("c").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("c").alias("a"), F.col("c").alias("b"))
        pairs = met.union(same).join(l, "a").join(r, "b").filter(size & near & (F.col("rep_a") != F.col("rep_b")))
        pairs = materialize(pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct(), "p3cand")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("read_id"))
        texts = may_be_in(reads.select("read_id", "text").filter("text is not null"), wanted, "read_id")
        sets = materialize(texts.mapInArrow(_word_rows, "rep long, words array<long>"), "p3sets")
        both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("words").alias("wb")), "b")
        self.links = materialize(both.select("a", "b", "wa", "wb").mapInArrow(_verify, "a long, b long").distinct(), "p3links")

    def labelled(self) -> DataFrame:
        """(read_id, rep, copies): every read with its class."""
        return attach_by_key(self.members, self.classes, ["n", "set1", "set2"], "copies").select("read_id", "rep", "copies")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of reads, as TESTDATA.md defines them: class links expanded, and copies among themselves."""
    nd = NearDuplicates(read_table(spark, sf_dir, "webtools_bridge"))
    who = materialize(nd.labelled(), "p3who")
    linked = nd.links.union(nd.classes.filter("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    left, right = who.select(F.col("rep").alias("a"), F.col("read_id").alias("x")), who.select(F.col("rep").alias("b"), F.col("read_id").alias("y"))
    pairs = linked.join(left, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("read_id_a"), F.greatest("x", "y").alias("read_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per read that has a near-duplicate: its group, its class and its number of links to other texts."""
    nd = NearDuplicates(read_table(spark, sf_dir, "webtools_bridge"))
    comp = components(nd.links)
    degree = nd.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    cls = nd.classes.join(degree, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").filter("copies > 1 or n_links > 0")
    cls = materialize(cls.select("n", "set1", "set2", "rep", "copies", F.coalesce("comp", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "p3grp")
    return attach_by_key(nd.members, cls, ["n", "set1", "set2"], "copies").select("read_id", "group_id", F.col("rep").alias("class_id"), "copies", "n_links")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
