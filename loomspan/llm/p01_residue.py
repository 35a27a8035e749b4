"""Problem 1: template residue, filler, error messages and walls instead of content.

Method: every text gets a SimHash; near-duplicates are found by partitioned
SimHash tables and verified by Hamming distance and by the similarity of
their five-word shingles; the labels of reads whose whole text is residue
at sight are propagated through the connected components.

Only components that hold a trusted label matter, so the tables are searched
from the trusted texts outwards, round by round, until nothing new is found:
the links found are all links of those components that lead to a text
without a label of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import attach_by_key, components, may_be_in
from loomspan.llm.residue_rules import judge
from loomspan.llm.simhash import WORD, Hasher, fingerprint, mix, shingles, table_masks
from loomspan.session import materialize, read_table

#: Independent SimHashes a text: 192 bits. Five-word shingles 0.8 alike differ in 29.1 of them on average (deviation 5), 0.9 alike in 20.
SEEDS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MAX_HAMMING = 43
#: 28 tables a SimHash, each keyed on 16 of its 64 bits. Two texts 0.8 alike meet
#: in a table of one SimHash with probability 0.68, in one of the three with 0.96.
BLOCKS, EQUAL = 8, 2
MIN_SIMILARITY = 0.8

#: Texts 0.8 alike have shingle counts in this ratio, so they are in the same
#: or in neighbouring bins of the logarithm to this base.
SIZE_BASE = 1 / MIN_SIMILARITY

_FPS = ("fp", "fp1", "fp2")
_LABELS = "read_id long, residue boolean, whole boolean, text_key long, size int, " + ", ".join(f"{c} long" for c in _FPS)


def fingerprints(s: np.ndarray) -> list[int]:
    """The SimHashes of hashed shingles, one for each of SEEDS."""
    return [fingerprint(mix(s ^ np.uint64(x)) if x else s) for x in SEEDS]


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(mask=True)
    for batch in batches:
        ids, rows = batch.column(0), []
        for text in batch.column(1).to_pylist():
            residue, whole = judge(text)
            words = hasher.words(WORD.findall(text.lower()))
            s = shingles(words)
            key = int((s * np.arange(1, 2 * len(s) + 1, 2, dtype=np.uint64)).sum().view(np.int64)) if len(s) else 0
            rows.append((residue, whole, key, len(np.unique(s)), *(fingerprints(s) if len(s) else [0] * len(SEEDS))))
        cols = list(zip(*rows)) if rows else [[]] * (4 + len(SEEDS))
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[4:])], names=["read_id", "residue", "whole", "text_key", "size", *_FPS])


def label_reads(reads: DataFrame) -> DataFrame:
    """Per non-empty text: trusted labels, a key equal for texts equal but for numbers, and the SimHashes."""
    return reads.select("read_id", "text").filter(F.col("text").isNotNull() & F.col("text").rlike(r"\S")).mapInArrow(_label, _LABELS)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(mask=True)
    for batch in batches:
        sets = [np.unique(shingles(hasher.words(WORD.findall(t.lower())))).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))], names=["rep", "sh"])


def _keyed(classes: DataFrame, reach: int) -> DataFrame:
    """(rep, key): one row per table and size bin, with the bins up to ``reach`` beside its own."""
    own = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / float(np.log(SIZE_BASE)))
    binned = classes.select("rep", *_FPS, F.explode(F.array(*[own + F.lit(d) for d in range(-reach, reach + 1)])).alias("bin"))
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.col(c).bitwiseAND(m).alias("v")) for i, (c, m) in enumerate((c, m) for c in _FPS for m in table_masks(BLOCKS, EQUAL))])
    return binned.select("rep", F.explode(F.transform(masks, lambda x: F.xxhash64(x.t, x.v, F.col("bin")))).alias("key"))


def candidate_pairs(seeds: DataFrame, others: DataFrame) -> DataFrame:
    """(a, b): a seed and another class that agree on a table of one SimHash and differ in at most MAX_HAMMING bits of all.

    Both: (rep, size, SimHashes). A table's row is a key and an id; rows of
    ``others`` whose key no seed has are dropped before they are shuffled.
    """
    ours = _keyed(seeds, 1)
    theirs = may_be_in(_keyed(others, 0), ours, "key")
    met = ours.select("key", F.col("rep").alias("a")).join(theirs.select("key", F.col("rep").alias("b")), "key").filter("a <> b").select("a", "b").distinct()
    l, r = (df.select(F.col("rep").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in _FPS]) for df, x in ((seeds, "a"), (others, "b")))
    bits = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _FPS), F.lit(0))
    return met.join(l, "a").join(r, "b").filter(bits <= MAX_HAMMING).select("a", "b")


def verified(reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose five-word shingles are at least MIN_SIMILARITY alike; texts are cut where they are read, and only their shingles travel."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("read_id"))
    texts = may_be_in(reads.select("read_id", "text").filter("text is not null"), wanted, "read_id")
    sets = materialize(texts.mapInArrow(_shingle_rows, "rep long, sh array<long>").dropDuplicates(["rep"]), "p1sets")
    j = pairs.join(sets.select(F.col("rep").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("sh").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return j.filter(common >= MIN_SIMILARITY * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def trusted_links(reads: DataFrame, classes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(a, b): the near-duplicate links that lead from texts labelled whole to texts without that label, and on from those."""
    seeds, open_ = classes.filter("whole"), classes.filter("not whole")
    links = None
    for _ in range(max_rounds):
        pairs = materialize(candidate_pairs(seeds, open_), "p1pairs")
        new = materialize(verified(reads, pairs), "p1links") if pairs.take(1) else pairs
        links = new if links is None else links.unionByName(new)
        if not new.take(1):
            return links
        reached = materialize(new.select(F.col("b").alias("rep")).distinct(), "p1reach")
        seeds = materialize(open_.join(reached, "rep", "left_semi"), "p1seeds")
        open_ = materialize(open_.join(reached, "rep", "left_anti"), "p1open")
    raise RuntimeError("the search for near-duplicates did not end")


def residue_labels(reads: DataFrame) -> DataFrame:
    """(read_id, residue, propagated) for every non-empty text.

    ``residue``: seen by rule, in the text or as the whole text.
    ``propagated``: only the component of the text says so. A label spreads
    from whole-text residue alone; a field left in an article says nothing
    about the article's other copies. Null and blank texts have no row,
    an empty table gives none, repeated rows are labelled alike.
    """
    labels = materialize(label_reads(reads), "p1")
    groups = labels.groupBy("text_key", "fp").agg(F.min("read_id").alias("rep"), F.count("*").alias("n"), F.max("whole").alias("whole"), F.min("size").alias("size"), *[F.min(c).alias(c) for c in _FPS[1:]])
    classes = materialize(groups, "p1classes")
    links = trusted_links(reads, classes)
    if not links.take(1):  # no text without a label is like one with it
        return labels.select("read_id", (F.col("residue") | F.col("whole")).alias("residue"), F.lit(False).alias("propagated"))
    comp = components(links)
    placed = classes.join(comp, classes.rep == comp.node, "left").withColumn("comp", F.coalesce("comp", "rep"))
    bad = placed.groupBy("comp").agg(F.max("whole").alias("bad")).filter("bad").select("comp")
    tainted = materialize(placed.join(bad, "comp", "left_semi").select("text_key", "fp", "n"), "p1bad")
    spread = attach_by_key(labels.select("text_key", "fp", "read_id"), tainted, ["text_key", "fp"], "n").select("read_id").distinct()
    seen = F.col("residue") | F.col("whole")
    return labels.join(spread.withColumn("hit", F.lit(True)), "read_id", "left").select("read_id", seen.alias("residue"), (F.coalesce("hit", F.lit(False)) & ~seen).alias("propagated"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_labels(read_table(spark, sf_dir, "webtools_bridge")).filter("residue or propagated").select("read_id").distinct()


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-empty text's label and whether it came by propagation."""
    return residue_labels(read_table(spark, sf_dir, "webtools_bridge"))


QUERIES = {"p1_found": p1_found, "p1_labels": p1_labels}
