"""Problem 8: documents of varying length put into containers of fixed capacity.

Method: space-filling-curve order. Hashed document vectors are projected to
few dimensions, documents range-sorted by their Hilbert key, and neighbours
along the curve are packed together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.simhash import WORD, Hasher
from loomspan.llm.tokens import TOKENIZER, make_counter
from loomspan.session import materialize, read_table

DIMS, BITS = 4, 10
#: Neighbours on the curve that are packed together, largest first, ...
WINDOW = 256
#: ... and for how many further windows what they leave open takes others in.
STAY_OPEN = 4


def hilbert_index(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points, one row each (Skilling, 2004), vectorized over the rows."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def project(words: np.ndarray, dims: int = DIMS, bits: int = BITS) -> list[int]:
    """Grid point of a text: the signed sums of its distinct hashed words, scaled to the unit cube."""
    if not len(words):
        return [0] * dims
    w = np.unique(words)
    signs = ((w[:, None] >> np.arange(11, 11 + dims, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) * 2 - 1
    z = signs.sum(axis=0) / np.sqrt(len(w))
    u = 1 / (1 + np.exp(-1.7 * z))  # close to the normal distribution's quantiles
    return np.minimum((u * (1 << bits)).astype(int), (1 << bits) - 1).tolist()


def _size(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, hasher = make_counter(tokenizer), Hasher()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            points = np.array([project(hasher.words(WORD.findall(t.lower()))) for t in texts]).reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([count(t) for t in texts], pa.int64()), pa.array(hilbert_index(points))], names=["doc_id", "tokens", "curve"])

    return run


def sized_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens, curve): size and Hilbert key of every non-null text."""
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).mapInArrow(_size(tokenizer), "doc_id long, tokens long, curve long")


class Packer:
    """Best fit decreasing into containers of one capacity, along the curve.

    A container is closed when the curve has moved STAY_OPEN windows past the
    one that opened it, so what it holds are neighbours.
    """

    def __init__(self, capacity: int, base: int) -> None:
        self.capacity, self.next, self.turn = capacity, base, 0
        self.open: list[tuple[int, int]] = []  # (free, container), sorted
        self.since: dict[int, int] = {}  # window in which an open container was opened

    def new(self, free: int) -> int:
        c, self.next = self.next, self.next + 1
        if free:
            insort(self.open, (free, c))
            self.since[c] = self.turn
        return c

    def put(self, size: int) -> int:
        k = bisect_left(self.open, (size, -1))
        if k == len(self.open):
            return self.new(self.capacity - size)
        free, c = self.open.pop(k)
        if free > size:
            insort(self.open, (free - size, c))
        return c

    def window(self, items: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(doc, piece, container, tokens, place) of (doc, tokens, place) items."""
        rests = []
        for doc, tokens, place in items:
            piece = 0
            if tokens > self.capacity:  # split only what alone exceeds the capacity
                for piece in range(tokens // self.capacity):
                    yield doc, piece, self.new(0), self.capacity, place
                piece += 1
                tokens %= self.capacity
                if not tokens:
                    continue
            rests.append((tokens, doc, piece, place))
        for tokens, doc, piece, place in sorted(rests, key=lambda r: (-r[0], r[3])):
            yield doc, piece, self.put(tokens), tokens, place
        self.turn += 1
        self.open = [(free, c) for free, c in self.open if self.turn - self.since[c] <= STAY_OPEN]
        self.since = {c: self.since[c] for _, c in self.open}


_PACKED = "limit_name string, capacity_tokens int, doc_id long, piece_no int, container_id long, tokens long, place long"


def _pack(limits: list[tuple[str, int]], window: int = WINDOW):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packers = [(name, Packer(capacity, base)) for name, capacity in limits]
        held: list[tuple[int, int, int]] = []
        place = base

        def flush(items: list) -> Iterator[pa.RecordBatch]:
            for name, p in packers:
                cols = list(zip(*p.window(items))) or [[]] * 5
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([p.capacity] * n, pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=["limit_name", "capacity_tokens", "doc_id", "piece_no", "container_id", "tokens", "place"],
                )

        for batch in batches:
            for doc, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc, tokens, place))
                place += 1
            while len(held) >= window:
                yield from flush(held[:window])
                held = held[window:]
        if held:
            yield from flush(held)

    return run


def pack_documents(docs: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The container of every document, or of each piece of one that exceeds the capacity.

    Null texts are left out; an empty text takes no space in any container;
    repeated ids are items of their own; an empty table gives no rows;
    limits that are null or below 1 are ignored. pack_limits is a table of
    settings that does not grow. Containers are numbered within ranges of
    the curve; only the last ones of a range stay partly open.
    """
    wanted = [(r.limit_name, r.capacity_tokens) for r in limits.filter("capacity_tokens >= 1").select("limit_name", "capacity_tokens").distinct().orderBy("capacity_tokens", "limit_name").collect()]
    sized = materialize(sized_documents(docs, tokenizer), "p8")
    # so many windows a range at least that what stays open at its end is little
    ranges = max(1, min(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), sized.count() // (64 * WINDOW)))
    ordered = sized.repartitionByRange(ranges, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return ordered.select("doc_id", "tokens").mapInArrow(_pack(wanted), _PACKED)


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pack_limits"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, the least possible number, the fill reached, and how near on the curve a container's documents lie.

    ``mean_span`` is the mean distance in curve ranks between the first and
    the last document of a container of several; ``random_span`` is what
    filling the same containers in random order would give.
    """
    packed = materialize(p8_pack(spark, sf_dir), "p8packed")
    n_docs = packed.groupBy("limit_name").agg(F.count_distinct("doc_id").alias("n_docs"))
    boxes = packed.groupBy("limit_name", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("k"), (F.max("place") - F.min("place")).alias("span")).join(F.broadcast(n_docs), "limit_name")
    total, n, cap, many = F.sum("used"), F.count("*"), F.col("capacity_tokens"), F.col("k") > 1
    got = boxes.groupBy("limit_name", "capacity_tokens").agg(n.alias("n_containers"), total.alias("total_tokens"), F.avg(F.when(many, F.col("span"))).alias("mean_span"), F.avg(F.when(many, (F.col("n_docs") + 1) * (F.col("k") - 1) / (F.col("k") + 1))).alias("random_span"))
    return got.select("limit_name", "capacity_tokens", "n_containers", F.ceil(F.col("total_tokens") / cap).alias("n_least"), "total_tokens", F.round(F.col("total_tokens") / (cap * F.col("n_containers")), 6).alias("fill"), F.round("mean_span", 1).alias("mean_span"), F.round("random_span", 1).alias("random_span"))


QUERIES = {"p8_pack": p8_pack, "p8_fill": p8_fill}
