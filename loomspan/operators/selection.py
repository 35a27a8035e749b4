"""Ordered greedy selectors per query; only rows that provably cannot be chosen are cut before."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import constants as C
from loomspan.operators.simjoin import similar_pairs
from loomspan.session import materialize


def jaccard(a: frozenset, b: frozenset) -> float:
    """1 for two empty sets, 0 for one empty one."""
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b) if a and b else 0.0


def greedy_distinct(sets: list[frozenset], texts: list[str], threshold: float) -> list[int]:
    """Positions kept in order: none is threshold-similar to an earlier kept one.

    Items without tokens stay unless the same text was kept. A threshold of
    one or more keeps all.
    """
    if threshold >= 1:
        return list(range(len(sets)))
    kept: list[int] = []
    seen: set[str] = set()
    for i, s in enumerate(sets):
        if not s:
            if texts[i] in seen:
                continue
        elif any(sets[j] and jaccard(s, sets[j]) >= threshold for j in kept):
            continue
        seen.add(texts[i])
        kept.append(i)
    return kept


def quota_fill(order: list[int], sources: list[str], limit: int, per_source: int) -> list[int]:
    """First at most ``per_source`` of each source, then the rest in order up to ``limit``."""
    used: dict[str, int] = {}
    first, rest = [], []
    for i in order:
        if len(first) < limit and used.get(sources[i], 0) < per_source:
            used[sources[i]] = used.get(sources[i], 0) + 1
            first.append(i)
        else:
            rest.append(i)
    return first + rest[: max(0, limit - len(first))]


def mmr(rel: list[float], sets: list[frozenset], aspects: list[str], k: int, lam: float = C.MMR_LAMBDA, weight: float = 0.15, target: int = 2) -> list[int]:
    """Maximal marginal relevance with a bonus for aspects not yet covered; ties to the earlier."""
    left, chosen, worst = list(range(len(rel))), [], [0.0] * len(rel)
    count: dict[str, int] = {}
    while left and len(chosen) < k:

        def score(i: int) -> float:
            bonus = weight * max(0.0, 1 - count.get(aspects[i], 0) / target) if aspects[i] else 0.0
            return rel[i] + bonus if not chosen else lam * rel[i] + bonus - (1 - lam) * worst[i]

        best = max(left, key=lambda i: (score(i), -i))
        left.remove(best)
        chosen.append(best)
        count[aspects[best]] = count.get(aspects[best], 0) + 1
        if sets[best]:
            for i in left:
                worst[i] = max(worst[i], jaccard(sets[i], sets[best]))
    return chosen


def fill_skipping(sizes: list[int], budget: int, per_item: int, most: int) -> list[int]:
    """Items in order that still fit; one that does not is skipped, not the end."""
    out, left = [], budget
    for i, n in enumerate(sizes):
        n = min(n, per_item)
        if len(out) >= most:
            break
        if n <= left:
            out.append(i)
            left -= n
    return out


def until_saturated(sets: list[frozenset], threshold: float = 0.7, patience: int = 3) -> list[int]:
    """Items in order that add something, until ``patience`` in a row do not. Without tokens: adds nothing."""
    kept, idle = [], 0
    for i, s in enumerate(sets):
        if not s or any(jaccard(s, sets[j]) >= threshold for j in kept):
            idle += 1
            if idle >= patience:
                break
        else:
            idle = 0
            kept.append(i)
    return kept


def mmr_candidates(rows: DataFrame, query: str, order: list, rel: str, same: list[str], k: int, lam: float = C.MMR_LAMBDA, weight: float = 0.15) -> DataFrame:
    """``rows`` without those that ``mmr`` can never choose as one of ``k``.

    While fewer than k are chosen, one of the k rows of highest relevance is
    left and scores at least lam * rel - (1 - lam); a row scores at most
    lam * rel + weight. Of rows with equal ``same`` columns (aspect and
    texts) the earlier always goes first, so k of them are enough.
    """
    top = rows.select(query, rel).withColumn("k", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(rel)))).filter(F.col("k") <= k)
    least = top.groupBy(query).agg((F.min(rel) - (1 - lam + weight) / lam - 1e-9).alias("least"))
    near = rows.join(least, query).filter(F.col(rel) >= F.col("least")).drop("least")
    return near.withColumn("k", F.row_number().over(Window.partitionBy(query, *same).orderBy(*order))).filter(F.col("k") <= k).drop("k")


def fill_candidates(rows: DataFrame, query: str, order: list, size: Column, per_item: int, most: int) -> DataFrame:
    """``rows`` without those that ``fill_skipping`` can never choose.

    What is left of the budget only shrinks: after an item that did not fit,
    none of its size fits, so the first ``most`` of each size are enough.
    """
    sized = rows.withColumn("size", F.least(size, F.lit(per_item)))
    return sized.withColumn("k", F.row_number().over(Window.partitionBy(query, "size").orderBy(*order))).filter(F.col("k") <= most).drop("k", "size")


def _dropped(links: DataFrame) -> DataFrame:
    """Nodes ``b`` that the greedy order drops, of links (a, b), a before b.

    Every round the nodes without an open earlier neighbour are kept and
    drop their later neighbours; links of dropped nodes are closed. The
    first open node is decided in every round, so the rounds end.
    """
    out, links = [], materialize(links, "greedy")
    while links.take(1):
        first = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = materialize(links.join(first, "a", "left_semi").select("b").distinct(), "greedyd")
        out.append(gone)
        links = materialize(links.join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"), "greedy")
    none = links.select("b").limit(0)
    for part in out:
        none = none.unionByName(part)
    return none


def distinct_per_query(rows: DataFrame, query: str, order: list, tokens: Column, text: Column | None, threshold: float) -> DataFrame:
    """``greedy_distinct`` over all rows of every query: the kept ones with their position ``pos`` in the query's order.

    The similar pairs come from the exact join (tokens carry their query, so
    only rows of one query meet); the greedy order is resolved over them. No
    task holds a query's rows, whatever their number. Rows without tokens
    stay unless the same ``text`` was kept; without ``text`` none stays.
    """
    ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    ranked = materialize(ranked.withColumn("t", F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(F.col(query), w)))).withColumn("said", F.lit("") if text is None else text), "ranked")
    if threshold >= 1:
        return ranked.drop("t", "said")
    pairs = materialize(similar_pairs(ranked.select(F.struct(query, "pos").alias("id"), "t"), "id", "t", threshold), "pairs")
    # an equal set shares the fate of its first row or is dropped by it: gone either way
    equal = pairs.filter("similarity = 1").select("b")
    gone = equal.unionByName(_dropped(pairs.filter("similarity < 1").select("a", "b"))).select(F.col(f"b.{query}").alias(query), F.col("b.pos").alias("pos"))
    kept = ranked.filter(F.size("t") > 0).join(gone, [query, "pos"], "left_anti")
    if text is None:
        return kept.drop("t", "said")
    bare = ranked.filter(F.size("t") == 0)
    both = kept.select(query, "said", "pos", F.lit(False).alias("bare")).unionByName(bare.select(query, "said", "pos", F.lit(True).alias("bare")))
    first = both.groupBy(query, "said").agg(F.min(F.struct("pos", "bare")).alias("m")).filter("m.bare").select(query, F.col("m.pos").alias("pos"))
    return kept.unionByName(bare.join(first, [query, "pos"], "left_semi").select(*kept.columns)).drop("t", "said")


def quota_per_query(kept: DataFrame, query: str, source: str, limit: int, per_source: int) -> DataFrame:
    """``quota_fill`` of rows in the order of ``pos``: the chosen ones with their ``rank``."""
    late = F.row_number().over(Window.partitionBy(query, source).orderBy("pos")) > per_source
    return kept.withColumn("late", late).withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("late", "pos"))).filter(F.col("rank") <= limit).drop("late")


def saturated_per_query(kept: DataFrame, query: str, patience: int = 3) -> DataFrame:
    """``until_saturated`` of distinct rows with their ``pos``: those before the first ``patience`` positions in a row that none of them has."""
    w = Window.partitionBy(query).orderBy("pos")
    idle = F.col("pos") - F.lag("pos", 1, 0).over(w) - 1 >= patience
    return kept.withColumn("idle", idle).withColumn("over", F.max("idle").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("not over").drop("idle", "over")


def select_per_query(rows: DataFrame, query: str, order: list, choose: Callable[[pd.DataFrame], Iterable[int]], columns: str) -> DataFrame:
    """Apply ``choose`` to all rows of each query; keeps the chosen in order with their rank.

    A query's rows meet in one task, so ``rows`` should hold only those that
    the selector may choose (``mmr_candidates``, ``fill_candidates``).
    """
    rank = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        out = pdf.iloc[list(choose(pdf))].copy()
        out["rank"] = range(1, len(out) + 1)
        return out[names]

    return rows.withColumn("pos", rank).groupBy(query).applyInPandas(run, columns)
