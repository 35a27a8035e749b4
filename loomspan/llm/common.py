"""What several of the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.bloom import may_be_in  # noqa: F401 (the operators beside take it from here)
from loomspan.session import materialize

#: A key is hot with at least this many rows and this share of all rows, so
#: at most 1 / HOT_SHARE keys are hot, however many rows there are.
HOT_ROWS, HOT_SHARE = 50_000, 1 / 2000


def clean_line(line: Column) -> Column:
    """White-space runs made one space, trimmed, lower-cased (problem 5's line)."""
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\r]+", " ")))


def attach_by_key(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with one-row-per-key ``groups`` that survives hot keys.

    ``groups[size]`` is the number of rows of the key; ``groups`` is read more
    than once and should be a written table. Keys that hold at least
    ``hot_rows`` rows and HOT_SHARE of all are joined by broadcast: there are
    at most 1 / HOT_SHARE of them, whatever the number of rows. All other
    keys are joined by shuffle.
    """
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    least = max(hot_rows, int((total or 0) * HOT_SHARE))
    if (most or 0) < least:
        return rows.join(groups, keys)
    hot, cold = groups.filter(F.col(size) >= least), groups.filter(F.col(size) < least)
    warm = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).select(*warm.columns).unionByName(warm)


def components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected edge list: (node, comp).

    Alternating large-star / small-star (Kiveris et al., 2014): every round
    shuffles edges only, a hub's neighbours are pre-aggregated to a minimum
    before they meet and a hot hub's edges get it by broadcast, and lineage is
    cut by a written table each round.
    ``comp`` is the smallest node of the component. Empty input gives no rows.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "cc")
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "ccl")
        large = attach_by_key(both, low, ["u"], "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    stars = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return stars.union(stars.select(F.col("comp").alias("node"), "comp").distinct())
