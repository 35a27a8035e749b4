"""Corpus-wide ranking operators: BM25, rank fusion, coverage, term suggestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import constants as C
from loomspan.functions.text import retrieval_tokens, words
from loomspan.session import materialize


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query: str, top_k: int | None = None) -> DataFrame:
    """(query, doc_id, score) of every query against every document that holds one of its terms.

    All queries at once, one scan: the terms of ``queries``, a table of
    settings that does not grow, are looked up inside each row, and only
    their occurrences leave it. Statistics cover all documents; query terms
    are a set; null texts are empty documents. With ``top_k`` the best of
    each query, ties by id.
    """
    terms = queries.select(F.col(query).alias("query")).filter("query is not null").distinct().select("query", F.explode(F.array_distinct(retrieval_tokens(F.col("query")))).alias("term"))
    wanted = sorted(r.term for r in terms.select("term").distinct().collect())
    d = docs.select(F.col(doc_id).alias("doc_id"), retrieval_tokens(F.col(text)).alias("tokens"))
    d = materialize(d.select("doc_id", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: t.isin(wanted)).alias("hits")), "bm25")
    stats = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()  # one row, two numbers
    tf = d.select("doc_id", "dl", F.explode("hits").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(stats.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # one row per query term: bounded by the queries
    weights = terms.join(df, "term").select("query", "term", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (C.BM25_K1 + 1) / (F.col("tf") + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("dl") / F.lit(stats.avgdl or 1.0)))
    scores = tf.join(F.broadcast(weights), "term").groupBy("query", "doc_id").agg(F.sum(part).alias("score"))
    if top_k is None:
        return scores
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def reciprocal_rank_fusion(ranked: DataFrame, keys: list[str], rank: str, k: int = C.RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) per ``keys``, partial sums before the shuffle."""
    return ranked.groupBy(*keys).agg(F.sum(1 / (k + F.col(rank))).alias("rrf"), F.count("*").alias("n_lists"), F.min(rank).alias("best_rank"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``: an aggregate, so partial results combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def suggest_terms(results: DataFrame, query: str, text_cols: list[str], top: int = 3) -> DataFrame:
    """Per query the terms that occur in most of its results (two at least), without its own and stop words."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in text_cols])
    own = F.regexp_extract_all(F.lower(F.col(query)), F.lit(r"[\p{L}\p{N}_]+"), 0)
    terms = F.array_except(F.array_except(F.array_distinct(words(text)), own), F.array(*[F.lit(w) for w in C.REFINE_STOP_WORDS]))
    df = results.select(F.col(query).alias("query"), F.explode(terms).alias("term")).groupBy("query", "term").agg(F.count("*").alias("df")).filter("df >= 2")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("df"), "term"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= top)
