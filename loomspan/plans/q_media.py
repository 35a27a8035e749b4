"""Image and seeding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import urls as U
from loomspan.functions.text import words
from loomspan.operators import retrieval as R
from loomspan.plans.q_search import results
from loomspan.plans.q_urls import _P
from loomspan.session import read_table

# Names of images that show nothing, and endings that are no photographs.
_EMPTY = r"pixel|track|1x1|spacer|blank|clear\.gif|analytics|badge|icon|logo|sprite|avatar"
_ENDING = r"\.(?:svg|ico|gif)(?:$|\?)"


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image once, with the first read that shows it and the number of reads."""
    img = read_table(spark, sf_dir, "webtools_bridge").select("read_id", F.explode("images").alias("image")).filter("image is not null")
    low = F.lower("image")
    img = img.filter(~low.rlike(_EMPTY) & ~low.rlike(_ENDING))
    return img.groupBy("image").agg(F.min("read_id").alias("read_id"), F.count_distinct("read_id").alias("n_reads"))


def bm25_url_rank(spark: SparkSession, sf_dir: str, k: int = 40) -> DataFrame:
    """Per query the urls of the search results whose words match best."""
    urls = read_table(spark, sf_dir, "serp").select("url").distinct().select(F.col("url").alias("doc"), F.array_join(U.url_words(F.col("url")), " ").alias("text"))
    s = R.bm25(urls, read_table(spark, sf_dir, "query_variants"), "doc", "text", "search_query", k)
    return s.select("query", F.col("doc_id").alias("url"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def seed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falling scores of the first twelve urls of each query, as seeds are given."""
    w = Window.partitionBy("search_query").orderBy("best", "url")
    rows = results(spark, sf_dir).groupBy("search_query", "url").agg(F.min("serp_rank").alias("best"))
    n = rows.groupBy("search_query").agg(F.count("*").alias("n"))
    top = rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= 12).join(n, "search_query")
    return top.select("search_query", "url", (12 - F.floor(9 * (F.col("pos") - 1) / F.col("n"))).cast("long").alias("score"))


def boost_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the variants whose aspect has no living result yet, at least four letters."""
    v = read_table(spark, sf_dir, "query_variants").select("search_query", "query_variant", F.coalesce("aspect", F.lit("core")).alias("aspect"))
    got = results(spark, sf_dir).filter("alive").select("search_query", F.coalesce("aspect", F.lit("core")).alias("aspect")).distinct()
    left = v.join(got, ["search_query", "aspect"], "left_anti")
    return left.select("search_query", F.explode(words(F.col("query_variant"), 4)).alias("term")).distinct()


def source_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of kinds of reads, sizes and failures per way of reading."""
    r = read_table(spark, sf_dir, "webtools_bridge")
    return r.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("n_empty"), F.count("blocked").alias("n_flagged"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


QUERIES = {"image_rows": image_rows, "bm25_url_rank": bm25_url_rank, "seed_scores": seed_scores, "boost_terms": boost_terms, "source_categories": source_categories}

_R = "r AS (SELECT DISTINCT ON (serp_id) * FROM serp)"
_TERMS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_./:#\\-]+'), lambda w: w <> '')"
SQL = {
    "bm25_url_rank": f"""WITH u AS (SELECT DISTINCT url FROM serp), q AS (SELECT DISTINCT search_query AS query FROM query_variants WHERE search_query IS NOT NULL), t AS (SELECT query, unnest(list_distinct({_TERMS.format('query')})) AS term FROM q),
 w AS (SELECT url, list_distinct(list_filter(regexp_split_to_array(lower({_P}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: len(x) >= 3)) AS ws FROM u), d AS (SELECT url, {_TERMS.format("array_to_string(ws, ' ')")} AS tokens FROM w), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
 tf AS (SELECT url, dl, term, count(*) AS tf FROM (SELECT url, len(tokens) AS dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 b AS (SELECT query, url, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM t JOIN df USING (term) JOIN tf USING (term), s GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, url) AS rank FROM b) SELECT query, url, round(score, 6) AS score, rank FROM k WHERE rank <= 40""",
    "image_rows": f"""SELECT image, min(read_id) AS read_id, count(DISTINCT read_id) AS n_reads FROM (SELECT read_id, unnest(images) AS image FROM webtools_bridge) WHERE image IS NOT NULL
 AND NOT regexp_matches(lower(image), '{_EMPTY}') AND NOT regexp_matches(lower(image), '{_ENDING}') GROUP BY 1""",
    "seed_scores": f"""WITH {_R}, g AS (SELECT search_query, url, min(serp_rank) AS best FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY search_query ORDER BY best, url) AS pos, count(*) OVER (PARTITION BY search_query) AS n FROM g)
 SELECT search_query, url, (12 - floor(9.0 * (pos - 1) / n))::BIGINT AS score FROM k WHERE pos <= 12""",
    "boost_terms": f"""WITH {_R}, got AS (SELECT DISTINCT search_query, coalesce(aspect, 'core') AS aspect FROM r WHERE alive), v AS (SELECT search_query, query_variant, coalesce(aspect, 'core') AS aspect FROM query_variants)
 SELECT DISTINCT search_query, term FROM (SELECT search_query, unnest(list_filter(regexp_extract_all(lower(query_variant), '[\\p{{L}}\\p{{N}}_]+'), lambda w: len(w) >= 4)) AS term FROM v ANTI JOIN got USING (search_query, aspect))""",
    "source_categories": "SELECT source, count(*) AS n, count(*) FILTER (coalesce(len(text), 0) = 0) AS n_empty, count(blocked) AS n_flagged, sum(coalesce(len(text), 0))::BIGINT AS chars FROM webtools_bridge GROUP BY 1",
}
