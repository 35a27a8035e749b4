"""Search-result queries: fusion, scores, coverage, categories, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import constants as C
from loomspan.functions import scoring as S
from loomspan.functions import text as X
from loomspan.functions import urls as U
from loomspan.operators import retrieval as R
from loomspan.plans.q_urls import SQL as URL_SQL
from loomspan.plans.q_urls import SUFFIXES, _H, _any, _domain, _in, _suffix_in
from loomspan.session import read_table


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search results, each delivered row once."""
    return read_table(spark, sf_dir, "serp").dropDuplicates(["serp_id"])


def serp_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per query and address: the best rank wins."""
    rows = results(spark, sf_dir).select("search_query", U.normalize_url(F.col("url")).alias("url_norm"), "serp_rank", "serp_id")
    return R.first_wins(rows, ["search_query", "url_norm"], ["serp_rank", "serp_id"])


def serp_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with at least two query words (one for one-word queries) in title and snippet."""
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    q = F.filter(F.split(F.lower(F.trim("search_query")), r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(q, lambda w: low.contains(w)))
    return results(spark, sf_dir).filter(hits >= F.least(F.lit(2), F.size(q))).select("serp_id", hits.cast("long").alias("n_hits"))


def title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query one result per normalized title, the best rank first."""
    rows = results(spark, sf_dir).select("search_query", X.title_normalize(F.col("title")).alias("title_key"), "serp_rank", "serp_id")
    return R.first_wins(rows, ["search_query", "title_key"], ["serp_rank", "serp_id"])


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query and url: reciprocal ranks over the query's variants, and their share of the best."""
    fused = R.reciprocal_rank_fusion(results(spark, sf_dir), ["search_query", "url"], "serp_rank")
    best = fused.groupBy("search_query").agg(F.max("rrf").alias("top"))  # a row per query
    return fused.join(best, "search_query").select("search_query", "url", F.round("rrf", 9).alias("rrf"), "n_lists", F.round(F.col("rrf") / F.col("top"), 9).alias("rrf_norm"))


def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("serp_id", F.round(S.relevance_score(F.col("search_query"), F.col("title"), F.col("snippet")), 6).alias("score"))


def content_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("serp_id", F.round(S.content_relevance(F.col("search_query"), F.col("snippet")), 6).alias("score"))


def authority_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("serp_id", S.authority_factor(F.col("search_query"), F.col("title"), F.col("url"), F.col("snippet")).alias("factor"))


def classify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of every read page and the confidence in it."""
    best = F.array_max(S.category_scores(F.col("url"), F.col("title"), F.col("text")))
    rows = read_table(spark, sf_dir, "webtools_bridge").select("read_id", best.alias("b"))
    weak = (F.col("b.score") < 4) | F.col("b.name").isin("social", "directory")
    return rows.select("read_id", F.when(weak, "other").otherwise(F.col("b.name")).alias("category"), F.when(weak, 0.0).otherwise(F.least(F.col("b.score") / 10, F.lit(1.0))).alias("confidence"))


def variant_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results with their relevance, their strength (relevance x placement) and their rank by it within the query variant that delivered them."""
    rel = S.relevance_score(F.col("search_query"), F.col("title"), F.col("snippet"))
    rows = results(spark, sf_dir).withColumn("rel", rel).withColumn("strength", F.round(F.col("rel") * S.authority_factor(F.col("search_query"), F.col("title"), F.col("url"), F.col("snippet")), 9))
    order = Window.partitionBy("search_query", "query_variant").orderBy(F.desc("strength"), "serp_rank", "serp_id")
    return rows.withColumn("vrank", F.row_number().over(order))


def variant_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_ranks(spark, sf_dir).select("serp_id", "strength", F.col("vrank").cast("long").alias("vrank"))


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query and url the record that came first, its fused rank over the variants and the combined score.

    One aggregate: the first record as a whole (rank, then id), so title,
    snippet, aspect and relevance always belong together.
    """
    record = F.struct("serp_rank", "serp_id", "rel", "alive", F.coalesce("aspect", F.lit("core")).alias("aspect"), "title", "snippet")
    got = variant_ranks(spark, sf_dir).groupBy("search_query", "url").agg(F.sum(1 / (C.RRF_K + F.col("vrank"))).alias("rrf"), F.min(record).alias("m"))
    best = got.groupBy("search_query").agg(F.max("rrf").alias("top"))  # a row per query
    got = got.join(best, "search_query").select("search_query", "url", "rrf", "top", "m.rel", "m.alive", "m.aspect", "m.title", "m.snippet")
    return got.withColumn("score", F.round(S.combine_score(F.col("rel"), F.col("rrf") / F.col("top")), 9))


def final_order(spark: SparkSession, sf_dir: str, k: int = 30) -> DataFrame:
    """The thirty strongest records of each query (relevance x placement), ties to the one delivered first."""
    rows = variant_ranks(spark, sf_dir)
    first = rows.groupBy("search_query", "url").agg(F.min(F.struct("serp_rank", "serp_id", "strength")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("search_query").orderBy(F.desc("m.strength"), "m.serp_rank", "m.serp_id"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= k).select("search_query", "url", F.col("m.strength").alias("strength"), F.col("rank").cast("long").alias("rank"))


def combine_score_topk(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The twenty best living urls of each query."""
    rank = F.row_number().over(Window.partitionBy("search_query").orderBy(F.desc("score"), "url"))
    return combined(spark, sf_dir).filter("alive").withColumn("rank", rank).filter(F.col("rank") <= k).select("search_query", "url", "score", F.col("rank").cast("long").alias("rank"))


def aspect_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query and aspect of its variants: distinct living urls, zeros included."""
    want = read_table(spark, sf_dir, "query_variants").select("search_query", F.coalesce("aspect", F.lit("core")).alias("aspect")).distinct()
    got = results(spark, sf_dir).filter("alive").groupBy("search_query", F.coalesce("aspect", F.lit("core")).alias("aspect")).agg(F.count_distinct("url").alias("n"))
    return want.join(got, ["search_query", "aspect"], "left").select("search_query", "aspect", F.coalesce("n", F.lit(0)).alias("n_pages"))


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a query covered: one result with all its terms, or half of the terms in two results each?"""
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    rows = results(spark, sf_dir).select("search_query", X.words(F.col("search_query")).alias("terms"), low.alias("low"))
    rows = rows.withColumn("hits", F.filter(F.array_distinct("terms"), lambda t: F.col("low").contains(t)))
    full = rows.groupBy("search_query", F.size("terms").alias("n_terms")).agg(F.max(F.size("hits") == F.size(F.array_distinct("terms"))).alias("full"))
    term = rows.select("search_query", F.explode("hits").alias("t")).groupBy("search_query", "t").agg(F.count("*").alias("n")).filter("n >= 2").groupBy("search_query").agg(F.count("*").alias("covered"))
    ok = F.col("full") | (F.coalesce("covered", F.lit(0)) >= F.greatest(F.lit(1), F.floor(F.col("n_terms") / 2)))
    return full.join(term, "search_query", "left").select("search_query", F.coalesce("covered", F.lit(0)).alias("n_covered"), ok.alias("sufficient"))


def suggest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.suggest_terms(results(spark, sf_dir), "search_query", ["title", "snippet"]).select("query", "term", "df", F.col("rank").cast("long").alias("rank"))


def per_domain_cap(spark: SparkSession, sf_dir: str, cap: int = 2) -> DataFrame:
    """At most two urls per query and registrable domain, the best scores first."""
    rows = combined(spark, sf_dir).withColumn("domain", U.registrable_domain(U.host_of(F.col("url")), SUFFIXES))
    rank = F.row_number().over(Window.partitionBy("search_query", "domain").orderBy(F.desc("score"), "url"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= cap).select("search_query", "domain", "url", "score")


def bm25_multi_query(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Every search query against all documents at once: the ten best each."""
    scored = R.bm25(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "query_variants"), "doc_id", "text", "search_query", k)
    return scored.select("query", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


QUERIES = {
    "bm25_multi_query": bm25_multi_query, "serp_first_wins": serp_first_wins, "serp_word_filter": serp_word_filter, "title_dedup": title_dedup, "rrf_fusion": rrf_fusion, "relevance_score": relevance_score,
    "content_relevance": content_relevance, "authority_factor": authority_factor, "classify_content": classify_content, "combine_score_topk": combine_score_topk, "aspect_coverage": aspect_coverage,
    "variant_rank": variant_rank, "final_order": final_order, "coverage_gate": coverage_gate, "suggest_terms": suggest_terms, "per_domain_cap": per_domain_cap,
}

_R = "r AS (SELECT DISTINCT ON (serp_id) * FROM serp)"
_NORM = "trim(regexp_replace(lower(regexp_replace(trim(coalesce(title, '')), '\\s+[|\\-–—·•]\\s*[\\p{L}\\p{N}_ .''’]{1,24}$', '')), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"
_LOW = "lower(coalesce(title, '') || ' ' || coalesce(snippet, ''))"
_QW = "list_slice(list_filter(regexp_split_to_array(lower(trim(search_query)), '\\s+'), lambda w: len(w) > 2), 1, 8)"
_REL = f"CASE WHEN len({_QW}) = 0 THEN 0.0 ELSE len(list_distinct(list_filter({_QW}, lambda w: contains(lower(coalesce(title, '')), w) OR contains(lower(coalesce(snippet, '')), w)))) / len({_QW}) END"
_TN = "regexp_replace(lower(coalesce(snippet, '')), '[^\\p{L}\\p{N}_]+', ' ', 'g')"
_PW = f"list_filter(string_split(trim(regexp_replace(lower(search_query), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda w: len(w) >= 2 AND NOT w IN {_in(C.SCORE_STOP_WORDS)})"
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_./:#\\-]+')"


def _category_sql() -> str:
    parts = []
    for k, (name, signals) in enumerate(C.CATEGORIES.items()):
        score = " + ".join(f"3 * contains(b, '{w}')::INT + 2 * contains(t, '{w}')::INT + contains(u, '{w}')::INT" for w in signals)
        parts.append(f"{{'score': {score}, 'p': {-k}, 'name': '{name}'}}")
    return "[" + ", ".join(parts) + "]"


def _authority_sql() -> str:
    official = " OR ".join(f"(list_contains(tok, '{w}') AND {_suffix_in('h', hs)})" for w, hs in C.OFFICIAL_HOSTS.items())
    some = lambda ws: f"list_has_any(tok, [{_in(ws)[1:-1]}])"
    conflict = lambda p, g: f"(len(regexp_extract_all(q, '{p}', {g})) > 0 AND len(regexp_extract_all(s, '{p}', {g})) > 0 AND NOT list_has_any(regexp_extract_all(q, '{p}', {g}), regexp_extract_all(s, '{p}', {g})))"
    v, y = "\\b(\\d+)\\.(\\d+)(?:\\.(\\d+))?\\b", "\\b(?:19|20)\\d{2}\\b"
    return f"""WITH {_R}, x AS (SELECT serp_id, regexp_replace(lower(trim(search_query)), '\\s+', ' ', 'g') AS q, lower(coalesce(title, '')) AS t, lower(url) AS u, {_H} AS h,
 lower(coalesce(title, '')) || ' ' || lower(coalesce(snippet, '')) || ' ' || lower(url) AS s FROM r), z AS (SELECT *, regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+') AS tok, list_distinct(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)+')) AS a FROM x)
 SELECT serp_id, round((CASE WHEN {official} THEN 1.6 ELSE 1.0 END) * (CASE WHEN {some(C.DOCS_WORDS)} AND {_any('u', C.DOCS_HINTS)} THEN 1.15 ELSE 1.0 END) * (CASE WHEN {some(C.PAPER_WORDS)} AND {_suffix_in('h', C.PAPER_HOSTS)} THEN 1.35 ELSE 1.0 END)
 * (CASE WHEN len(q) > 3 AND contains(t, q) THEN 1.15 ELSE 1.0 END) * pow(0.3, len(list_filter(a, lambda w: NOT (contains(s, w) OR contains(s, replace(w, '-', ' ')) OR contains(s, replace(w, '-', ''))))))
 * (CASE WHEN {conflict(v, 1)} THEN 0.3 ELSE 1.0 END) * (CASE WHEN {conflict(y, 0)} THEN 0.3 ELSE 1.0 END), 3)::DOUBLE AS factor FROM z"""


_VARIANTS = f"""{_R}, aut AS ({_authority_sql()}), rr AS (SELECT *, {_REL} AS rel0 FROM r JOIN aut USING (serp_id)), rv AS (SELECT *, rel0::DOUBLE AS rel, round(rel0::DOUBLE * factor, 9) AS strength FROM rr),
 vr AS (SELECT *, row_number() OVER (PARTITION BY search_query, query_variant ORDER BY strength DESC, serp_rank, serp_id) AS vrank FROM rv)"""
_COMBINED = f"""{_VARIANTS}, f AS (SELECT search_query, url, sum(1.0::DOUBLE / (60 + vrank)) AS rrf, arg_min({{'rel': rel, 'alive': alive, 'aspect': coalesce(aspect, 'core'), 'title': title, 'snippet': snippet}}, (serp_rank, serp_id)) AS m FROM vr GROUP BY ALL),
 c AS (SELECT search_query, url, m.alive AS alive, m.aspect AS aspect, m.title AS title, m.snippet AS snippet, round(0.6::DOUBLE * m.rel + 0.4::DOUBLE * (rrf / max(rrf) OVER (PARTITION BY search_query)), 9) AS score FROM f)"""

SQL = {
    "bm25_multi_query": f"""WITH q AS (SELECT DISTINCT search_query AS query FROM query_variants WHERE search_query IS NOT NULL), t AS (SELECT query, unnest(list_distinct({_TOK.format('query')})) AS term FROM q),
 d AS (SELECT doc_id, {_TOK.format('text')} AS tokens FROM documents), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
 tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 b AS (SELECT query, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM t JOIN df USING (term) JOIN tf USING (term), s GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) SELECT query, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10""",
    "serp_first_wins": f"""WITH {_R}, n AS ({URL_SQL['url_normalize']}), u AS (SELECT DISTINCT * FROM n), x AS (SELECT search_query, url_norm, serp_rank, serp_id, row_number() OVER (PARTITION BY search_query, url_norm ORDER BY serp_rank, serp_id) AS k FROM r JOIN u USING (serp_id))
 SELECT search_query, url_norm, serp_rank, serp_id FROM x WHERE k = 1""",
    "serp_word_filter": f"""WITH {_R}, x AS (SELECT serp_id, {_LOW} AS low, list_filter(regexp_split_to_array(lower(trim(search_query)), '\\s+'), lambda w: w <> '') AS q FROM r)
 SELECT serp_id, len(list_filter(q, lambda w: contains(low, w))) AS n_hits FROM x WHERE len(list_filter(q, lambda w: contains(low, w))) >= least(2, len(q))""",
    "title_dedup": f"""WITH {_R}, x AS (SELECT search_query, {_NORM} AS title_key, serp_rank, serp_id, row_number() OVER (PARTITION BY search_query, {_NORM} ORDER BY serp_rank, serp_id) AS k FROM r)
 SELECT search_query, title_key, serp_rank, serp_id FROM x WHERE k = 1""",
    "rrf_fusion": f"""WITH {_R}, f AS (SELECT search_query, url, sum(1.0 / (60 + serp_rank)) AS rrf, count(*) AS n_lists FROM r GROUP BY ALL)
 SELECT search_query, url, round(rrf::DOUBLE, 9) AS rrf, n_lists, round((rrf / max(rrf) OVER (PARTITION BY search_query))::DOUBLE, 9) AS rrf_norm FROM f""",
    "relevance_score": f"WITH {_R} SELECT serp_id, round(({_REL})::DOUBLE, 6) AS score FROM r",
    "content_relevance": f"""WITH {_R}, x AS (SELECT serp_id, snippet, {_TN} AS t, {_PW} AS pw FROM r), y AS (SELECT *, list_filter(pw, lambda w: len(w) > 2) AS hw FROM x)
 SELECT serp_id, CASE WHEN coalesce(len(snippet), 0) = 0 OR len(hw) = 0 OR (len(pw) >= 2 AND len(list_filter(range(1, len(pw)), lambda i: contains(t, pw[i] || ' ' || pw[i + 1]))) = 0) THEN 0.0
 ELSE round(least(1.0, len(list_filter(hw, lambda w: contains(t, w))) / len(hw) * (CASE WHEN len(snippet) < 200 THEN 0.3 ELSE 1.0 END) + 0.2 * len(list_filter(hw, lambda w: (len(t) - len(replace(t, w, ''))) / len(w) >= 3)) / len(hw)), 6) END::DOUBLE AS score FROM y""",
    "authority_factor": _authority_sql(),
    "classify_content": f"""WITH x AS (SELECT read_id, lower(coalesce(url, '')) AS u, lower(coalesce(title, '')) AS t, lower(coalesce(text, '')) AS b FROM webtools_bridge), y AS (SELECT read_id, list_max({_category_sql()}) AS m FROM x)
 SELECT read_id, CASE WHEN m.score < 4 OR m.name IN ('social', 'directory') THEN 'other' ELSE m.name END AS category, CASE WHEN m.score < 4 OR m.name IN ('social', 'directory') THEN 0.0 ELSE least(m.score / 10, 1.0) END::DOUBLE AS confidence FROM y""",
    "combine_score_topk": f"""WITH {_COMBINED}, k AS (SELECT *, row_number() OVER (PARTITION BY search_query ORDER BY score DESC, url) AS rank FROM c WHERE alive) SELECT search_query, url, score::DOUBLE AS score, rank FROM k WHERE rank <= 20""",
    "aspect_coverage": f"""WITH {_R}, w AS (SELECT DISTINCT search_query, coalesce(aspect, 'core') AS aspect FROM query_variants), g AS (SELECT search_query, coalesce(aspect, 'core') AS aspect, count(DISTINCT url) AS n FROM r WHERE alive GROUP BY ALL)
 SELECT search_query, aspect, coalesce(n, 0) AS n_pages FROM w LEFT JOIN g USING (search_query, aspect)""",
    "variant_rank": f"WITH {_VARIANTS} SELECT serp_id, strength, vrank FROM vr",
    "final_order": f"""WITH {_VARIANTS}, g AS (SELECT search_query, url, arg_min({{'strength': strength, 'a': serp_rank, 'b': serp_id}}, (serp_rank, serp_id)) AS m FROM vr GROUP BY ALL),
 k AS (SELECT search_query, url, m.strength AS strength, row_number() OVER (PARTITION BY search_query ORDER BY m.strength DESC, m.a, m.b) AS rank FROM g) SELECT * FROM k WHERE rank <= 30""",
    "coverage_gate": f"""WITH {_R}, x AS (SELECT search_query, {_LOW} AS low, list_filter(regexp_extract_all(lower(search_query), '[\\p{{L}}\\p{{N}}_]+'), lambda w: len(w) >= 3) AS terms FROM r),
 y AS (SELECT *, list_filter(list_distinct(terms), lambda t: contains(low, t)) AS hits FROM x), f AS (SELECT search_query, len(terms) AS n, max(len(hits) = len(list_distinct(terms))) AS full_hit FROM y GROUP BY ALL),
 h AS (SELECT search_query, t FROM (SELECT search_query, unnest(hits) AS t FROM y) GROUP BY ALL HAVING count(*) >= 2), c AS (SELECT search_query, count(*) AS k FROM h GROUP BY 1)
 SELECT search_query, coalesce(k, 0) AS n_covered, full_hit OR coalesce(k, 0) >= greatest(1, n // 2) AS sufficient FROM f LEFT JOIN c USING (search_query)""",
    "suggest_terms": f"""WITH {_R}, x AS (SELECT search_query AS query, unnest(list_distinct(list_filter(regexp_extract_all({_LOW}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: len(w) >= 3 AND NOT w IN {_in(C.REFINE_STOP_WORDS)}))) AS term, regexp_extract_all(lower(search_query), '[\\p{{L}}\\p{{N}}_]+') AS own FROM r),
 y AS (SELECT query, term, count(*) AS df FROM x WHERE NOT list_contains(own, term) GROUP BY ALL HAVING count(*) >= 2), z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY df DESC, term) AS rank FROM y) SELECT * FROM z WHERE rank <= 3""",
    "per_domain_cap": f"""WITH {_COMBINED}, e AS (SELECT search_query, url, score, string_split({_H}, '.') AS l FROM c), g AS (SELECT *, CASE WHEN len(l) <= 2 OR (array_to_string(l[-2:], '.') NOT IN {_in(SUFFIXES)}) THEN array_to_string(l[-2:], '.') ELSE array_to_string(l[-3:], '.') END AS domain FROM e),
 k AS (SELECT *, row_number() OVER (PARTITION BY search_query, domain ORDER BY score DESC, url) AS rank FROM g) SELECT search_query, domain, url, score::DOUBLE AS score FROM k WHERE rank <= 2""",
}
