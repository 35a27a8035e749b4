"""Text and selection queries: tokens, chunks, facts, links, greedy selectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import scoring as S
from loomspan.functions import text as X
from loomspan.functions import urls as U
from loomspan.operators import chunks as K
from loomspan.operators import selection as L
from loomspan.operators.simjoin import similar_pairs
from loomspan.plans.q_search import _COMBINED, combined
from loomspan.plans.q_state import SQL as STATE_SQL
from loomspan.plans.q_urls import SQL as URL_SQL
from loomspan.plans.q_urls import SUFFIXES, _H, _domain
from loomspan.session import materialize, read_table


def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.retrieval_tokens(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), X.approx_tokens(F.col("text")).alias("approx"))


def doc_top_terms(spark: SparkSession, sf_dir: str, top: int = 10) -> DataFrame:
    """Per source the terms that occur in most of its documents."""
    d = read_table(spark, sf_dir, "documents").filter("source is not null").select("source", F.explode(F.array_distinct(X.words(F.col("text")))).alias("term"))
    df = d.groupBy("source", "term").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("df"), "term"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= top).select("source", "term", "df", F.col("rank").cast("long").alias("rank"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read's text without tags: length, words and fingerprint."""
    t = X.strip_tags(F.coalesce("text", F.lit("")))
    return read_table(spark, sf_dir, "webtools_bridge").select("read_id", F.length(t).cast("long").alias("n_chars"), F.size(F.regexp_extract_all(t, F.lit(X.WORD), 0)).cast("long").alias("n_words"), F.md5(F.encode(t, "utf-8")).alias("md5"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct outgoing links per read, the first handle of each."""
    rows = read_table(spark, sf_dir, "webtools_bridge").select("read_id", F.posexplode("links").alias("pos", "l")).filter("l.url is not null")
    return rows.groupBy("read_id", F.col("l.url").alias("url")).agg(F.min(F.struct("pos", "l.handle", "l.text")).alias("m")).select("read_id", "url", F.col("m.handle").alias("handle"), F.col("m.text").alias("anchor"))


def link_anti_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to addresses never read."""
    reads = read_table(spark, sf_dir, "webtools_bridge")
    known = reads.filter("url is not null").select(U.normalize_url(F.trim("url")).alias("u")).distinct()
    links = reads.select(F.explode("links").alias("l")).select(U.normalize_url(F.trim("l.url")).alias("u")).filter("u is not null").groupBy("u").agg(F.count("*").alias("n_links"))
    return links.join(known, "u", "left_anti").select(F.col("u").alias("url"), "n_links")


def link_expand_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links scored by the words of their page's title: two an anchor hit, one an address hit."""
    rows = read_table(spark, sf_dir, "webtools_bridge").select("read_id", F.array_distinct(X.words(F.col("title"))).alias("q"), F.explode("links").alias("l"))
    anchor, href = F.lower(F.coalesce("l.text", F.lit(""))), F.lower(F.coalesce("l.url", F.lit("")))
    score = 2 * F.size(F.filter("q", lambda w: anchor.contains(w))) + F.size(F.filter("q", lambda w: href.contains(w)))
    return rows.select("read_id", F.col("l.handle").alias("handle"), score.cast("long").alias("score")).filter("score > 0")


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunks(read_table(spark, sf_dir, "documents"))


def fact_sentences(spark: SparkSession, sf_dir: str, top: int = 5) -> DataFrame:
    """Per document the five sentences that say most about its title, and of these the clean ones. Ranked within the row: nothing is shuffled."""
    d = read_table(spark, sf_dir, "documents").filter("text is not null and title is not null").select("doc_id", X.query_words(F.col("title")).alias("q"), F.transform(F.split("text", r"(?<=[.!?])\s+|:\s+"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("s"))
    scored = F.transform("s", lambda x, i: F.struct((-F.round(X.sentence_score(F.col("q"), x), 6)).alias("low"), i.alias("pos"), x.alias("fact")))
    fit = F.filter(scored, lambda x: (F.length(x.fact) > 18) & (F.length(x.fact) < 400) & (x.low <= -0.15))
    best = d.select("doc_id", F.posexplode(F.slice(F.array_sort(fit), 1, top)).alias("k", "f"))
    return best.filter(X.is_clean_fact(F.col("f.fact"))).select("doc_id", F.col("f.fact").alias("fact"), (-F.col("f.low")).alias("score"), (F.col("k") + 1).cast("long").alias("rank"))


def probe_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does each living result's page state its own title? Null where a wall hides the text."""
    reads = read_table(spark, sf_dir, "webtools_bridge")
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    text, claim = flat(F.coalesce("text", F.lit(""))), flat(F.col("title"))
    walled = X.challenge_kind(F.col("text")).isNotNull() | X.is_login_gate(F.col("text"))
    return reads.filter("title is not null").select("read_id", F.when(walled, F.lit(None).cast("boolean")).otherwise((claim != "") & text.contains(claim)).alias("match"))


def running_budget(spark: SparkSession, sf_dir: str, budget: int = 28_000) -> DataFrame:
    """Per query the best urls until their snippets fill the budget; the first always stays.

    A query of any number of urls: the frame grows with the rows and is
    sorted outside memory, no row is dropped before the sum.
    """
    w = Window.partitionBy("search_query").orderBy(F.desc("score"), "url")
    rows = combined(spark, sf_dir).withColumn("pos", F.row_number().over(w)).withColumn("used", F.sum(F.coalesce(F.length("snippet"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.filter((F.col("used") <= budget) | (F.col("pos") == 1)).select("search_query", "url", F.col("used").cast("long").alias("used"))


_COLS = "search_query string, url string, score double, rank int"


def _sets(pdf: pd.DataFrame) -> list[frozenset]:
    import re

    return [frozenset(re.findall(r"[\w./:#-]+", f"{t or ''} {s or ''}".lower())) for t, s in zip(pdf["title"], pdf["snippet"])]


def _best() -> list:
    return [F.desc("score"), "url"]


def _distinct(spark: SparkSession, sf_dir: str, said, threshold: float) -> DataFrame:
    tokens = X.retrieval_tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    return L.distinct_per_query(combined(spark, sf_dir).select("search_query", "url", "score", "title", "snippet"), "search_query", _best(), tokens, said, threshold)


def jaccard_greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results of each query, best first, without those at least 0.85 like a kept one."""
    kept = _distinct(spark, sf_dir, F.concat_ws(" ", F.coalesce("title", F.lit("None")), F.coalesce("snippet", F.lit("None"))), 0.85)
    return kept.select("search_query", "url", "score", F.row_number().over(Window.partitionBy("search_query").orderBy("pos")).alias("rank"))


def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty distinct results of each query, two of a domain before the rest."""
    kept = _distinct(spark, sf_dir, F.coalesce("snippet", F.lit("None")), 0.92).withColumn("domain", U.registrable_domain(U.host_of(F.col("url")), SUFFIXES))
    return L.quota_per_query(kept, "search_query", "domain", 20, 2).select("search_query", "url", "score", "rank")


def _diverse(rows: DataFrame, k: int = 18) -> DataFrame:
    rows = materialize(rows, "diverse")  # read twice: for the bound and for the candidates
    near = L.mmr_candidates(rows, "search_query", _best(), "score", ["aspect", "title", "snippet"], k)
    return L.select_per_query(near, "search_query", _best(), lambda p: L.mmr(p["score"].tolist(), _sets(p), p["aspect"].tolist(), k), _COLS)


def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diverse(combined(spark, sf_dir))


def budget_skip_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.fill_candidates(combined(spark, sf_dir), "search_query", _best(), F.coalesce(F.length("snippet"), F.lit(0)), 1_500, 18)
    return L.select_per_query(rows, "search_query", _best(), lambda p: L.fill_skipping([len(s or "") for s in p["snippet"]], 2_800, 1_500, 18), _COLS)


def saturation_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of each query, best first, that are less than 0.7 like any before, until three in a row are not."""
    kept = L.saturated_per_query(_distinct(spark, sf_dir, None, 0.7), "search_query")
    return kept.select("search_query", "url", "score", F.row_number().over(Window.partitionBy("search_query").orderBy("pos")).alias("rank"))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole texts' words are at least 0.85 alike, each text once, copies as pairs with their first."""
    rows = read_table(spark, sf_dir, "documents")
    pairs = similar_pairs(rows.select("doc_id", X.retrieval_tokens(F.col("text")).alias("t")), "doc_id", "t", 0.85)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


#: What a page must say of its query and how long it must be to count as evidence, and what a pack and a page of it may hold.
MIN_RELEVANCE, MIN_CHARS, PACK_CHARS, PAGE_CHARS, PER_DOMAIN = 0.15, 300, 28_000, 4_000, 6


def compact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence pack of every query.

    Living results that no url rule drops, at most six of a domain, made
    diverse; each with the newest open read of its address; pages that say
    too little of the query or are too short are left out; the rest is packed
    in order, a page that does not fit is skipped and the next one tried.
    Only the picked addresses are looked up among the reads, and only their
    newest read's text is fetched.
    """
    rows = combined(spark, sf_dir).filter(F.col("alive") & (U.disposition(F.col("url")) == "kept")).withColumn("domain", U.registrable_domain(U.host_of(F.col("url")), SUFFIXES))
    capped = rows.withColumn("k", F.row_number().over(Window.partitionBy("search_query", "domain").orderBy(F.desc("score"), "url"))).filter(F.col("k") <= PER_DOMAIN).drop("k", "domain")
    # eighteen rows a query of the settings table
    picked = materialize(_diverse(capped).withColumn("u", U.normalize_url(F.col("url"))), "picked")
    reads = read_table(spark, sf_dir, "webtools_bridge").filter("url is not null and text is not null")
    open_ = X.challenge_kind(F.col("text")).isNull() & ~X.is_login_gate(F.col("text"))
    here = reads.withColumn("u", U.normalize_url(F.trim("url"))).join(F.broadcast(picked.select("u").distinct()), "u", "left_semi").filter(open_)
    newest = materialize(here.groupBy("u").agg(F.max(F.struct("read_at", "read_id")).alias("m")).select("u", F.col("m.read_id").alias("read_id")), "newest")
    texts = reads.select("read_id", "text").join(F.broadcast(newest), "read_id")
    j = picked.join(texts, "u").withColumn("relevance", F.bround(S.content_relevance(F.col("search_query"), F.col("text")), 2)).withColumn("chars", F.length("text"))
    good = j.filter((F.col("relevance") >= MIN_RELEVANCE) & (F.col("chars") >= MIN_CHARS)).select("search_query", "rank", "url", "score", "read_id", "chars", "relevance")
    # a query's pack is eighteen rows at most: the fold over them runs inside the row
    pack = good.groupBy("search_query").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "score", "read_id", "chars", "relevance"))).alias("l"))
    size = lambda x: F.least(x.chars, F.lit(PAGE_CHARS))
    start = F.struct(F.lit(PACK_CHARS).alias("left"), F.filter("l", lambda x: F.lit(False)).alias("out"))
    fold = F.aggregate("l", start, lambda s, x: F.when(size(x) <= s.left, F.struct((s.left - size(x)).alias("left"), F.concat(s.out, F.array(x)).alias("out"))).otherwise(s))
    return pack.select("search_query", F.explode(fold["out"]).alias("x")).select("search_query", "x.*")


def probe_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three windows around the places where a document's text states the third to sixth word of its own title."""
    flat = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    claim = F.array_join(F.slice(F.regexp_extract_all(F.lower("title"), F.lit(X.WORD), 0), 3, 4), " ")
    d = read_table(spark, sf_dir, "documents").filter("text is not null and title is not null").select("doc_id", flat.alias("t"), claim.alias("c")).filter("c <> ''")
    return d.select("doc_id", F.posexplode(X.excerpts(F.col("t"), F.col("c"))).alias("k", "excerpt")).select("doc_id", F.col("k").cast("long").alias("k"), "excerpt")


def evidence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best distinct chunks for its own title, up to 4,000 characters."""
    got = K.evidence_of(read_table(spark, sf_dir, "documents"), "title")
    return got.select("doc_id", F.length("evidence").cast("long").alias("chars"), F.md5(F.encode("evidence", "utf-8")).alias("md5"))


def rank_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ranked_chunks(read_table(spark, sf_dir, "documents"), "title")


QUERIES = {
    "deep_research": compact_evidence, "probe_excerpts": probe_excerpts, "evidence_chunks": evidence_chunks, "rank_chunks": rank_chunks, "tokenize_stats": tokenize_stats, "doc_top_terms": doc_top_terms, "page_text": page_text, "page_links": page_links, "link_anti_known": link_anti_known, "link_expand_score": link_expand_score,
    "chunk_text": chunk_text, "fact_sentences": fact_sentences, "probe_claim": probe_claim, "running_budget_stop": running_budget, "jaccard_greedy_dedup": jaccard_greedy_dedup, "mmr_select": mmr_select, "quota_fill": quota_fill,
    "budget_skip_fill": budget_skip_fill, "saturation_stop": saturation_stop, "jaccard_pairs": jaccard_pairs,
}

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_./:#\\-]+')"
_STRIP = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_LINKS = "(SELECT read_id, title, unnest(links) AS l, unnest(range(1, len(links) + 1)) AS pos FROM webtools_bridge)"
_COMB = f"WITH RECURSIVE {_COMBINED}"
_SPACE = "[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x1c-\\x1f]"
_BEST = "row_number() OVER (PARTITION BY search_query ORDER BY score DESC, url)"
_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(snippet, '')), '[\\p{L}\\p{N}_./:#\\-]+'))"


def _greedy(said: str, threshold: float) -> str:
    """CTEs: p has every position, nb its earlier positions that are too like it; d the kept positions."""
    return f"""{_COMB}, p AS MATERIALIZED (SELECT *, {_BEST} AS pos, {_TOKENS} AS t, {said} AS said FROM c),
 n AS MATERIALIZED (SELECT b.search_query, b.pos, list(a.pos) FILTER (CASE WHEN len(b.t) = 0 THEN a.said = b.said ELSE len(a.t) > 0 AND len(list_intersect(a.t, b.t)) >= {threshold} * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END) AS nb
   FROM p b LEFT JOIN p a ON a.search_query = b.search_query AND a.pos < b.pos GROUP BY ALL),
 g AS (SELECT DISTINCT search_query, 0::BIGINT AS pos, []::BIGINT[] AS kept FROM p UNION ALL SELECT g.search_query, n.pos, CASE WHEN list_has_any(g.kept, coalesce(n.nb, [])) THEN g.kept ELSE list_append(g.kept, n.pos) END FROM g JOIN n ON n.search_query = g.search_query AND n.pos = g.pos + 1),
 d AS (SELECT search_query, unnest(arg_max(kept, pos)) AS pos FROM g GROUP BY 1)"""


def _mmr(rows: str, k: int = 18) -> str:
    """CTEs: p the rows of ``rows`` in order, sim their similarities to all rows of the query, z the chosen positions with their rank."""
    return f"""p AS MATERIALIZED (SELECT *, {_BEST} AS pos, {_TOKENS} AS t FROM {rows}),
 n AS MATERIALIZED (SELECT b.search_query, b.pos, any_value(b.score) AS score, any_value(b.aspect) AS aspect, list(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) END ORDER BY a.pos) AS sim
   FROM p b JOIN p a ON a.search_query = b.search_query GROUP BY b.search_query, b.pos),
 z AS (SELECT DISTINCT search_query, 0 AS k, []::BIGINT[] AS chosen, []::VARCHAR[] AS seen FROM p UNION ALL
   SELECT z.search_query, z.k + 1, list_append(any_value(z.chosen), arg_max(n.pos, (v, -n.pos))), list_append(any_value(z.seen), arg_max(n.aspect, (v, -n.pos))) FROM (SELECT * FROM z WHERE k < {k}) z JOIN n ON n.search_query = z.search_query AND NOT list_contains(z.chosen, n.pos),
   LATERAL (SELECT CASE WHEN n.aspect = '' THEN 0.0 ELSE 0.15::DOUBLE * greatest(0.0, 1 - len(list_filter(z.seen, lambda x: x = n.aspect)) / 2.0::DOUBLE) END AS bonus) w,
   LATERAL (SELECT CASE WHEN len(z.chosen) = 0 THEN n.score + bonus ELSE 0.7::DOUBLE * n.score + bonus - (1 - 0.7::DOUBLE) * list_max(list_transform(z.chosen, lambda x: n.sim[x])) END AS v) y GROUP BY z.search_query, z.k),
 m AS (SELECT search_query, arg_max(chosen, k) AS chosen FROM z GROUP BY 1), o AS (SELECT search_query, unnest(chosen) AS pos, unnest(range(1, len(chosen) + 1)) AS rank FROM m),
 picked AS (SELECT search_query, url, score, rank::INT AS rank FROM o JOIN p USING (search_query, pos))"""


_QWORDS = "list_slice(list_filter(regexp_split_to_array(lower(trim(title)), '\\s+'), lambda w: len(w) > 2), 1, 8)"
_SNIP = "snippet"
_NORM_READS = URL_SQL["url_normalize"]


def _normalized(source: str) -> str:
    """(url, u) of the urls of ``source``."""
    return _NORM_READS.replace("SELECT serp_id,", "SELECT url,").replace("AS url_norm FROM serp", f"AS u FROM {source}")


_REL_TEXT = X.content_relevance_sql("search_query", "text")

SQL = {
    "tokenize_stats": f"SELECT doc_id, len({_TOK}) AS n_tokens, len(list_distinct({_TOK})) AS n_distinct, greatest(1, len(coalesce(text, '')) // 4) AS approx FROM documents",
    "doc_top_terms": """WITH d AS (SELECT source, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: len(w) >= 3))) AS term FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
 f AS (SELECT source, term, count(*) AS df FROM d GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY df DESC, term) AS rank FROM f) SELECT * FROM k WHERE rank <= 10""",
    "page_text": f"SELECT read_id, len({_STRIP}) AS n_chars, len(regexp_extract_all({_STRIP}, '[\\p{{L}}\\p{{N}}_]+')) AS n_words, md5({_STRIP}) AS md5 FROM webtools_bridge",
    "page_links": f"SELECT read_id, url, handle, anchor FROM (SELECT read_id, l.url AS url, l.handle AS handle, l.text AS anchor, row_number() OVER (PARTITION BY read_id, l.url ORDER BY pos) AS k FROM {_LINKS} WHERE l.url IS NOT NULL) WHERE k = 1",
    "link_expand_score": f"""WITH x AS (SELECT read_id, l.handle AS handle, list_distinct(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: len(w) >= 3)) AS q, lower(coalesce(l.text, '')) AS a, lower(coalesce(l.url, '')) AS h FROM {_LINKS})
 SELECT read_id, handle, 2 * len(list_filter(q, lambda w: contains(a, w))) + len(list_filter(q, lambda w: contains(h, w))) AS score FROM x WHERE 2 * len(list_filter(q, lambda w: contains(a, w))) + len(list_filter(q, lambda w: contains(h, w))) > 0""",
    "running_budget_stop": f"""{_COMB}, k AS (SELECT search_query, url, sum(coalesce(len(snippet), 0)) OVER w AS used, row_number() OVER w AS pos FROM c
 WINDOW w AS (PARTITION BY search_query ORDER BY score DESC, url ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT search_query, url, used::BIGINT AS used FROM k WHERE used <= 28000 OR pos = 1""",
    "jaccard_greedy_dedup": _greedy("coalesce(title, 'None') || ' ' || coalesce(snippet, 'None')", 0.85) + " SELECT search_query, url, score, row_number() OVER (PARTITION BY search_query ORDER BY pos) AS rank FROM d JOIN p USING (search_query, pos)",
    "quota_fill": _greedy("coalesce(snippet, 'None')", 0.92) + f""", e AS (SELECT search_query, url, score, pos, {_H} AS h FROM d JOIN p USING (search_query, pos)), q AS (SELECT *, row_number() OVER (PARTITION BY search_query, {_domain('h')} ORDER BY pos) > 2 AS late FROM e),
 k AS (SELECT *, row_number() OVER (PARTITION BY search_query ORDER BY late, pos) AS rank FROM q) SELECT search_query, url, score, rank FROM k WHERE rank <= 20""",
    "saturation_stop": _greedy("''", 0.7) + """, e AS (SELECT * FROM d JOIN p USING (search_query, pos) WHERE len(t) > 0), i AS (SELECT *, pos - lag(pos, 1, 0) OVER (PARTITION BY search_query ORDER BY pos) - 1 >= 3 AS idle FROM e),
 k AS (SELECT *, bool_or(idle) OVER (PARTITION BY search_query ORDER BY pos ROWS UNBOUNDED PRECEDING) AS over FROM i) SELECT search_query, url, score, row_number() OVER (PARTITION BY search_query ORDER BY pos) AS rank FROM k WHERE NOT over""",
    "mmr_select": f"{_COMB}, {_mmr('c')} SELECT search_query, url, score, rank FROM picked",
    "budget_skip_fill": f"""{_COMB}, p AS (SELECT *, {_BEST} AS pos, least(coalesce(len(snippet), 0), 1500) AS size FROM c),
 g AS (SELECT DISTINCT search_query, 0::BIGINT AS pos, 2800::BIGINT AS room, []::BIGINT[] AS kept FROM p UNION ALL SELECT g.search_query, p.pos, CASE WHEN len(kept) < 18 AND size <= room THEN room - size ELSE room END, CASE WHEN len(kept) < 18 AND size <= room THEN list_append(kept, p.pos) ELSE kept END FROM g JOIN p ON p.search_query = g.search_query AND p.pos = g.pos + 1),
 d AS (SELECT search_query, unnest(kept) AS pos, unnest(range(1, len(kept) + 1)) AS rank FROM (SELECT search_query, arg_max(kept, pos) AS kept FROM g GROUP BY 1)) SELECT search_query, url, score, rank FROM d JOIN p USING (search_query, pos)""",
    "deep_research": f"""{_COMB}, kept AS (SELECT c.*, {_H} AS h FROM c WHERE alive AND {URL_SQL['url_disposition_counts'].split(' SELECT ', 1)[1].split(' AS disposition')[0]} = 'kept'),
 dom AS (SELECT *, row_number() OVER (PARTITION BY search_query, {_domain('h')} ORDER BY score DESC, url) AS dk FROM kept), capped AS (SELECT * FROM dom WHERE dk <= {PER_DOMAIN}), {_mmr('capped')},
 nu AS ({_normalized('(SELECT DISTINCT trim(url) AS url FROM webtools_bridge WHERE url IS NOT NULL UNION SELECT url FROM picked)')}),
 rd AS (SELECT u, read_id, read_at, text FROM webtools_bridge w JOIN nu ON trim(w.url) = nu.url WHERE text IS NOT NULL AND {STATE_SQL['page_block_type'].split('SELECT ', 1)[1].split(' AS by_text')[0]} IS NULL),
 nw AS (SELECT u, arg_max({{'read_id': read_id, 'text': text}}, (read_at, read_id)) AS m FROM rd GROUP BY 1), j AS (SELECT search_query, rank, picked.url, score, m.read_id AS read_id, m.text AS text FROM picked JOIN nu ON nu.url = picked.url JOIN nw USING (u)),
 v AS (SELECT *, round_even({_REL_TEXT}, 2) AS relevance, len(text) AS chars FROM j), w AS (SELECT *, row_number() OVER (PARTITION BY search_query ORDER BY rank) AS k, least(len(text), {PAGE_CHARS}) AS size FROM v WHERE relevance >= {MIN_RELEVANCE} AND chars >= {MIN_CHARS}),
 fill AS (SELECT DISTINCT search_query, 0::BIGINT AS k, {PACK_CHARS}::BIGINT AS room, false AS hit FROM w UNION ALL SELECT w.search_query, w.k, CASE WHEN size <= room THEN room - size ELSE room END, size <= room FROM fill JOIN w ON w.search_query = fill.search_query AND w.k = fill.k + 1)
 SELECT search_query, rank, url, score, read_id, chars, relevance FROM w JOIN fill USING (search_query, k) WHERE hit""",
    "jaccard_pairs": f"""WITH d AS (SELECT doc_id, list_sort(list_distinct({_TOK})) AS t FROM documents), e AS (SELECT t, min(doc_id) AS rep, list(doc_id) AS ids FROM d WHERE len(t) > 0 GROUP BY 1),
 l AS (SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.t, b.t)) AS k, len(a.t) AS n, len(b.t) AS m FROM e a JOIN e b ON a.rep < b.rep AND len(a.t) >= 0.85 * len(b.t) AND len(b.t) >= 0.85 * len(a.t))
 SELECT a, b, round(k::DOUBLE / (n + m - k), 6) AS similarity FROM l WHERE k::DOUBLE / (n + m - k) >= 0.85 UNION ALL SELECT rep, i, 1.0 FROM (SELECT rep, unnest(ids) AS i FROM e) WHERE i <> rep""",
    "fact_sentences": f"""WITH d AS (SELECT doc_id, {_QWORDS} AS q, list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|:\\s+'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS s FROM documents WHERE text IS NOT NULL AND title IS NOT NULL),
 s AS (SELECT doc_id, q, unnest(s) AS fact, unnest(range(1, len(s) + 1)) AS pos FROM d), k AS (SELECT *, round({X.sentence_score_sql('q', 'fact')}, 6) AS score FROM s WHERE len(fact) > 18 AND len(fact) < 400),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM k WHERE score >= 0.15) SELECT doc_id, fact, score, rank FROM r WHERE rank <= 5 AND {X.clean_fact_sql('fact')}""",
    "probe_excerpts": f"""WITH RECURSIVE d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, array_to_string(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+')[3:6], ' ') AS c FROM documents WHERE text IS NOT NULL AND title IS NOT NULL), e AS (SELECT * FROM d WHERE c <> ''),
 h AS (SELECT doc_id, t, c, 0::BIGINT AS k, strpos(t, c)::BIGINT AS hit FROM e UNION ALL SELECT doc_id, t, c, k + 1, CASE WHEN strpos(substr(t, hit + len(c)), c) = 0 THEN 0 ELSE hit + len(c) - 1 + strpos(substr(t, hit + len(c)), c) END FROM h WHERE hit > 0 AND k < 2)
 SELECT doc_id, k, trim(substr(t, greatest(hit - 110, 1), len(c) + 110 + least(hit - 1, 110))) AS excerpt FROM h WHERE hit > 0""",
    "chunk_text": f"""WITH RECURSIVE s AS (SELECT doc_id, unnest(ps) AS p0, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\n{{2,}}') AS ps FROM documents WHERE text IS NOT NULL)),
 q AS (SELECT doc_id, i, regexp_replace(p0, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS p FROM s), o AS (SELECT * FROM q WHERE p <> ''),
 f AS (SELECT doc_id, i, p, len(p) > 2000 AS big, CASE WHEN len(p) > 2000 THEN list_filter(list_transform(regexp_split_to_array(regexp_replace(p, '([.!?…]){_SPACE}+', '\\1' || chr(1), 'g'), '\\x01|\\n+'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') ELSE [p] END AS us FROM o),
 u AS (SELECT doc_id, big, x, j = 1 AS fst, j = n AS lst, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM (SELECT doc_id, i, big, len(us) AS n, unnest(us) AS x, unnest(range(1, len(us) + 1)) AS j FROM f)),
 g AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, ''::VARCHAR AS part, NULL::VARCHAR AS e1, NULL::VARCHAR AS e2 FROM u UNION ALL SELECT g.doc_id, u.k,
   CASE WHEN big AND lst THEN '' WHEN big AND fst THEN x WHEN big AND len(part) + len(x) + 1 > 2000 THEN ltrim(right(part, 320) || ' ' || x) WHEN big THEN part || ' ' || x WHEN part = '' OR len(part) + 2 + len(x) > 2000 THEN x ELSE part || chr(10) || chr(10) || x END,
   CASE WHEN big AND fst THEN nullif(part, '') WHEN big AND len(part) + len(x) + 1 > 2000 THEN part WHEN NOT big AND part <> '' AND len(part) + 2 + len(x) > 2000 THEN part END,
   CASE WHEN big AND lst THEN CASE WHEN fst THEN x WHEN len(part) + len(x) + 1 > 2000 THEN ltrim(right(part, 320) || ' ' || x) ELSE part || ' ' || x END END FROM g JOIN u ON u.doc_id = g.doc_id AND u.k = g.k + 1),
 l AS (SELECT doc_id, max(k) AS k FROM g GROUP BY 1), c AS (SELECT doc_id, k, 1 AS w, e1 AS text FROM g WHERE e1 IS NOT NULL UNION ALL SELECT doc_id, k, 2, e2 FROM g WHERE e2 IS NOT NULL UNION ALL SELECT doc_id, k, 3, part FROM g JOIN l USING (doc_id, k) WHERE part <> '')
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, w) - 1)::INT AS chunk_id, text, greatest(1, len(text) // 4)::INT AS tokens FROM c""",
    "probe_claim": f"""WITH x AS (SELECT read_id, {STATE_SQL['page_block_type'].split('SELECT ', 1)[1].split(' AS by_text')[0]} AS wall, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS c
 FROM webtools_bridge WHERE title IS NOT NULL) SELECT read_id, CASE WHEN wall IS NULL THEN c <> '' AND contains(t, c) END AS match FROM x""",
    "link_anti_known": f"""WITH n AS ({URL_SQL['url_normalize'].replace('serp_id', 'k').replace('FROM serp', "FROM (SELECT DISTINCT trim(url) AS url, trim(url) AS k FROM (SELECT url FROM webtools_bridge UNION ALL SELECT l.url FROM " + _LINKS + ") WHERE url IS NOT NULL)")}),
 a AS (SELECT trim(l.url) AS k FROM {_LINKS}), b AS (SELECT url_norm AS url, count(*) AS n_links FROM a JOIN n USING (k) GROUP BY 1), known AS (SELECT url_norm FROM n JOIN (SELECT DISTINCT trim(url) AS k FROM webtools_bridge WHERE url IS NOT NULL) USING (k))
 SELECT url, n_links FROM b WHERE url NOT IN (SELECT url_norm FROM known)""",
}
