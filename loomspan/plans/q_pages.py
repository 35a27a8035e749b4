"""Queries over bodies, candidates and images, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import constants as C
from loomspan.functions import pages as P
from loomspan.functions import text as X
from loomspan.functions import urls as U
from loomspan.operators import hamming as M
from loomspan.operators import selection as L
from loomspan.plans.q_search import _COMBINED, _R, combined, results
from loomspan.plans.q_search import SQL as SEARCH_SQL
from loomspan.plans.q_search import classify_content
from loomspan.plans.q_urls import SQL as URL_SQL
from loomspan.plans.q_urls import SUFFIXES, _H, _N, _P, _Q, _S, _any, _domain, _in, _suffix_in
from loomspan.session import read_table


def fetch_block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of checks and texts of reads by what blocks them, beside the flag they carry."""
    checks = read_table(spark, sf_dir, "fetch_log").dropDuplicates(["check_id"]).select(F.lit("check").alias("kind"), F.col("blocked").cast("string").alias("flag"), F.col("body").alias("b"))
    reads = read_table(spark, sf_dir, "webtools_bridge").select(F.lit("read").alias("kind"), F.col("blocked").alias("flag"), F.col("text").alias("b"))
    b = F.col("b")
    return checks.union(reads).groupBy("kind", "flag", P.block_type(b).alias("code"), P.is_blocked(b).alias("blocks"), P.is_valid_content(b).alias("valid")).agg(F.count("*").alias("n"))


def bot_challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose title or text words a robot check, and whether a reader service says so."""
    body = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\\nWarning: target page requires CAPTCHA\\n"), F.coalesce("text", F.lit("")))
    r = read_table(spark, sf_dir, "webtools_bridge").select("read_id", P.is_bot_challenge(F.col("title"), F.col("text")).alias("tagged"), P.is_reader_antibot(body).alias("reader"))
    return r.filter("tagged or reader")


def clean_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read's text without furniture and end matter: its lines, length and fingerprint."""
    t = P.clean_content(F.col("text"))
    return read_table(spark, sf_dir, "webtools_bridge").select("read_id", t.alias("t")).select("read_id", F.length("t").cast("long").alias("chars"), F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\\n"))).cast("long").alias("n_lines"), F.md5(F.encode("t", "utf-8")).alias("md5"))


#: A made-up stuffed address for each query.
def _stuffed(query: Column, url: Column) -> Column:
    return F.concat(U.scheme_of(url), F.lit("://"), U.netloc_of(url), F.lit("/"), F.replace(F.lower(F.trim(query)), F.lit(" "), F.lit("+")))


def candidate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the candidate rules say of every result, and of its host's stuffed address for the query."""
    q, u, t = F.col("search_query"), F.col("url"), F.col("title")
    return results(spark, sf_dir).select(
        "serp_id", P.is_likely_content(u).alias("content"), P.is_keyword_soup(u, q).alias("soup"), P.is_keyword_soup(_stuffed(q, u), q).alias("stuffed"), P.has_query_phrase(F.col("snippet"), q).alias("phrase"),
        P.strict_match(u, t, q).alias("strict"), P.matches_query(u, t, q).alias("matches"), P.is_gallery(u, t).alias("gallery"), P.is_pdf_url(F.concat(u, F.lit(".PDF"))).alias("pdf"), P.referrer(u).alias("referrer"),
    )


def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose page every result is, on its own host and as if its path were on a platform."""
    moved = F.concat(F.lit("https://someone.tumblr.com"), U.path_of(F.col("url")))
    return results(spark, sf_dir).select("serp_id", P.dedup_key(F.col("url"), SUFFIXES).alias("own"), P.dedup_key(moved, SUFFIXES).alias("platform"))


def level_two_cap(spark: SparkSession, sf_dir: str, cap: int = 2) -> DataFrame:
    """Links of the twenty best pages of each query that may be followed: unseen, no advertising, junk or service page, and with what level one already has at most two of a key."""
    first = combined(spark, sf_dir).filter("alive").withColumn("k", F.row_number().over(Window.partitionBy("search_query").orderBy(F.desc("score"), "url"))).filter(F.col("k") <= 20).select("search_query", U.normalize_url(F.col("url")).alias("u"), "k")
    links = read_table(spark, sf_dir, "webtools_bridge").filter("url is not null").select(U.normalize_url(F.trim("url")).alias("u"), F.posexplode("links").alias("pos", "l")).select("u", "pos", F.trim("l.url").alias("link"), F.col("l.text").alias("anchor")).filter("link is not null")
    c = F.col("link")
    cand = first.join(links, "u").filter(~U.is_junk_url(c) & ~U.skip_crawl(c) & ~U.is_ad_url(c) & ~U.is_video_url(c)).filter(P.matches_query(c, F.col("anchor"), F.col("search_query")))
    cand = cand.groupBy("search_query", "link").agg(F.min(F.struct("k", "pos")).alias("m")).withColumn("n", U.normalize_url(c))
    seen = combined(spark, sf_dir).select("search_query", U.normalize_url(F.col("url")).alias("n")).distinct()
    new = cand.join(seen, ["search_query", "n"], "left_anti").withColumn("key", P.dedup_key(c, SUFFIXES))
    have = first.withColumn("key", P.dedup_key(F.col("u"), SUFFIXES)).groupBy("search_query", "key").agg(F.count("*").alias("have"))
    rank = F.row_number().over(Window.partitionBy("search_query", "key").orderBy("m.k", "m.pos", "link"))
    return new.join(have, ["search_query", "key"], "left").withColumn("r", rank + F.coalesce("have", F.lit(0))).filter(F.col("r") <= cap).select("search_query", "link", "key", F.col("r").cast("long").alias("r"))


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each query from its pages' links and from the other results of the same hosts, a link before a result."""
    linked = level_two_cap(spark, sf_dir).select("search_query", F.col("link").alias("url"), F.lit(0).alias("source"))
    other = results(spark, sf_dir).filter("not alive").select("search_query", "url", F.lit(1).alias("source"))
    return linked.union(other).groupBy("search_query", "url").agg(F.min("source").cast("long").alias("source"))


def full_size_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image address, and its thumbnail's, brought to full size."""
    i = read_table(spark, sf_dir, "webtools_bridge").select(F.explode("images").alias("image")).filter("image is not null").distinct()
    thumb = F.array(F.col("image"), F.regexp_replace("image", r"/img/(\d+)\.", "/img/thumbs/$1-150x150."), F.concat("image", F.lit("?w=200&h=100")), F.regexp_replace("image", r"(\d+)\.(\w+)$", "$1_s.$2"))
    return i.select(F.explode(thumb).alias("image")).distinct().select("image", P.full_size(F.col("image")).alias("full"))


def images_of_relevant_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, each once a query, whose page is a living result of relevance at least 0.5."""
    good = combined(spark, sf_dir).filter("alive and rel >= 0.5").select("search_query", U.normalize_url(F.col("url")).alias("u")).distinct()
    shown = read_table(spark, sf_dir, "webtools_bridge").filter("url is not null").select(U.normalize_url(F.trim("url")).alias("u"), F.explode("images").alias("image")).filter("image is not null").distinct()
    return shown.join(good, "u").select("search_query", "image").distinct()


def category_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category the five surest reads and the number of reads."""
    rows = classify_content(spark, sf_dir)
    n = rows.groupBy("category").agg(F.count("*").alias("n"))  # a row per category
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("confidence"), "read_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= 5).join(F.broadcast(n), "category").select("category", "read_id", "confidence", F.col("rank").cast("long").alias("rank"), "n")


def find_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in which the last word of their query stands in title, snippet or url."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.coalesce("url", F.lit(""))))
    return results(spark, sf_dir).filter(hay.contains(F.element_at(F.split(F.lower(F.trim("search_query")), r"\s+"), -1))).select("serp_id")


def image_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the images of each read would add for a visual query, its links counted as images too."""
    n = F.size(F.coalesce("images", F.array().cast("array<string>"))) + F.size(F.coalesce("links", F.array().cast("array<struct<handle:string,url:string,text:string>>")))
    return read_table(spark, sf_dir, "webtools_bridge").select("read_id", F.round(P.image_bonus(n, P.is_gallery(F.col("url"), F.col("title"))), 6).alias("bonus"))


def fingerprint_pairs(spark: SparkSession, sf_dir: str, most: int = 8) -> DataFrame:
    """Vectors whose difference hashes (is a value below the next one?) are at most eight of 63 bits apart, among them two altered copies of each (three and nine bits)."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    bits = F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s * 2 + (F.element_at(e, i) < F.element_at(e, i + 1)).cast("long"))
    own = read_table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.size("embedding") >= 64, bits).alias("fp"))
    near = F.explode(F.array(*[F.struct((F.col("vec_id") * 3 + k).alias("vec_id"), F.col("fp").bitwiseXOR(m).alias("fp")) for k, m in enumerate((0, 7, 511))]))
    rows = own.select(near.alias("x")).select("x.*")
    got = M.hamming_pairs(rows, "vec_id", "fp", most)
    return got.select("a", "b", F.col("distance").cast("long").alias("distance"))


def fallback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most eighty results of each query: best first, without those 0.85 like one before that stayed, then the first six of a domain."""
    tokens = F.regexp_extract_all(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))), F.lit(r"[a-zA-Z0-9_./:#-]+"), 0)
    rows = combined(spark, sf_dir).filter("alive").select("search_query", "url", "score", "title", "snippet").withColumn("domain", U.registrable_domain(U.host_of(F.col("url")), SUFFIXES))
    kept = L.distinct_per_query(rows, "search_query", [F.desc("score"), "url"], tokens, F.coalesce("snippet", F.lit("")), 0.85)
    few = kept.withColumn("k", F.row_number().over(Window.partitionBy("search_query", "domain").orderBy("pos"))).filter(F.col("k") <= 6)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("search_query").orderBy("pos"))).filter(F.col("rank") <= 80).select("search_query", "url", "score", F.col("rank").cast("long").alias("rank"))


QUERIES = {
    "fetch_block_types": fetch_block_types, "bot_challenges": bot_challenges, "clean_content": clean_content, "candidate_flags": candidate_flags, "dedup_keys": dedup_keys, "level_two_cap": level_two_cap, "candidate_union": candidate_union,
    "full_size_images": full_size_images, "images_of_relevant_pages": images_of_relevant_pages, "category_top5": category_top5, "find_terms": find_terms, "image_bonus": image_bonus, "fingerprint_pairs": fingerprint_pairs, "fallback_filter": fallback_filter,
}


def _has(text: str, *words: str) -> str:
    return _any(text, words)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BLOCKS = " OR ".join([_any("l", P.BLOCK_PHRASES), *(f"(contains(l, '{w}') AND {_any('l', o)})" for w, o in P.BLOCK_PAIRS)])
_LOGINS = " + ".join(f"contains(l, '{m}')::INT" for m in C.LOGIN_MARKERS)
_CODE = f"""CASE WHEN b IS NULL OR b = '' THEN 'unknown' WHEN {_any('l', P.AWS_WAF)} THEN 'aws_waf' WHEN {_any('l', P.CLOUDFLARE)} THEN 'cloudflare' WHEN contains(l, 'recaptcha') AND {_has('l', 'g-recaptcha', 'verify')} THEN 'recaptcha' WHEN contains(l, 'captcha') THEN 'captcha'
 WHEN {_LOGINS} >= 2 AND len(b) < 20000 THEN 'login' WHEN {_has('l', 'access denied', '403 forbidden')} THEN 'access_denied' WHEN contains(l, '429 too many') THEN 'rate_limited' WHEN contains(l, '503 service unavailable') THEN 'service_unavailable' WHEN {_any('l', P.JS_REQUIRED)} THEN 'js_required'
 WHEN contains(l, 'enable cookies') THEN 'cookies_required' WHEN {_any('l', P.REGIONAL)} THEN 'regional_block' ELSE 'unknown' END"""
_LINES = "list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
_QW = "list_filter(regexp_split_to_array(lower(trim(search_query)), '\\s+'), lambda w: {0})"
_HAY = "lower(coalesce(url, '') || ' ' || coalesce(title, ''))"


def _soup(path: str) -> str:
    t = f"list_filter(list_transform(string_split({path}, '+'), lambda x: regexp_replace(x, '^[/ ]+|[/ ]+$', '', 'g')), lambda x: x <> '')"
    w = "list_distinct(regexp_extract_all(lower(search_query), '[a-zа-яё]{3,}'))"
    hits = f"len(list_filter({t}, lambda x: list_contains({w}, lower(x))))"
    return f"(contains({path}, '+') AND len({w}) >= 2 AND len({t}) >= 2 AND CASE WHEN len({t}) = 2 THEN {hits} = 2 ELSE {hits} >= greatest(2, len({t}) // 2) END)"


def _normal(column: str, source: str) -> str:
    """(raw, u): the normalized form of every trimmed address of ``column`` in ``source``."""
    return URL_SQL["url_normalize"].replace("SELECT serp_id,", "SELECT url AS raw,").replace("AS url_norm FROM serp", f"AS u FROM (SELECT DISTINCT {column} AS url FROM {source})")


def _skip(u: str) -> str:
    s, n, p, q, h = (x.replace("url", u) for x in (_S, _N, _P, _Q, _H))
    return f"""(CASE WHEN {s} = '' OR {n} = '' THEN true ELSE regexp_matches(lower({p}), '\\.(?:{"|".join(C.FILE_ENDINGS)})$') OR {_suffix_in(h, C.AD_HOSTS)} OR {_any(f'lower({u})', C.AD_NETWORKS)} OR list_has_any(string_split(lower({p}), '/'), [{_in(C.SKIP_SEGMENTS)[1:-1]}])
 OR ({q} <> '' AND len(list_filter(string_split({q}, '&'), lambda p: NOT lower(split_part(p, '=', 1)) IN {_in(C.REDIRECT_KEYS)})) = 0) END OR {_any(f'lower({u})', C.JUNK_PATTERNS)} OR {_any(f'lower({u})', C.VIDEO_PATTERNS)}
 OR list_has_any(regexp_split_to_array(lower({n} || '/' || {p}), '[^\\p{{L}}\\p{{N}}_]+'), [{_in(w + x for w in C.AD_WORDS for x in ('', 's'))[1:-1]}]))"""


def _matches(url: str, title: str) -> str:
    w = _QW.format("len(w) >= 3")
    return f"(len({w}) = 0 OR len(list_filter({w}, lambda w: contains(lower(coalesce({url}, '') || ' ' || coalesce({title}, '')), w))) > 0 OR len(trim(coalesce({title}, ''))) >= 30)"


_UP = "image"
for _pattern, _target, _host in P.UPGRADES:
    _flags = "gi" if _pattern.startswith("(?i)") else "g"
    _step = f"regexp_replace({_UP}, {_q(_pattern.removeprefix('(?i)'))}, {_q(_target.replace('$', chr(92)))}, '{_flags}')"
    _UP = _UP if _host else _step  # no image of the tables lies on a host with steps of its own

_LEVEL = f"""n1 AS ({_normal('url', 'c')}), n2 AS ({_normal('trim(x.url)', '(SELECT unnest(links) AS x FROM webtools_bridge) WHERE x.url IS NOT NULL')}), n3 AS ({_normal('trim(url)', 'webtools_bridge WHERE url IS NOT NULL')}),
 t AS (SELECT search_query, u, row_number() OVER (PARTITION BY search_query ORDER BY score DESC, url) AS k FROM c JOIN n1 ON n1.raw = c.url WHERE alive), one AS (SELECT * FROM t WHERE k <= 20),
 li AS (SELECT trim(url) AS raw, trim(x.url) AS link, x.text AS anchor, pos FROM (SELECT url, unnest(links) AS x, unnest(range(len(links))) AS pos FROM webtools_bridge WHERE url IS NOT NULL) WHERE x.url IS NOT NULL),
 cd AS (SELECT search_query, link, min((k, pos)) AS m FROM one JOIN n3 USING (u) JOIN li USING (raw) WHERE NOT {_skip('link')} AND {_matches('link', 'anchor')} GROUP BY ALL),
 nw AS (SELECT cd.*, n2.u, {_H.replace('url', 'link')} AS h FROM cd JOIN n2 ON n2.raw = link WHERE (search_query, n2.u) NOT IN (SELECT (search_query, n1.u) FROM c JOIN n1 ON n1.raw = c.url)),
 hv AS (SELECT search_query, {_domain("h")} AS key, count(*) AS have FROM (SELECT search_query, {_H.replace('url', 'u')} AS h FROM one) GROUP BY ALL), ky AS (SELECT *, {_domain('h')} AS key FROM nw),
 lv AS (SELECT search_query, link, key, row_number() OVER (PARTITION BY search_query, key ORDER BY m, link) + coalesce(have, 0) AS r FROM ky LEFT JOIN hv USING (search_query, key)), two AS (SELECT * FROM lv WHERE r <= 2)"""

SQL = {
    "fetch_block_types": f"""WITH x AS (SELECT 'check' AS kind, blocked::VARCHAR AS flag, body AS b FROM (SELECT DISTINCT ON (check_id) * FROM fetch_log) UNION ALL SELECT 'read', blocked, text FROM webtools_bridge),
 y AS (SELECT *, lower(b) AS l, len(trim(regexp_replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM x) SELECT kind, flag, {_CODE} AS code, CASE WHEN b IS NULL OR b = '' THEN true ELSE {_BLOCKS} END AS blocks, coalesce(n >= 50, false) AS valid, count(*) AS n FROM y GROUP BY ALL""",
    "bot_challenges": f"""WITH x AS (SELECT read_id, coalesce(title, '') || ' ' || coalesce(text, '') AS a, lower('Title: ' || coalesce(title, '') || chr(10) || 'Warning: target page requires CAPTCHA' || chr(10) || coalesce(text, '')) AS b FROM webtools_bridge),
 y AS (SELECT read_id, regexp_matches(a, '(?i){P.BOT_CHALLENGE}') AS tagged, contains(b, 'title: just a moment...') OR contains(b, '## performing security verification') OR contains(b, 'title: attention required! | cloudflare') AS reader FROM x) SELECT * FROM y WHERE tagged OR reader""",
    "clean_content": f"""WITH x AS (SELECT read_id, array_to_string(list_filter({_LINES}, lambda x: len(x) >= 10 AND NOT regexp_matches(x, {_q('(?i)' + '|'.join(P.NOISE_LINES))}) AND NOT (len(x) < 40 AND {_any('lower(x)', P.NOISE_PHRASES)}) AND NOT (starts_with(x, 'http') AND NOT contains(x, ' '))), chr(10)) AS t FROM webtools_bridge),
 y AS (SELECT read_id, regexp_replace(regexp_replace(t, '(?s)(?:{P.END_MATTER}).*', ''), '^\\s+|\\s+$', '', 'g') AS t FROM x) SELECT read_id, len(t) AS chars, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS n_lines, md5(t) AS md5 FROM y""",
    "candidate_flags": f"""WITH {_R}, x AS (SELECT *, {_P} AS p, {_S} || '://' || {_N} AS root, '/' || replace(lower(trim(search_query)), ' ', '+') AS sp, {_QW.format("len(w) >= 2 AND NOT w IN " + _in(P.PHRASE_STOP_WORDS))} AS pw, {_HAY} AS hay FROM r)
 SELECT serp_id, {_any("lower(p || ' ' || " + _Q + " || ' ' || regexp_extract(url, '#(.*)$', 1))", P.CONTENT_WORDS)} OR regexp_matches(lower(p), '[0-9]+\\.html$|/[0-9]{{3,}}|/(?:19|20)[0-9]{{2}}/(?:0[1-9]|1[0-2])/') AS content, {_soup('p')} AS soup, {_soup('sp')} AS stuffed,
 CASE WHEN len(pw) >= 2 THEN len(list_filter(range(1, len(pw)), lambda i: regexp_matches(lower(coalesce(snippet, '')), '(?:^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(pw[i] || ' ' || pw[i + 1]) || '(?:$|[^\\p{{L}}\\p{{N}}_])'))) > 0 ELSE false END AS phrase,
 len(list_filter({_QW.format("len(w) >= 3")}, lambda w: contains(hay, w))) > 0 AS strict, {_matches('url', 'title')} AS matches, {_any('hay', P.GALLERY_WORDS)} AS gallery, NOT contains(url, '?') AND NOT contains(url, '#') AS pdf, root || '/' AS referrer FROM x""",
    "dedup_keys": f"""WITH {_R}, n AS ({URL_SQL['url_normalize']}), u AS (SELECT DISTINCT serp_id, url_norm FROM n), x AS (SELECT serp_id, {_H.replace('url', 'url_norm')} AS h, split_part(trim(regexp_replace({_P.replace('url', 'url_norm')}, '/$', ''), '/'), '/', 1) AS seg FROM r JOIN u USING (serp_id))
 SELECT serp_id, {_domain('h')} AS own, 'someone.tumblr.com/' || seg AS platform FROM x""",
    "level_two_cap": f"WITH {_COMBINED}, {_LEVEL} SELECT search_query, link, key, r FROM two",
    "candidate_union": f"""WITH {_COMBINED}, {_LEVEL}, z AS (SELECT search_query, link AS url, 0 AS source FROM two UNION ALL SELECT search_query, url, 1 FROM r WHERE NOT alive) SELECT search_query, url, min(source)::BIGINT AS source FROM z GROUP BY ALL""",
    "full_size_images": f"""WITH i AS (SELECT DISTINCT image AS i FROM (SELECT unnest(images) AS image FROM webtools_bridge) WHERE image IS NOT NULL),
 x AS (SELECT DISTINCT unnest([i, regexp_replace(i, '/img/([0-9]+)\\.', '/img/thumbs/\\1-150x150.'), i || '?w=200&h=100', regexp_replace(i, '([0-9]+)\\.([A-Za-z0-9_]+)$', '\\1_s.\\2')]) AS image FROM i) SELECT image, {_UP} AS "full" FROM x""",
    "images_of_relevant_pages": f"""WITH {_COMBINED}, n1 AS ({_normal('url', 'c')}), n3 AS ({_normal('trim(url)', 'webtools_bridge WHERE url IS NOT NULL')}), g AS (SELECT DISTINCT f.search_query, n1.u FROM f JOIN n1 ON n1.raw = f.url WHERE m.alive AND m.rel >= 0.5),
 s AS (SELECT DISTINCT n3.u, image FROM (SELECT trim(url) AS raw, unnest(images) AS image FROM webtools_bridge WHERE url IS NOT NULL) JOIN n3 USING (raw) WHERE image IS NOT NULL) SELECT DISTINCT search_query, image FROM s JOIN g USING (u)""",
    "category_top5": f"""WITH k AS ({SEARCH_SQL['classify_content']}), o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, read_id) AS rank, count(*) OVER (PARTITION BY category) AS n FROM k) SELECT category, read_id, confidence, rank, n FROM o WHERE rank <= 5""",
    "find_terms": f"WITH {_R} SELECT serp_id FROM r WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(snippet, '') || ' ' || coalesce(url, '')), regexp_split_to_array(lower(trim(search_query)), '\\s+')[-1])",
    "image_bonus": f"""SELECT read_id, CASE WHEN {_any(_HAY, P.GALLERY_WORDS)} AND n >= 15 THEN round(least((n - 14) * 0.02, 0.25), 6) ELSE 0 END::DOUBLE AS bonus FROM (SELECT read_id, url, title, coalesce(len(images), 0) + coalesce(len(links), 0) AS n FROM webtools_bridge)""",
    "fingerprint_pairs": """WITH e AS (SELECT vec_id, list_transform(range(1, 64), lambda i: embedding[i]::DOUBLE < embedding[i + 1]::DOUBLE) AS b FROM embeddings WHERE len(embedding) >= 64), k AS (SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(b, lambda x: x::BIGINT)), lambda s, x: s * 2 + x) AS fp FROM e),
 w AS (SELECT unnest([{'vec_id': vec_id * 3, 'fp': fp}, {'vec_id': vec_id * 3 + 1, 'fp': xor(fp, 7)}, {'vec_id': vec_id * 3 + 2, 'fp': xor(fp, 511)}], recursive := true) FROM k),
 c AS (SELECT fp, min(vec_id) AS rep, list(vec_id) AS ids FROM w GROUP BY 1) SELECT a.rep AS a, b.rep AS b, bit_count(xor(a.fp, b.fp))::BIGINT AS distance FROM c a JOIN c b ON a.rep < b.rep WHERE bit_count(xor(a.fp, b.fp)) <= 8 UNION ALL SELECT rep, i, 0 FROM (SELECT rep, unnest(ids) AS i FROM c) WHERE i <> rep""",
}
