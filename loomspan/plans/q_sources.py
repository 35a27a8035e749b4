"""Extraction queries: markup, feeds and sitemaps built from the tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import network as N
from loomspan.functions import urls as U
from loomspan.functions import variants as V
from loomspan.operators.rules import rewrite_urls
from loomspan.plans.q_text import SQL as TEXT_SQL
from loomspan.plans.q_text import compact_evidence
from loomspan.plans.q_urls import _H, _P, _S
from loomspan.session import read_table
from loomspan.sources import feeds, html, sinks


#: Path, https only, expiry (0: none) and name of the cookies of a made-up jar.
COOKIES = [("/", False, 0, "sid"), ("/p", False, 2e9, "part"), ("/", True, 0, "safe"), ("/", False, 1, "old")]


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and number of links of every read, written as markup and read back."""
    t = F.coalesce(F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit(""))
    anchors = F.transform(F.coalesce("links", F.array().cast("array<struct<handle:string,url:string,text:string>>")), lambda x: F.concat(F.lit('<li><a href="'), _escape(F.coalesce(x.url, F.lit(""))), F.lit('">'), _escape(F.coalesce(x.text, F.lit(""))), F.lit("</a>")))
    page = F.concat(F.lit("<html><head><title>"), _escape(t), F.lit("</title><script>var a='</p>';</script></head><body><article><p>"), _escape(F.coalesce("text", F.lit(""))), F.lit("</article><ul>"), F.array_join(anchors, ""), F.lit("</ul></body></html>"))
    got = html.extract_pages(read_table(spark, sf_dir, "webtools_bridge").select("read_id", F.lit("").alias("base"), page.alias("html")), "read_id", "base", "html")
    return got.select(F.col("id").alias("read_id"), F.coalesce("title", F.lit("")).alias("title"), F.size("links").cast("long").alias("n_links"))


def sitemap_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct links of every read, written as a sitemap and read back."""
    rows = read_table(spark, sf_dir, "webtools_bridge").select("read_id", F.filter(F.transform("links", lambda x: F.trim(x.url)), lambda u: u.isNotNull() & (u != "")).alias("urls"))
    body = F.concat(F.lit("<urlset>"), F.array_join(F.transform("urls", lambda u: F.concat(F.lit("<url><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))), "\n"), F.lit("</urlset>"))
    return rows.select("read_id", F.explode(feeds.sitemap_locs(body)).alias("url"))


def feed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read's links as a feed, read back as items (sixty at most, as feeds are read)."""
    rows = read_table(spark, sf_dir, "webtools_bridge").filter(F.size("links") > 0)
    items = F.transform("links", lambda x: F.concat(F.lit("<item><title>"), _escape(F.coalesce(x.text, F.lit(""))), F.lit("</title><link>"), _escape(F.trim(F.coalesce(x.url, F.lit("")))), F.lit("</link></item>")))
    body = F.regexp_replace(F.concat(F.lit("<rss><channel>"), F.array_join(items, ""), F.lit("</channel></rss>")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    got = feeds.feed_items(rows.select(F.col("read_id").cast("string").alias("url"), body.alias("body")))
    return got.groupBy(F.col("url").cast("long").alias("read_id")).agg(F.count("*").alias("n_items"), F.count("link").alias("n_links"))


def query_variants_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspect variants of every search query, for every kind of query."""
    q = read_table(spark, sf_dir, "query_variants").select("search_query").distinct()
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), V.aspect_variants(F.col("search_query"), k).alias("vs")) for k in V.ASPECTS])
    return q.select("search_query", F.explode(kinds).alias("k")).select("search_query", "k.kind", F.explode("k.vs").alias("v")).select("search_query", "kind", "v.aspect", "v.variant")


def query_variants_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixed variants of every search query, for every kind of query."""
    q = read_table(spark, sf_dir, "query_variants").select("search_query").filter("search_query is not null").distinct()
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), V.plain_variants(F.col("search_query"), k).alias("vs")) for k in V.TYPE_SUFFIXES])
    return q.select("search_query", F.explode(kinds).alias("k")).select("search_query", "k.kind", F.explode("k.vs").alias("variant"))


def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to wait of throttled and failed checks: even ids carry a number, odd ones a date in the header, taken when the check was made."""
    log = read_table(spark, sf_dir, "fetch_log").dropDuplicates(["check_id"]).filter("checked_at is not null and received_at is not null")
    at = F.date_trunc("second", "received_at")
    header = F.when(F.col("check_id") % 2 == 0, F.coalesce(F.col("content_length").cast("string"), F.lit("soon"))).otherwise(F.concat(F.lit("Thu, "), F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    return log.select("check_id", N.retry_after(header, F.date_trunc("second", "checked_at")).alias("wait_s"))


def rewritten_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images rewritten by rules: each remembered host has one of its own, all others share one for their photographs."""
    images = read_table(spark, sf_dir, "webtools_bridge").select(F.explode("images").alias("url")).filter("url is not null").distinct()
    hosts = read_table(spark, sf_dir, "wall_state").select(F.lower("host").alias("domain")).filter("domain is not null").distinct()
    own = hosts.select(F.dense_rank().over(Window.orderBy("domain")).cast("int").alias("rule_id"), "domain", F.lit(r"/img/(\d+)\.(\w+)$").alias("pattern"), F.lit("/full/$1.$2").alias("target"))
    shared = spark.createDataFrame([(100_000, None, r"/img/(\d+)\.jpg$", "/photo/$1.jpg")], "rule_id int, domain string, pattern string, target string")
    return rewrite_urls(images, own.unionByName(shared)).select("url", F.col("rule_id").cast("long").alias("rule_id"), "rewritten")


def feed_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads told apart by the look of their body, each also as feed."""
    bodies = read_table(spark, sf_dir, "webtools_bridge").select(F.explode(F.array(F.col("text"), F.concat(F.lit("  <?xml version='1.0'?><RSS>"), F.coalesce("text", F.lit(""))), F.concat(F.lit('{"version": "https://jsonfeed.org/version/1", "items": []}'), F.coalesce("text", F.lit(""))))).alias("body"))
    return bodies.groupBy(feeds.is_feed(F.col("body")).alias("is_feed")).agg(F.count("*").alias("n"))


def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap addresses of robots files, one file a site, written from the site's links and read back."""
    r = read_table(spark, sf_dir, "webtools_bridge").filter("url is not null").select(U.site_of(F.col("url")).alias("host"), F.explode(F.transform("links", lambda x: F.trim(x.url))).alias("u")).filter("u is not null and u <> '' and not u rlike '\\\\s'").distinct()
    body = r.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_set("u")), lambda u: F.concat(F.lit("  SITEMAP : "), u, F.lit("  # list\r"))), "\n").alias("b")).select("host", F.concat(F.lit("User-agent: *\nDisallow: /x\n"), "b").alias("body"))
    return feeds.robots_sitemaps(body)


def sitemap_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below each site's sitemap index: one sitemap a read, listing the read's links."""
    r = read_table(spark, sf_dir, "webtools_bridge").filter("url is not null and size(links) > 0").select("read_id", U.site_of(F.col("url")).alias("host"), F.filter(F.transform("links", lambda x: F.trim(x.url)), lambda u: u.isNotNull() & (u != "")).alias("urls"))
    name = F.concat(F.lit("https://"), "host", F.lit("/sitemap-"), F.col("read_id").cast("string"), F.lit(".xml"))
    loc = lambda u: F.concat(F.lit("<loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    leaves = r.select(name.alias("url"), F.concat(F.lit("<urlset>"), F.array_join(F.transform("urls", loc), ""), F.lit("</urlset>")).alias("body"))
    root = F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml"))
    index = r.select("host", name.alias("leaf")).groupBy("host").agg(F.collect_set("leaf").alias("leaves")).select("host", root.alias("url"), F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform("leaves", loc), ""), F.lit("</sitemapindex>")).alias("body"))
    return feeds.expand_sitemaps(leaves.union(index.select("url", "body")), index.select("host", "url"))


def cookie_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cookie header of every result address, from a jar with four cookies a remembered host: for all, for a path, for https only, and an expired one."""
    hosts = read_table(spark, sf_dir, "wall_state").select(F.lower("host").alias("domain")).filter("domain is not null").distinct()
    kinds = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(s).alias("secure"), F.lit(float(e)).alias("expires"), F.lit(n).alias("name")) for p, s, e, n in COOKIES])
    jar = hosts.select("domain", F.explode(kinds).alias("k")).select("domain", "k.*", F.length("domain").cast("string").alias("value"))
    urls = read_table(spark, sf_dir, "serp").select("url").distinct()
    return feeds.cookie_headers(jar, urls, 1e9)


def cache_fresh(spark: SparkSession, sf_dir: str, ttl_seconds: int = 14 * 86_400) -> DataFrame:
    """Stored reads within two weeks of the newest one, under the key they are kept by."""
    r = read_table(spark, sf_dir, "webtools_bridge").filter("url is not null")
    now = r.agg(F.max("stored_at")).first()[0]
    return sinks.fresh(r, "stored_at", F.lit(now).cast("timestamp"), ttl_seconds).select("read_id", sinks.cache_key(F.lit("read"), F.col("url")).alias("key"))


#: What may stand in place of a link's scheme and host in a page that wants to reach inside.
INSIDE = ["ftp://files.test", "http://localhost:8080", "http://10.1.2.3", "http://172.20.0.1", "http://192.168.1.1", "http://100.64.0.9", "http://8.8.8.8", "http://x.internal"]


def unsafe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by safety, each also with its host replaced by the addresses of INSIDE."""
    path = F.concat(U.path_of(F.trim("l.url")), F.lit("?x"))
    links = read_table(spark, sf_dir, "webtools_bridge").select(F.explode("links").alias("l")).select(F.explode(F.array(F.trim("l.url"), *[F.concat(F.lit(x), path) for x in INSIDE])).alias("u"))
    return links.groupBy(F.coalesce(N.unsafe_url(F.col("u")), F.lit(True)).alias("unsafe")).agg(F.count("*").alias("n"))


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown report per query over its evidence pack."""
    rows = compact_evidence(spark, sf_dir).withColumns({"title": F.col("url"), "snippet": F.concat(F.lit("relevance "), F.coalesce(F.col("relevance").cast("string"), F.lit("unknown")))})
    return sinks.markdown_reports(rows)


QUERIES = {
    "page_extract": page_extract, "sitemap_extract": sitemap_extract, "feed_extract": feed_extract, "query_variants_generated": query_variants_generated, "query_variants_plain": query_variants_plain, "unsafe_links": unsafe_links, "markdown_report": markdown_report,
    "retry_waits": retry_waits, "rewritten_images": rewritten_images, "feed_sniff": feed_sniff, "robots_sitemaps": robots_sitemaps, "sitemap_walk": sitemap_walk, "cookie_headers": cookie_headers, "cache_fresh": cache_fresh,
}

_W = "list_filter(regexp_extract_all(lower(search_query), '[\\p{L}\\p{N}_]+'), lambda w: len(w) >= 3)"
_BASE = "regexp_replace(trim(search_query), '\\.+$', '')"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

_SITE = "regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(url, '^[\\s<>\"''()\\[\\]{},;.]+', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*:/*', ''), '^(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.+$', ''), '^www\\.', '')"
_IP = "list_reduce(list_transform(string_split(h, '.'), lambda x: x::BIGINT), lambda a, x: a * 256 + x)"

SQL = {
    "query_variants_generated": f"""WITH q AS (SELECT DISTINCT search_query FROM query_variants WHERE trim(search_query) <> ''), k AS (SELECT unnest([{", ".join("{'kind': '" + k + "', 'suffixes': " + _LIST(v) + "}" for k, v in V.ASPECTS.items())}], recursive := true)),
 x AS (SELECT search_query, CASE WHEN len({_W}) > 0 THEN array_to_string({_W}[:4], ' ') ELSE trim(search_query) END AS core FROM q)
 SELECT search_query, kind, 'core' AS aspect, {_BASE} AS variant FROM q, k UNION ALL SELECT search_query, kind, a, core || ' ' || a FROM (SELECT search_query, core, kind, unnest(suffixes) AS a FROM x, k) WHERE lower(core || ' ' || a) <> lower({_BASE})""",
    "query_variants_plain": f"""WITH q AS (SELECT DISTINCT search_query FROM query_variants WHERE search_query IS NOT NULL), k AS (SELECT unnest([{", ".join("{'kind': '" + k + "', 'suffixes': " + _LIST(v[:4]) + "}" for k, v in V.TYPE_SUFFIXES.items())}], recursive := true)),
 x AS (SELECT search_query, kind, {_BASE} AS variant FROM q, k UNION ALL SELECT search_query, kind, CASE WHEN len({_W}) < 4 THEN {_W}[1] ELSE array_to_string({_W}[:4], ' ') END || ' ' || (CASE WHEN len({_W}) < 4 THEN {_LIST(V.BROAD_SUFFIXES)} ELSE suffixes END)[i] FROM q, k, range(1, 5) AS r(i) WHERE len({_W}) > 0)
 SELECT DISTINCT search_query, kind, variant FROM x""",
    "unsafe_links": f"""WITH l AS (SELECT trim(x.url) AS url FROM (SELECT unnest(links) AS x FROM webtools_bridge)), m AS (SELECT unnest([url, {", ".join(f"'{x}' || {_P} || '?x'" for x in INSIDE)}]) AS url FROM l),
 h AS (SELECT {_S} AS s, {_H} AS h FROM m), n AS (SELECT s, h, CASE WHEN regexp_matches(h, '^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$') THEN {_IP} END AS ip FROM h)
 SELECT coalesce(s NOT IN ('http', 'https') OR h IN ('', 'localhost') OR regexp_matches(h, '\\.(local|internal|localhost)$') OR coalesce({" OR ".join(f"ip BETWEEN {N._number(a)} AND {N._number(b)}" for a, b in N.PRIVATE_RANGES)}, false), true) AS unsafe, count(*) AS n FROM n GROUP BY 1""",
    "retry_waits": """WITH l AS (SELECT DISTINCT ON (check_id) * FROM fetch_log WHERE checked_at IS NOT NULL AND received_at IS NOT NULL) SELECT check_id, CASE WHEN check_id % 2 = 0 THEN CASE WHEN content_length IS NOT NULL THEN greatest(content_length, 0)::DOUBLE END
 ELSE greatest(0, epoch(date_trunc('second', received_at)) - epoch(date_trunc('second', checked_at)))::DOUBLE END AS wait_s FROM l""",
    "rewritten_images": f"""WITH i AS (SELECT DISTINCT url FROM (SELECT unnest(images) AS url FROM webtools_bridge) WHERE url IS NOT NULL), d AS (SELECT domain, dense_rank() OVER (ORDER BY domain) AS rule_id FROM (SELECT DISTINCT lower(host) AS domain FROM wall_state WHERE host IS NOT NULL)),
 m AS (SELECT url, min(rule_id) AS rule_id FROM (SELECT url, {_H} AS h FROM i), d WHERE (h = domain OR ends_with(h, '.' || domain)) AND regexp_matches(url, '/img/[0-9]+\\.[A-Za-z0-9_]+$') GROUP BY 1)
 SELECT url, CASE WHEN m.rule_id IS NOT NULL THEN m.rule_id WHEN regexp_matches(url, '/img/[0-9]+\\.jpg$') THEN 100000 END AS rule_id,
 CASE WHEN m.rule_id IS NOT NULL THEN regexp_replace(url, '/img/([0-9]+)\\.([A-Za-z0-9_]+)$', '/full/\\1.\\2') WHEN regexp_matches(url, '/img/[0-9]+\\.jpg$') THEN regexp_replace(url, '/img/([0-9]+)\\.jpg$', '/photo/\\1.jpg') END AS rewritten FROM i LEFT JOIN m USING (url)""",
    "feed_sniff": """WITH b AS (SELECT unnest([text, '  <?xml version=''1.0''?><RSS>' || coalesce(text, ''), '{"version": "https://jsonfeed.org/version/1", "items": []}' || coalesce(text, '')]) AS body FROM webtools_bridge), h AS (SELECT lower(ltrim(left(body, 1024))) AS h FROM b)
 SELECT contains(h, '<rss') OR contains(h, '<feed') OR contains(h, '<rdf:rdf') OR (h[1] = '{' AND contains(h, 'jsonfeed.org')) AS is_feed, count(*) AS n FROM h GROUP BY 1""",
    "robots_sitemaps": f"""WITH r AS (SELECT DISTINCT {_SITE} AS host, unnest(list_transform(links, lambda x: trim(x.url))) AS url FROM webtools_bridge WHERE url IS NOT NULL), k AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY url COLLATE "C") AS k FROM r WHERE url IS NOT NULL AND url <> '' AND NOT regexp_matches(url, '\\s'))
 SELECT host, url FROM k WHERE k <= 12""",
    "sitemap_walk": f"""WITH r AS (SELECT DISTINCT {_SITE} AS host, unnest(list_transform(links, lambda x: trim(x.url))) AS url FROM webtools_bridge WHERE url IS NOT NULL), k AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY url COLLATE "C") AS k FROM r WHERE url IS NOT NULL AND url <> '')
 SELECT host, url FROM k WHERE k <= 400""",
    "cookie_headers": f"""WITH d AS (SELECT DISTINCT lower(host) AS domain FROM wall_state WHERE host IS NOT NULL), j AS (SELECT domain, len(domain)::VARCHAR AS v FROM d), u AS (SELECT DISTINCT url, {_S} AS s, {_H} AS h, CASE WHEN {_P} = '' THEN '/' ELSE {_P} END AS p FROM serp),
 c AS (SELECT url, 'part=' || v AS pair, 2 AS len, 'part' AS name, domain FROM u, j WHERE (h = domain OR ends_with(h, '.' || domain)) AND (p = '/p' OR starts_with(p, '/p/')) UNION ALL SELECT url, 'sid=' || v, 1, 'sid', domain FROM u, j WHERE h = domain OR ends_with(h, '.' || domain)
  UNION ALL SELECT url, 'safe=' || v, 1, 'safe', domain FROM u, j WHERE (h = domain OR ends_with(h, '.' || domain)) AND s = 'https') SELECT url, string_agg(pair, '; ' ORDER BY len DESC, name, domain) AS header FROM c GROUP BY 1""",
    "cache_fresh": "SELECT read_id, 'read_' || substr(sha1(url), 1, 20) AS key FROM webtools_bridge WHERE url IS NOT NULL AND floor(epoch((SELECT max(stored_at) FROM webtools_bridge WHERE url IS NOT NULL))) - floor(epoch(stored_at)) < 1209600",
    "markdown_report": f"""WITH e AS ({TEXT_SQL['deep_research']}), l AS (SELECT search_query, string_agg('- [' || url || '](' || url || ') – relevance ' || coalesce(relevance::VARCHAR, 'unknown'), chr(10) ORDER BY rank) AS body FROM e GROUP BY 1)
 SELECT search_query, substr(regexp_replace(regexp_replace(lower(trim(search_query)), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '_', 'g'), 1, 60) || '.md' AS file, '# ' || search_query || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || body || chr(10) AS report FROM l""",
    "page_extract": """SELECT read_id, coalesce(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') AS title, coalesce(len(list_distinct(list_transform(list_filter(links, lambda x: x.url LIKE 'http%' OR x.url LIKE '//%'),
 lambda x: x.url || chr(9) || trim(regexp_replace(coalesce(x.text, ''), '\\s+', ' ', 'g'))))), 0) AS n_links FROM webtools_bridge""",
    "sitemap_extract": "SELECT read_id, url FROM (SELECT DISTINCT read_id, trim(l.url) AS url FROM (SELECT read_id, unnest(links) AS l FROM webtools_bridge)) WHERE url IS NOT NULL AND url <> ''",
    "feed_extract": "SELECT read_id, least(60, len(links)) AS n_items, len(list_filter(links, lambda x: trim(coalesce(x.url, '')) <> '')) AS n_links FROM webtools_bridge WHERE len(links) > 0",
}
