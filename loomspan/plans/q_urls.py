"""URL queries over the search results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import constants as C
from loomspan.functions import urls as U
from loomspan.session import read_table

#: The tables' hosts end in made-up top domains, whose second labels are a setting of these queries.
SUFFIXES = [*C.MULTI_LABEL_SUFFIXES, *(f"{second}.{top}" for top in ("example", "test", "invalid") for second in ("co", "org"))]
#: Hosts in or below these are never advertising here.
AD_ALLOW = ["invalid"]
#: Further segments that these crawls skip.
CRAWL_WORDS = ["archive", "works", "p"]


def _serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "serp")


def _each(**columns):
    """serp_id and one expression per column, over every row."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        url = F.col("url")
        return _serp(spark, sf_dir).select("serp_id", *[f(url).alias(name) for name, f in columns.items()])

    return query


def url_disposition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispositions of the results and of what else links on their hosts lead to: front pages, searches, clips, banners."""
    site = F.concat(U.scheme_of(F.col("url")), F.lit("://"), U.netloc_of(F.col("url")))
    more = F.array(F.col("url"), F.concat(site, F.lit("/")), F.concat(site, F.lit("/search?q=x")), F.concat(F.col("url"), F.lit(".mp4")), F.concat(site, F.lit("/banners/1")))
    return _serp(spark, sf_dir).select(F.explode(more).alias("url")).groupBy(U.disposition(F.col("url")).alias("disposition")).agg(F.count("*").alias("n"))


def url_ad_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and the banner beside each: advertising by host, word, or size on a third party's address; documentation hosts are allowed."""
    links = read_table(spark, sf_dir, "webtools_bridge").select(F.trim("url").alias("page"), F.explode("links").alias("l")).select("page", F.trim("l.url").alias("link")).filter("page is not null and link is not null")
    both = links.select("page", F.explode(F.array("link", F.concat(F.col("link"), F.lit("/300x250/x")))).alias("url")).distinct()
    return both.select("page", "url", U.is_ad_url(F.col("url"), F.col("page"), AD_ALLOW, SUFFIXES).alias("is_ad"))


def url_block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results outside the block list: the fixed hosts, and the hosts (with all below them) that blocked a fifth of at least five checks."""
    log = read_table(spark, sf_dir, "fetch_log").dropDuplicates(["check_id"])
    walls = log.groupBy(F.lower("host").alias("suffix")).agg(F.count("*").alias("n"), F.count_if("blocked").alias("k")).filter("n >= 5 and k >= 0.2 * n").select("suffix")
    listed = walls.union(spark.createDataFrame([(d,) for d in C.BLOCKED_DOMAINS], "suffix string")).distinct()
    host = U.host_of(F.col("url"))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = _serp(spark, sf_dir).select(host.alias("host"), suffixes.alias("suffixes")).distinct()
    hit = hosts.select("host", F.explode("suffixes").alias("suffix")).join(listed, "suffix", "left_semi").select("host").distinct()
    return _serp(spark, sf_dir).withColumn("host", host).join(hit, "host", "left_anti").select("serp_id", "url")


def url_crawl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read_table(spark, sf_dir, "webtools_bridge").select("read_id", F.explode("links").alias("l"))
    return links.select("read_id", F.col("l.handle").alias("handle"), F.col("l.url").alias("url")).filter(~U.skip_crawl(F.col("url"), CRAWL_WORDS) & ~U.is_junk_url(F.col("url")))


def site_read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches per registrable domain: all, alive, blocked."""
    log = read_table(spark, sf_dir, "fetch_log").dropDuplicates(["check_id"])
    return log.groupBy(U.registrable_domain(F.col("host"), SUFFIXES).alias("domain")).agg(F.count("*").alias("n"), F.count_if("alive").alias("n_alive"), F.count_if("blocked").alias("n_blocked"))


QUERIES = {
    "url_normalize": _each(url_norm=U.normalize_url),
    "url_strip_tracking": _each(stripped=U.strip_tracking_params),
    "url_domain": _each(host=U.host_of, domain=lambda u: U.registrable_domain(U.host_of(u), SUFFIXES)),
    "url_words": _each(words=lambda u: F.array_join(U.url_words(u), " ")),
    "url_video_filter": _each(is_video=U.is_video_url),
    "url_ad_filter": url_ad_filter,
    "url_disposition_counts": url_disposition_counts,
    "url_block_filter": url_block_filter,
    "url_crawl_filter": url_crawl_filter,
    "site_read_counts": site_read_counts,
}


def _in(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


_S = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1))"
_N = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
_H = f"regexp_extract({_N}, '^(?:[^@]*@)?([^:]*)', 1)"
_P = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
_Q = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_TRACK = _in(C.TRACKING_PARAMS)


def _suffix_in(host: str, domains) -> str:
    return f"(list_has_any(list_transform(range(1, len(string_split({host}, '.')) + 1), lambda i: array_to_string(list_slice(string_split({host}, '.'), i, 1000), '.')), [{_in(domains)[1:-1]}]))"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _domain(h: str) -> str:
    labels = f"string_split({h}, '.')"
    return f"CASE WHEN regexp_matches({h}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') OR len({labels}) <= 2 THEN {h} WHEN array_to_string({labels}[-2:], '.') IN {_in(SUFFIXES)} THEN array_to_string({labels}[-3:], '.') ELSE array_to_string({labels}[-2:], '.') END"


_VIDEO = _any("lower(url)", C.VIDEO_PATTERNS)
_AD = f"({_suffix_in(_H, C.AD_HOSTS)} OR list_has_any(regexp_split_to_array(lower({_N} || '/' || {_P}), '[^\\p{{L}}\\p{{N}}_]+'), [{_in(w + s for w in C.AD_WORDS for s in ('', 's'))[1:-1]}]))"
_KEPT = f"list_filter(string_split({_Q}, '&'), lambda p: NOT lower(split_part(p, '=', 1)) IN {_TRACK})"
_PAIRS = f"list_filter({_KEPT}, lambda p: p <> '')"
_LABELS = "string_split(h, '.')"
# segment i goes when it continues a run of at least three
_SEGS = f"string_split(regexp_replace({_P}, '/$', ''), '/')"
_COLLAPSED = (
    f"array_to_string(list_transform(list_filter(range(1, len({_SEGS}) + 1), lambda i: {_SEGS}[i] = '' OR i = 1 OR NOT ({_SEGS}[i] = {_SEGS}[i-1] AND "
    f"(coalesce({_SEGS}[i+1] = {_SEGS}[i], false) OR (i > 2 AND coalesce({_SEGS}[i-2] = {_SEGS}[i], false))))), lambda i: {_SEGS}[i]), '/')"
)

SQL = {
    "url_normalize": f"""SELECT serp_id, CASE WHEN {_S} = '' THEN url ELSE {_S} || '://' || {_N} || {_COLLAPSED} ||
 CASE WHEN len({_PAIRS}) > 0 THEN '?' || array_to_string(list_sort({_PAIRS}), '&') ELSE '' END END AS url_norm FROM serp""",
    "url_strip_tracking": f"""SELECT serp_id, CASE WHEN {_Q} = '' OR len({_KEPT}) = len(string_split({_Q}, '&')) THEN url ELSE
 split_part(split_part(url, '#', 1), '?', 1) || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END || regexp_extract(url, '^[^#]*(#.+)$', 1) END AS stripped FROM serp""",
    "url_domain": f"""SELECT serp_id, h AS host, CASE WHEN regexp_matches(h, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') OR len({_LABELS}) <= 2 THEN h
 WHEN array_to_string({_LABELS}[-2:], '.') IN {_in(SUFFIXES)} THEN array_to_string({_LABELS}[-3:], '.') ELSE array_to_string({_LABELS}[-2:], '.') END AS domain
 FROM (SELECT serp_id, {_H} AS h FROM serp)""",
    "url_words": f"""SELECT serp_id, array_to_string(list_filter(w, lambda x, i: len(x) >= 3 AND list_position(w, x) = i), ' ') AS words
 FROM (SELECT serp_id, regexp_split_to_array(lower({_P}), '[^\\p{{L}}\\p{{N}}]+') AS w FROM serp)""",
    "url_video_filter": f"SELECT serp_id, {_VIDEO} AS is_video FROM serp",
    "url_ad_filter": f"""WITH l AS (SELECT trim(url) AS page, trim(x.url) AS link FROM (SELECT url, unnest(links) AS x FROM webtools_bridge)), b AS (SELECT DISTINCT page, unnest([link, link || '/300x250/x']) AS url FROM l WHERE page IS NOT NULL AND link IS NOT NULL),
 d AS (SELECT page, url, {_AD} AS strong, regexp_matches(url, '[-_/][0-9]{{2,4}}[xX][0-9]{{2,4}}[-_/.]') AS sized, {_H} AS a, {_H.replace('url', 'page')} AS b FROM b),
 e AS (SELECT *, {_domain('a')} AS da, {_domain('b')} AS db FROM d) SELECT page, url, (strong OR (sized AND a <> '' AND b <> '' AND da <> db)) AND NOT {_suffix_in('a', AD_ALLOW)} AS is_ad FROM e""",
    "url_disposition_counts": f"""WITH m AS (SELECT unnest([url, {_S} || '://' || {_N} || '/', {_S} || '://' || {_N} || '/search?q=x', url || '.mp4', {_S} || '://' || {_N} || '/banners/1']) AS url FROM serp)
 SELECT CASE WHEN {_suffix_in(_H, C.BLOCKED_DOMAINS)} THEN 'blocked' WHEN trim(lower({_P}), '/') IN {_in(C.HOME_PATHS)} THEN 'homepage'
 WHEN {_any('lower(url)', C.SEARCH_PATTERNS)} THEN 'search' WHEN {_VIDEO} THEN 'video' WHEN {_AD} THEN 'ad' ELSE 'kept' END AS disposition, count(*) AS n FROM m GROUP BY 1""",
    "url_block_filter": f"""WITH l AS (SELECT DISTINCT ON (check_id) * FROM fetch_log), w AS (SELECT lower(host) AS suffix FROM l GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (blocked) >= 0.2 * count(*)),
 s AS (SELECT suffix FROM w UNION SELECT unnest([{_in(C.BLOCKED_DOMAINS)[1:-1]}])), h AS (SELECT DISTINCT {_H} AS host FROM serp), x AS (SELECT DISTINCT host FROM h, s WHERE host = suffix OR ends_with(host, '.' || suffix))
 SELECT serp_id, url FROM serp WHERE {_H} NOT IN (SELECT host FROM x)""",
    "url_crawl_filter": f"""SELECT read_id, handle, url FROM (SELECT read_id, unnest(links, recursive := true) FROM (SELECT read_id, links FROM webtools_bridge)) WHERE NOT CASE WHEN {_S} = '' OR {_N} = '' THEN true ELSE
 regexp_matches(lower({_P}), '\\.(?:{"|".join(C.FILE_ENDINGS)})$') OR {_suffix_in(_H, C.AD_HOSTS)} OR {_any('lower(url)', C.AD_NETWORKS)} OR list_has_any(string_split(lower({_P}), '/'), [{_in([*C.SKIP_SEGMENTS, *(w for w in CRAWL_WORDS if len(w) >= 3)])[1:-1]}])
 OR ({_Q} <> '' AND len(list_filter(string_split({_Q}, '&'), lambda p: NOT lower(split_part(p, '=', 1)) IN {_in(C.REDIRECT_KEYS)})) = 0) END
 AND NOT ({_suffix_in(_H, C.AD_HOSTS)} OR {_any('lower(url)', C.JUNK_PATTERNS)})""",
    "site_read_counts": f"""WITH d AS (SELECT DISTINCT ON (check_id) * FROM fetch_log), x AS (SELECT lower(trim(host)) AS h, alive, blocked FROM d)
 SELECT CASE WHEN h IS NULL THEN '' WHEN regexp_matches(h, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') OR len({_LABELS}) <= 2 THEN h WHEN array_to_string({_LABELS}[-2:], '.') IN {_in(SUFFIXES)}
 THEN array_to_string({_LABELS}[-3:], '.') ELSE array_to_string({_LABELS}[-2:], '.') END AS domain, count(*) AS n, count(*) FILTER (alive) AS n_alive, count(*) FILTER (blocked) AS n_blocked FROM x GROUP BY 1""",
}
