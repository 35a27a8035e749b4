"""Feeds, sitemaps, robots files and cookie files as tables."""

from __future__ import annotations

import gzip
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ITEMS, MAX_SUMMARY = 60, 700
MAX_RAW, MAX_PLAIN = 2_000_000, 6_000_000


def is_feed(body: Column) -> Column:
    head = F.lower(F.ltrim(F.substring(body, 1, 1024)))
    return head.contains("<rss") | head.contains("<feed") | head.contains("<rdf:rdf") | (head.startswith("{") & head.contains("jsonfeed.org"))


def parse_feed(body: str | None) -> list[dict]:
    """Items (title, link, date as written, summary) of an RSS, Atom or JSON feed; [] for anything else."""
    text = (body or "").strip()
    if text.startswith("{"):
        try:
            items = json.loads(text).get("items") or []
        except (ValueError, AttributeError):
            return []
        rows = [{"title": i.get("title"), "link": i.get("url") or i.get("external_url"), "date": i.get("date_published"), "summary": i.get("summary") or i.get("content_text")} for i in items if isinstance(i, dict)]
    else:
        if "<!ENTITY" in text:  # no entity tricks
            return []
        try:
            root = ET.fromstring(text.encode())
        except ET.ParseError:
            return []
        name = lambda e: e.tag.rsplit("}", 1)[-1].lower()
        rows = []
        for e in root.iter():
            if name(e) in ("item", "entry"):
                kids = {name(k): k for k in reversed(list(e))}
                get = lambda *ks: next(("".join(kids[k].itertext()).strip() for k in ks if k in kids and "".join(kids[k].itertext()).strip()), None)  # noqa: B023, E731
                link = get("link") or (kids["link"].get("href") if "link" in kids else None)
                rows.append({"title": get("title"), "link": link, "date": get("pubdate", "published", "updated", "date"), "summary": get("description", "summary", "content")})
    for r in rows:
        r["summary"] = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", r["summary"] or "")).strip()[:MAX_SUMMARY] or None
    return rows[:MAX_ITEMS]


_ITEM = pa.list_(pa.struct([(k, pa.string()) for k in ("title", "link", "date", "summary")]))


def _feeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array([parse_feed(x) for x in b.column(1).to_pylist()], _ITEM)], names=["url", "items"])


def feed_items(feeds: DataFrame, url_col: str = "url", body_col: str = "body") -> DataFrame:
    """One row per feed item with its position."""
    rows = feeds.select(F.col(url_col).cast("string"), body_col).mapInArrow(_feeds, "url string, items array<struct<title string, link string, date string, summary string>>")
    return rows.select("url", F.posexplode("items").alias("pos", "i")).select("url", "pos", "i.*")


def gunzip(data: bytes | None) -> bytes | None:
    """Plain bytes of a possibly compressed body within the size limits, else null."""
    if data is None or len(data) > MAX_RAW or len(data) < 40:
        return None
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        with gzip.GzipFile(fileobj=__import__("io").BytesIO(data)) as f:
            plain = f.read(MAX_PLAIN + 1)
    except (OSError, EOFError):
        return None
    return plain if len(plain) <= MAX_PLAIN else None


def robots_sitemaps(robots: DataFrame, host_col: str = "host", body_col: str = "body", most: int = 12) -> DataFrame:
    """(host, url): the distinct Sitemap lines of each robots file, the first twelve."""
    lines = robots.select(F.col(host_col).alias("host"), F.posexplode(F.split(body_col, r"\r?\n")).alias("pos", "line"))
    found = lines.select("host", "pos", F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1).alias("url")).filter("url <> ''").groupBy("host", "url").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy("pos"))
    return found.withColumn("k", rank).filter(F.col("k") <= most).select("host", "url")


def sitemap_locs(body: Column) -> Column:
    """Addresses in a sitemap or sitemap index, in order, repeats dropped."""
    locs = F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]]+?)\s*(?:\]\]>)?\s*</loc>"), 1)
    return F.array_distinct(F.transform(locs, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))


def expand_sitemaps(sitemaps: DataFrame, roots: DataFrame, most: int = 400) -> DataFrame:
    """(host, url): pages of the root sitemaps and of those one level below, 400 a host.

    ``sitemaps``: (url, body); ``roots``: (host, url). Two joins, no recursion.
    """
    s = sitemaps.select("url", sitemap_locs(F.col("body")).alias("locs"), F.lower("body").contains("<sitemapindex").alias("index"))
    first = roots.join(s, "url").select("host", "index", F.explode("locs").alias("loc"))
    below = first.filter("index").select("host", F.col("loc").alias("url")).join(s.filter(~F.col("index")), "url").select("host", F.explode("locs").alias("url"))
    pages = first.filter(~F.col("index")).select("host", F.col("loc").alias("url")).union(below).distinct()
    rank = F.row_number().over(Window.partitionBy("host").orderBy("url"))
    return pages.withColumn("k", rank).filter(F.col("k") <= most).select("host", "url")


def read_cookies(spark: SparkSession, path: str) -> DataFrame:
    """A cookies.txt file as rows; #HttpOnly_ lines count, other comments and broken lines do not."""
    line = F.regexp_replace("value", "^#HttpOnly_", "")
    rows = spark.read.text(path).select(line.alias("line")).filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    tabbed = F.split("line", "\t")
    part = F.when(F.size(tabbed) >= 7, tabbed).otherwise(F.split(F.trim("line"), r"\s+", 7))
    rows = rows.select(part.alias("p")).filter(F.size("p") >= 7)
    p = F.col("p")
    return rows.select(
        F.lower(F.regexp_replace(p[0], r"^\.", "")).alias("domain"), p[2].alias("path"), (F.upper(p[3]) == "TRUE").alias("secure"), F.coalesce(p[4].try_cast("double"), F.lit(0.0)).alias("expires"), p[5].alias("name"), p[6].alias("value")
    )


def cookie_headers(jar: DataFrame, urls: DataFrame, now: float, most: int = 50, size: int = 4096) -> DataFrame:
    """(url, header): the cookies that apply, longest path first, until count or size is reached.

    The jar is joined on the suffixes of the host, an equi-join; path,
    scheme and expiry are checked on what matches.
    """
    from loomspan.functions import urls as U

    u = F.col("url")
    labels = F.split(U.host_of(u), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.when(U.path_of(u) == "", "/").otherwise(U.path_of(u))
    rows = urls.select("url", U.scheme_of(u).alias("scheme"), path.alias("p"), F.explode(suffixes).alias("domain")).join(jar, "domain")
    inside = (F.col("p") == F.col("path")) | (F.col("p").startswith(F.col("path")) & (F.col("path").endswith("/") | (F.substr("p", F.length("path") + 1, F.lit(1)) == "/")))
    live = (F.col("expires") == 0) | (F.col("expires") > now)
    rows = rows.filter(inside & live & (~F.col("secure") | (F.col("scheme") == "https"))).withColumn("pair", F.concat("name", F.lit("="), "value"))
    w = Window.partitionBy("url").orderBy(F.desc(F.length("path")), "name", "domain")
    used = F.sum(F.length("pair") + 2).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 2
    rows = rows.withColumn("k", F.row_number().over(w)).withColumn("used", used).filter((F.col("k") <= most) & (F.col("used") <= size))
    return rows.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "pair"))), lambda x: x.pair), "; ").alias("header"))
