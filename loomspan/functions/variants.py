"""Search variants of a query, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import words

# Aspects of a topic by kind of query, and suffixes for short queries.
ASPECTS = {
    "technical": ["overview how it works", "setup configuration", "benchmarks comparison", "troubleshooting"],
    "news": ["latest updates", "background context", "analysis reaction"],
    "visual": ["gallery photos", "sources pages", "biography facts"],
    "historical": ["origins timeline", "key figures events", "primary sources archives"],
    "comparison": ["feature comparison", "pros cons", "benchmarks tests"],
    "video": ["video sources clips", "watch online full", "official trailers"],
    "general": ["overview", "examples", "history", "current status"],
}
# Suffixes of short queries, and of longer ones by kind of query.
BROAD_SUFFIXES = ["history", "trends", "examples", "best resources"]
TYPE_SUFFIXES = {
    "technical": ["API", "without API key", "open source", "integration", "setup", "documentation", "scraping", "library"],
    "visual": ["free gallery photos portfolio", "high resolution original", "wallpapers collection", "art exhibition showcase"],
    "person": ["career biography filmography", "free gallery photos portraits", "personal life interview", "aliases stage names real name"],
    "historical": ["history origins timeline", "detailed chronology evolution", "archival sources primary", "background context facts"],
    "news": ["latest news recent", "current status today", "developments updates", "official announcements"],
    "comparison": ["vs alternative comparison", "pros cons advantages", "detailed analysis benchmark", "which is better"],
    "video": ["video sources clips footage", "watch online stream full", "video archive collection", "trailer official release"],
    "general": ["free", "image search", "examples", "best resources"],
}
# Variants of a query at most, and the number of words below which it is short.
MAX_VARIANTS, BROAD_BELOW = 5, 4


def _base(query: Column) -> Column:
    return F.regexp_replace(F.trim(query), r"\.+$", "")


def aspect_variants(query: Column, kind: str = "general") -> Column:
    """Array of (aspect, variant): the query itself as "core", then its first four words with each aspect."""
    w = F.slice(words(query), 1, 4)
    core = F.when(F.size(w) > 0, F.array_join(w, " ")).otherwise(F.trim(query))
    pairs = [F.struct(F.lit("core").alias("aspect"), _base(query).alias("variant"))]
    pairs += [F.struct(F.lit(a).alias("aspect"), F.concat(core, F.lit(" " + a)).alias("variant")) for a in ASPECTS.get(kind, ASPECTS["general"])]
    rows = F.filter(F.array(*pairs), lambda p: (p.aspect == "core") | (F.lower(p.variant) != F.lower(_base(query))))
    return F.when(F.trim(query) != "", F.slice(rows, 1, MAX_VARIANTS)).otherwise(F.array().cast("array<struct<aspect:string,variant:string>>"))


def plain_variants(query: Column, kind: str = "general") -> Column:
    """The query and its suffixed forms: the first word with broad suffixes below four words, else the first four with those of its kind."""
    w = words(query)
    broad = F.array(*[F.concat(F.element_at(w, 1), F.lit(" " + s)) for s in BROAD_SUFFIXES])
    full = F.array(*[F.concat(F.array_join(F.slice(w, 1, 4), " "), F.lit(" " + s)) for s in TYPE_SUFFIXES.get(kind, TYPE_SUFFIXES["general"])])
    more = F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < BROAD_BELOW, broad).otherwise(full)
    return F.slice(F.array_distinct(F.concat(F.array(_base(query)), more)), 1, MAX_VARIANTS)
