"""Results written out: JSON lines and Markdown reports, one file set per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slug(text: Column, size: int = 60) -> Column:
    """File-name form of a text: word characters, spaces as underscores."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s-]", "")
    return F.substring(F.regexp_replace(t, r"[\s_]+", "_"), 1, size)


def cache_key(kind: Column, key: Column) -> Column:
    return F.concat(kind, F.lit("_"), F.substring(F.sha1(F.encode(key, "utf-8")), 1, 20))


def fresh(rows: DataFrame, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Cached rows not older than the time to live."""
    return rows.filter(F.unix_seconds(now) - F.unix_seconds(at) < ttl_seconds)


def markdown_reports(evidence: DataFrame, query: str = "search_query", rank: str = "rank") -> DataFrame:
    """(query, file, report): one Markdown list of sources per query, at most as long as the evidence cut."""
    line = F.concat(F.lit("- ["), F.coalesce("title", "url"), F.lit("]("), "url", F.lit(")"), F.coalesce(F.concat(F.lit(" – "), "snippet"), F.lit("")))
    rows = evidence.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(rank, line.alias("line")))).alias("l"))
    body = F.concat(F.lit("# "), F.col(query), F.lit("\n\n## Sources\n\n"), F.array_join(F.transform("l", lambda x: x.line), "\n"), F.lit("\n"))
    return rows.select(query, F.concat(slug(F.col(query)), F.lit(".md")).alias("file"), body.alias("report"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
