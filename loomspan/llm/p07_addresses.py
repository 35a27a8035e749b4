"""Problem 7: one record per address, whatever its spelling.

Method: canonicalize characters, case, white space, punctuation and field
order; hash to 128 bits; aggregate counts with map-side combining and check
every hash group for collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.urls import percent_decode, trim_edges
from loomspan.llm.common import attach_by_key
from loomspan.session import materialize, read_table

# Fields that only track the visit.
TRACKING = r"^(?:utm_.*|fbclid|gclid|mc_cid|mc_eid|igshid)$"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:/*"


def _tokens(text: Column, sep: str) -> Column:
    return F.array_join(F.filter(F.split(text, r"[^\p{L}\p{N}\p{M}]+"), lambda t: t != ""), sep)


def canonical_address(url: Column) -> Column:
    """The spelling-free form of ``url``.

    Null stays null; an url of nothing but punctuation gives "". Case,
    percent-encoding, surrounding and separating punctuation, default port,
    fragment, tracking fields and the order of query fields do not matter;
    scheme, host, path words and field=value bindings do.
    """
    u = F.regexp_replace(trim_edges(url), r"(?s)#.*$", "")
    u = F.regexp_replace(trim_edges(u), r"[?&/#\s]+$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):/", 1))
    rest = F.regexp_replace(u, _SCHEME, "")
    host = F.lower(percent_decode(F.regexp_extract(rest, r"^([^/?\\]*)", 1)))
    host = F.when(scheme == "http", F.regexp_replace(host, r":0*80$", "")).when(scheme == "https", F.regexp_replace(host, r":0*443$", "")).otherwise(host)
    host = F.regexp_replace(host, r"[.:\s]+$", "")
    path = _tokens(F.lower(percent_decode(F.regexp_extract(rest, r"^[^/?\\]*([^?]*)", 1))), "/")
    fields = F.transform(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), r"[&;?]+(?:amp;)*"), lambda p: F.lower(percent_decode(p)))
    fields = F.transform(fields, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), _tokens(F.regexp_replace(p, r"^[^=]*=", ""), ".")).otherwise("").alias("v")))
    fields = F.filter(fields, lambda f: (f.k != "") & ~f.k.rlike(TRACKING))
    query = F.array_join(F.array_sort(F.transform(fields, lambda f: F.concat(_tokens(f.k, "_"), F.lit("="), f.v))), "&")
    return F.concat(scheme, F.lit("|"), host, F.lit("|"), path, F.lit("|"), query)


def address_keys(reads: DataFrame, id_col: str = "read_id", url_col: str = "url") -> DataFrame:
    """(id, h1, h2, check): a 128-bit hash of the canonical address and an independent check value."""
    c = reads.filter(F.col(url_col).isNotNull()).select(F.col(id_col).alias("id"), canonical_address(F.col(url_col)).alias("c"))
    return c.select("id", F.xxhash64(F.lit(1), "c").alias("h1"), F.xxhash64("c", F.lit(2)).alias("h2"), (F.crc32(F.encode("c", "utf-8")) * F.lit(4096) + F.length("c") % 4096).alias("check"))


def address_groups(keys: DataFrame) -> DataFrame:
    """(h1, h2, check, head, n): one row per address.

    The check value is part of the grouping key, so two addresses that
    collide in all 128 bits still stay apart. Counts combine map-side.
    """
    return keys.groupBy("h1", "h2", "check").agg(F.min("id").alias("head"), F.count("*").alias("n"))


def collapse_addresses(reads: DataFrame, id_col: str = "read_id", url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """(members, groups) of the addresses in ``reads``.

    Rows with a null url are left out, repeated ids count once, an empty
    table gives no groups, other columns are ignored.
    """
    keys = materialize(address_keys(reads.select(id_col, url_col), id_col, url_col).distinct(), "p7")
    groups = address_groups(keys)
    return keys, groups


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, groups = collapse_addresses(read_table(spark, sf_dir, "webtools_bridge"))
    many = attach_by_key(keys, materialize(groups.filter("n > 1"), "p7many"), ["h1", "h2", "check"], "n")
    return many.filter("id <> head").select(F.col("head").alias("read_id_a"), F.col("id").alias("read_id_b"))


def p7_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per address: its smallest read id and the number of reads."""
    _, groups = collapse_addresses(read_table(spark, sf_dir, "webtools_bridge"))
    return groups.select(F.col("head").alias("read_id"), F.col("n").alias("n_reads"))


QUERIES = {"p7_found": p7_found, "p7_addresses": p7_addresses}
