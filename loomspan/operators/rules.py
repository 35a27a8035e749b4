"""Rewrite rules on addresses: by host where a rule names one, by pattern elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import urls as U


def rewrite_urls(rows: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with ``rewritten`` and ``rule_id``: the first rule that matches, null where none does.

    ``rules``: (rule_id, domain, pattern, target), a settings table that
    does not grow; target may use $1, $2 and so on. Rules with a domain are
    looked up by the host's suffixes, an equi-join; rules without one are
    tried on what no such rule matched.
    """
    distinct = rows.select(F.col(url).alias("u")).filter("u is not null").distinct()
    labels = F.split(U.host_of(F.col("u")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = distinct.select("u", F.explode(suffixes).alias("domain")).join(F.broadcast(rules.filter("domain is not null")), "domain").filter("u rlike pattern")
    first = lambda df: df.groupBy("u").agg(F.min(F.struct("rule_id", "pattern", "target")).alias("r"))
    hit = first(own)
    shared = rules.filter("domain is null").agg(F.array_sort(F.collect_list(F.struct("rule_id", "pattern", "target"))).alias("rs")).first()
    rest = distinct.join(hit, "u", "left_anti")
    if shared and shared.rs:
        r = None
        for g in shared.rs:
            value = F.struct(F.lit(g.rule_id).alias("rule_id"), F.lit(g.pattern).alias("pattern"), F.lit(g.target).alias("target"))
            r = F.when(F.col("u").rlike(g.pattern), value) if r is None else r.when(F.col("u").rlike(g.pattern), value)
        hit = hit.select("u", "r.*").unionByName(rest.select("u", r.alias("r")).filter("r is not null").select("u", "r.*"))
    else:
        hit = hit.select("u", "r.*")
    done = hit.select(F.col("u").alias(url), "rule_id", F.regexp_replace(F.col("u"), F.col("pattern"), F.col("target")).alias("rewritten"))
    return rows.join(done, url, "left")
