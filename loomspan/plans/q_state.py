"""Fetch-log queries: liveness, wall memory in batch and as a stream, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import constants as C
from loomspan.functions import text as X
from loomspan.operators import wall as W
from loomspan.session import read_table


def wall_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.wall_states(read_table(spark, sf_dir, "fetch_log"))
    return s.select("host", "rung", "wall_streak", F.round("boxed_until", 3).alias("boxed_until"), F.round("last_seen", 3).alias("last_seen"), "verdict", F.col("n_walls").cast("long").alias("n_walls"))


def wall_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.streaming.wall_stream import run_to_end

    s = run_to_end(spark, f"{sf_dir}/fetch_log.parquet")
    return s.select("host", "rung", "wall_streak", F.round("boxed_until", 3).alias("boxed_until"), F.round("last_seen", 3).alias("last_seen"), "verdict", "n_walls")


def wall_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remembered hosts at the time of the newest entry: allowed, and after what wait."""
    states = read_table(spark, sf_dir, "wall_state")
    now = states.agg(F.max("last_seen")).first()[0]
    return W.gate(states, F.lit(now))


def page_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks by the liveness rule: enough text and words, against the flag they carry."""
    log = read_table(spark, sf_dir, "fetch_log").dropDuplicates(["check_id"])
    rule = F.coalesce((F.col("text_length") >= C.ALIVE_CHARS) & (F.col("text_words") >= C.ALIVE_WORDS) & ~F.col("blocked"), F.lit(False))
    return log.groupBy(F.lower(F.substring_index("content_type", ";", 1)).alias("content_type"), rule.alias("by_rule"), F.col("alive").alias("flag")).agg(F.count("*").alias("n"))


def http_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read_table(spark, sf_dir, "fetch_log").dropDuplicates(["check_id"])
    return log.groupBy("status", "error").agg(F.count("*").alias("n"), F.count_if("alive").alias("n_alive"), F.count_if("proxy_used").alias("n_proxy"), F.count_if("blocked").alias("n_blocked"))


def quarantine(spark: SparkSession, sf_dir: str, batch: int = 10, limit: int = 2) -> DataFrame:
    """Checks that a run in batches of ten would skip: their host was blocked twice in earlier batches.

    A check's place in its host's history is its place in the day plus the
    checks of the days before, so no task sorts a whole history. The second
    blocked check decides: every batch after its own is skipped.
    """
    log = read_table(spark, sf_dir, "fetch_log").dropDuplicates(["check_id"]).filter("host is not null").select("check_id", "host", "checked_at", F.to_date("checked_at").alias("day"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    days = log.groupBy("host", "day").agg(F.count("*").alias("n"))
    days = days.select(F.col("host").alias("h"), F.col("day").alias("d"), F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("host", "day").orderBy("checked_at", "check_id")
    pos = log.withColumn("place", F.row_number().over(order)).join(days, (F.col("host") == F.col("h")) & F.col("day").eqNullSafe(F.col("d"))).select("check_id", "host", "day", "blocked", F.floor((F.col("before") + F.col("place") - 1) / batch).alias("batch"), (F.col("before") + F.col("place")).alias("at"))
    early = pos.filter("blocked").withColumn("k", F.row_number().over(Window.partitionBy("host", "day").orderBy("at"))).filter(F.col("k") <= limit)
    last = early.groupBy("host").agg(F.element_at(F.slice(F.array_sort(F.collect_list("batch")), 1, limit), -1).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= limit)
    return pos.join(last.select("host", "last"), "host").filter(F.col("batch") > F.col("last")).select("check_id", "host", F.col("batch").cast("long").alias("batch"))


def page_block_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by the vendor their text betrays and the flag they carry."""
    kind = F.coalesce(X.challenge_kind(F.col("text")), F.when(X.is_login_gate(F.col("text")), "login"))
    return read_table(spark, sf_dir, "webtools_bridge").groupBy(kind.alias("by_text"), F.col("blocked").alias("flag")).agg(F.count("*").alias("n"))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest archived read per url, in one aggregate."""
    rows = read_table(spark, sf_dir, "webtools_bridge").filter("url is not null and wayback_ts is not null")
    return rows.groupBy("url").agg(F.max(F.struct("wayback_ts", "read_id")).alias("m")).select("url", F.col("m.wayback_ts").alias("wayback_ts"), F.col("m.read_id").alias("read_id"))


QUERIES = {
    "wall_states": wall_states, "wall_state_stream": wall_state_stream, "wall_gate": wall_gate, "page_liveness": page_liveness, "http_outcomes": http_outcomes, "quarantine": quarantine,
    "page_block_type": page_block_type, "latest_snapshot": latest_snapshot,
}

_L = "l AS (SELECT DISTINCT ON (check_id) * FROM fetch_log)"
_WALL = f"""WITH {_L}, e AS (SELECT regexp_replace(lower(trim(host)), '^www\\.', '') AS host, epoch_us(checked_at) AS ts, check_id,
 CASE WHEN alive THEN 'ok' WHEN blocked AND NOT coalesce(status IN (429, 503), false) THEN 'wall' WHEN status IN (429, 503) THEN 'throttle' END AS kind FROM l),
 o AS (SELECT *, row_number() OVER w AS k, max(CASE WHEN kind = 'ok' THEN ts END) OVER () AS x FROM e WHERE kind IS NOT NULL AND host <> '' AND host IS NOT NULL WINDOW w AS (PARTITION BY host ORDER BY ts, check_id)),
 a AS (SELECT host, list_reduce(list_prepend(0, list(CASE kind WHEN 'ok' THEN -1 WHEN 'throttle' THEN 2 ELSE 0 END ORDER BY k)), lambda s, d: least(6, greatest(0, s + d))) AS rung,
   max(CASE WHEN kind = 'ok' THEN k ELSE 0 END) AS last_ok, max(k) AS n, count(*) FILTER (kind <> 'ok') AS bad, count(*) FILTER (kind = 'wall') AS n_walls FROM o GROUP BY host),
 b AS (SELECT a.host, any_value(rung) AS rung, count(*) FILTER (kind = 'wall' AND k > last_ok) AS streak, max(CASE WHEN kind = 'wall' AND k > last_ok THEN ts END) AS last_wall, max(ts) AS last_ts, max_by(kind, k) AS verdict, any_value(a.n_walls) AS n_walls
   FROM a JOIN o USING (host) WHERE bad > 0 GROUP BY a.host)
 SELECT host, rung::INT AS rung, streak::INT AS wall_streak, CASE WHEN streak = 0 THEN 0.0 ELSE round(last_wall / 1e6 + least(900 * pow(2, least(streak - 1, 20)), 7200), 3) END AS boxed_until, round(last_ts / 1e6, 3) AS last_seen, verdict, n_walls FROM b"""

SQL = {
    "wall_states": _WALL,
    "wall_state_stream": _WALL,
    "page_liveness": f"""WITH {_L} SELECT lower(split_part(content_type, ';', 1)) AS content_type, coalesce(text_length >= 500 AND text_words >= 50 AND NOT blocked, false) AS by_rule, alive AS flag, count(*) AS n FROM l GROUP BY ALL""",
    "http_outcomes": f"WITH {_L} SELECT status, error, count(*) AS n, count(*) FILTER (alive) AS n_alive, count(*) FILTER (proxy_used) AS n_proxy, count(*) FILTER (blocked) AS n_blocked FROM l GROUP BY ALL",
    "quarantine": f"""WITH {_L}, p AS (SELECT check_id, host, coalesce(blocked, false)::INT AS b, (row_number() OVER (PARTITION BY host ORDER BY checked_at, check_id) - 1) // 10 AS batch FROM l WHERE host IS NOT NULL),
 g AS (SELECT host, batch, sum(b) AS k FROM p GROUP BY ALL), h AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY host ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
 SELECT check_id, p.host, p.batch FROM p JOIN h USING (host, batch) WHERE before >= 2""",
    "page_block_type": f"""SELECT coalesce(CASE {" ".join(f"WHEN contains(lower(text), '{m}') THEN '{v}'" for m, v in C.CHALLENGE_VENDORS)} {" ".join("WHEN contains(lower(text), '" + m.replace("'", "''") + "') THEN 'generic'" for m in C.CHALLENGE_MARKERS)} END,
 CASE WHEN len(text) >= 60 AND {" + ".join(f"contains(lower(text), '{m}')::INT" for m in C.LOGIN_MARKERS)} >= 2 THEN 'login' END) AS by_text, blocked AS flag, count(*) AS n FROM webtools_bridge GROUP BY ALL""",
    "latest_snapshot": "SELECT url, wayback_ts, read_id FROM (SELECT url, wayback_ts, read_id, row_number() OVER (PARTITION BY url ORDER BY wayback_ts DESC, read_id DESC) AS k FROM webtools_bridge WHERE url IS NOT NULL AND wayback_ts IS NOT NULL) WHERE k = 1",
    "wall_gate": """WITH n AS (SELECT max(last_seen) AS now FROM wall_state), x AS (SELECT *, coalesce(boxed_until, 0) > now AS boxed, coalesce(rung, 0) > 0 AS slow,
 ('0x' || substr(sha256(host), 1, 8))::BIGINT / 4294967295.0 AS j FROM wall_state, n)
 SELECT host, NOT boxed AS allowed, round(CASE WHEN boxed THEN boxed_until - now WHEN slow THEN least(0.2 * pow(2, rung) * (0.75 + 0.5 * j), 7.0) ELSE 0.0 END, 6)::DOUBLE AS wait_s, CASE WHEN boxed THEN 'wall.cooldown' WHEN slow THEN 'throttled' END AS reason FROM x""",
}
