"""Per-host outcome memory: throttle ladder and wall boxes, in batch and as a state machine.

Outcomes: ok clears the streak and the box and lowers the rung by one;
throttle (429, 503) raises the rung by two; wall (blocked otherwise) boxes
the host for 15 minutes, doubled per wall in a row up to two hours. Dead
links and transport failures change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import constants as C


def outcome(alive: Column, blocked: Column, status: Column) -> Column:
    busy = status.isin(429, 503)
    return F.when(alive, "ok").when(blocked & ~F.coalesce(busy, F.lit(False)), "wall").when(busy, "throttle")


def host_key(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), r"^www\.", "")


def outcomes(log: DataFrame) -> DataFrame:
    """(host, ts, check_id, kind) of the checks that say something, each delivered row once."""
    kind = outcome(F.col("alive"), F.col("blocked"), F.col("status"))
    rows = log.dropDuplicates(["check_id"]).select(host_key(F.col("host")).alias("host"), F.unix_micros("checked_at").alias("ts"), "check_id", kind.alias("kind"))
    return rows.filter("host is not null and host <> '' and ts is not null and kind is not null")


def fold_run(events: Column) -> Column:
    """One run of outcomes, in order, as a function of the state before it.

    The rung goes through x -> min(hi, max(lo, x + add)), a family closed
    under composition, so runs can be folded apart and joined later.
    """
    start = F.struct(F.lit(0).alias("add"), F.lit(0).alias("lo"), F.lit(C.MAX_RUNG).alias("hi"), F.lit(0).alias("walls"), F.lit(False).alias("seen_ok"), F.lit(-1).cast("long").alias("last_wall"), F.lit(0).alias("n_walls"), F.lit(0).cast("long").alias("last_ts"), F.lit("").alias("last_kind"))

    def one(s: Column, e: Column) -> Column:
        ok, wall = e.kind == "ok", e.kind == "wall"
        d = F.when(ok, -1).when(e.kind == "throttle", 2).otherwise(0)
        clamp = lambda x: F.least(F.lit(C.MAX_RUNG), F.greatest(F.lit(0), x + d))
        return F.struct(
            (s.add + d).alias("add"), clamp(s.lo).alias("lo"), clamp(s.hi).alias("hi"), F.when(ok, 0).otherwise(s.walls + wall.cast("int")).alias("walls"), (s.seen_ok | ok).alias("seen_ok"),
            F.when(ok, F.lit(-1).cast("long")).when(wall, e.ts).otherwise(s.last_wall).alias("last_wall"), (s.n_walls + wall.cast("int")).alias("n_walls"), e.ts.alias("last_ts"), e.kind.alias("last_kind"),
        )

    return F.aggregate(events, start, one)


STATE = "host string, rung int, wall_streak int, boxed_until double, last_seen double, verdict string, n_walls long"


def box_seconds(streak: int) -> int:
    return min(C.BOX_BASE * 2 ** min(streak - 1, 20), C.BOX_CAP)


def join_runs(runs: Column) -> Column:
    """The state after all runs of a host, in order."""
    start = F.struct(F.lit(0).alias("rung"), F.lit(0).alias("streak"), F.lit(0.0).alias("box"), F.lit(0.0).alias("last"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("n"))

    def one(s: Column, r: Column) -> Column:
        streak = F.when(r.seen_ok, 0).otherwise(s.streak) + r.walls
        seconds = F.least(C.BOX_BASE * F.pow(F.lit(2.0), F.least(streak - 1, F.lit(20))), F.lit(float(C.BOX_CAP)))
        box = F.when(r.walls > 0, r.last_wall / 1e6 + seconds).when(r.seen_ok, 0.0).otherwise(s.box)
        return F.struct(
            F.least(r.hi, F.greatest(r.lo, s.rung + r.add)).alias("rung"), streak.alias("streak"), box.alias("box"), (r.last_ts / 1e6).alias("last"), r.last_kind.alias("kind"), (s.n + r.n_walls).alias("n"),
        )

    return F.aggregate(runs, start, one)


def wall_states(log: DataFrame, run_hours: int = 6) -> DataFrame:
    """The state of every host after all its checks in order of time.

    A host's checks are folded in runs of ``run_hours``, so a host that
    holds a third of all rows is spread over its history; what is joined per
    host is one row a run. Hosts of which nothing is remembered (only ok)
    are left out, as the memory never learns of them.
    """
    rows = outcomes(log).withColumn("run", F.floor(F.col("ts") / (run_hours * 3_600_000_000)))
    runs = rows.groupBy("host", "run").agg(fold_run(F.array_sort(F.collect_list(F.struct("ts", "check_id", "kind")))).alias("f"), F.max(F.col("kind") != "ok").alias("bad"))
    hosts = runs.groupBy("host").agg(join_runs(F.transform(F.array_sort(F.collect_list(F.struct("run", "f"))), lambda r: r.f)).alias("s"), F.max("bad").alias("bad"))
    s = F.col("s")
    return hosts.filter("bad").select("host", s.rung.alias("rung"), s.streak.alias("wall_streak"), s.box.alias("boxed_until"), s["last"].alias("last_seen"), s.kind.alias("verdict"), s.n.alias("n_walls"))


def step(state: tuple[int, int, float, float, str, int] | None, kind: str, ts: float) -> tuple[int, int, float, float, str, int] | None:
    """One outcome applied to one host's state; None is a host never heard of."""
    if state is None and kind == "ok":
        return None
    rung, streak, box, _, _, walls = state or (0, 0, 0.0, 0.0, "", 0)
    if kind == "ok":
        return max(0, rung - 1), 0, 0.0, ts, kind, walls
    if kind == "throttle":
        return min(C.MAX_RUNG, rung + 2), streak, box, ts, kind, walls
    return rung, streak + 1, ts + box_seconds(streak + 1), ts, kind, walls + 1


def update_state(key: tuple[str], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """applyInPandasWithState function: the same machine over a stream."""
    now = state.get if state.exists else None
    rows = pd.concat(list(batches)).drop_duplicates("check_id").sort_values(["ts", "check_id"])
    for kind, ts in zip(rows["kind"], rows["ts"]):
        now = step(now, kind, ts / 1e6)
    if now is not None:
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=[c.split()[0] for c in STATE.split(", ")])


def gate(states: DataFrame, now: Column) -> DataFrame:
    """(host, allowed, wait_s, reason): may the host be fetched at ``now``, and after what wait?"""
    digest = F.conv(F.substring(F.sha2("host", 256), 1, 8), 16, 10).cast("double") / 4294967295
    wait = F.least(C.BASE_DELAY * F.pow(F.lit(2.0), F.col("rung")) * (0.75 + 0.5 * digest), F.lit(C.MAX_WAIT))
    boxed = F.coalesce(F.col("boxed_until"), F.lit(0.0)) > now
    slow = F.coalesce(F.col("rung"), F.lit(0)) > 0
    return states.select("host", (~boxed).alias("allowed"), F.round(F.when(boxed, F.col("boxed_until") - now).when(slow, wait).otherwise(0.0), 6).alias("wait_s"), F.when(boxed, "wall.cooldown").when(slow, "throttled").alias("reason"))
