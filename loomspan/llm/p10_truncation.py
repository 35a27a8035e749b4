"""Problem 10: texts cut off by a field's length or during transfer.

Method: for every source a log-normal length distribution, right-censored
at the source's candidate limits, is fitted by maximum likelihood; the
censoring posterior of each value at those limits is combined with the
evidence of how its text ends.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import materialize, read_table

# Marks of omission that a shortening writer adds.
_MARK = r"(?:\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|[\(\[](?:more|mehr|weiter|suite|la suite|lire la suite|más|leer más|mais|ler mais|więcej|ещё|далее|read more|continued)[\)\]]|…|\.\.\.))+\s*$"
_CLOSE = r"[\"'”»“’‘›)\]*_]*"
_NAME = r"\p{Lu}[\p{L}\p{M}’'\-]+"
_BULLET = r"(?:[-–—•*·▪]|\d{1,3}[.)])"

#: Kinds of ending. "open" and "marked" ones stop inside a sentence; the others
#: end without a full stop but are how links, list items, signatures, credits,
#: captions and headings end, "line" being one line without any sentence.
#: "closed" texts end with a sentence and are complete by definition.
KINDS = ("closed", "marked", "open", "link", "listed", "signed", "credit", "named", "line")
#: A limit needs this many values that end in any way but closed at it.
MIN_AT_LIMIT = 3
CUT_AT = 0.5
#: Pseudo-count of every kind of ending in the learned shares.
SMOOTH = 0.5


def end_kind(text: Column, title: Column | None = None) -> Column:
    """How ``text`` ends: one of KINDS (null and blank text: closed).

    The whole last line is looked at, whatever its length; a text that is its
    title is "named", a text of one line without a sentence end is "line". A
    question or exclamation that closes before an omission mark is closed.
    """
    whole = F.rtrim(text, F.lit(" \n\r\t\u00a0\u2028"))
    last = F.substring_index(whole, "\n", -1)
    marked = last.rlike(r"(?:…|\.\.\.|[\)\]])$") & last.rlike(r"(?i)" + _MARK)
    line = F.when(marked, F.regexp_replace(last, r"(?i)" + _MARK, "")).otherwise(last)
    closed = line.rlike(r"(?:[.!?。]" + _CLOSE + r"|(?:…|\.\.\.)[\"'”»“’‘›]+)$")
    finished = F.when(marked, line.rlike(r"[!?]" + _CLOSE + "$")).otherwise(closed)
    single = (F.instr(whole, "\n") == 0) & ~line.rlike(r"[.!?…]" + _CLOSE + r"\s") & ~line.rlike(r"[,;:–—\-(«“„]$")
    link = line.rlike(r"(?:^|\s)(?:https?://|www\.)\S+$")
    listed = line.rlike(rf"^\s*{_BULLET}\s+\S") | line.rlike(rf"[.!?]{_CLOSE}\s+{_BULLET}\s+\d[^.!?]*$")
    signed = line.rlike(rf"^\s*(?:[-–—]\s*)?{_NAME}(?:\s+(?:[a-z]{{1,3}}\s+)?{_NAME}){{1,2}}$") & (F.instr(whole, "\n") > 0)
    credit = line.rlike(rf"^\s*{_NAME}(?: [\p{{L}}]+)?\s?:\s+{_NAME}(?:[ ,]+{_NAME})*$") | line.rlike(rf"[.!?]{_CLOSE}\s+{_NAME}\s?:\s+{_NAME}(?:[ ,]+{_NAME})*$")
    named = F.coalesce(F.trim(title) == F.trim(whole), F.lit(False)) if title is not None else F.lit(False)
    return (
        F.when(text.isNull() | (whole == "") | finished, "closed").when(marked, "marked").when(link, "link").when(listed, "listed")
        .when(signed, "signed").when(credit, "credit").when(named, "named").when(single, "line").otherwise("open")
    )


def length_histogram(ends: DataFrame) -> DataFrame:
    """(source, unit, len, n, n_unclosed): pre-aggregated, so a hot source costs no more than a small one."""
    # characters and UTF-8 bytes are both counted, as fields are limited in either
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("len")))).alias("u")
    return (
        ends.select("source", "kind", units)
        .groupBy("source", "u.unit", "u.len")
        .agg(F.count("*").alias("n"), F.count_if(F.col("kind") != "closed").alias("n_unclosed"))
    )


def _phi(z: float) -> float:
    return math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _upper(z: float) -> float:
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)


def fit_censored(hist: pd.DataFrame, limit_lengths: set[int], rounds: int = 60) -> tuple[float, float, float]:
    """ML fit (EM) of a log-normal right-censored at ``limit_lengths``: (mu, sigma, mass)."""
    x = [math.log(max(1, v)) for v in hist["len"]]
    n = [float(v) for v in hist["n"]]
    cens = [v in limit_lengths for v in hist["len"]]
    total = sum(n)
    mu = sum(a * b for a, b in zip(x, n)) / total
    sd = max(0.05, math.sqrt(sum(b * (a - mu) ** 2 for a, b in zip(x, n)) / total))
    for _ in range(rounds):
        s1 = s2 = 0.0
        for a, b, c in zip(x, n, cens):
            if c:  # expected value and square beyond the limit
                z = (a - mu) / sd
                h = _phi(z) / _upper(z)
                m = mu + sd * h
                s1, s2 = s1 + b * m, s2 + b * (sd * sd * (1 + z * h - h * h) + m * m)
            else:
                s1, s2 = s1 + b * a, s2 + b * a * a
        new_mu = s1 / total
        new_sd = math.sqrt(max(0.0025, s2 / total - new_mu**2))
        done = abs(new_mu - mu) + abs(new_sd - sd) < 1e-6
        mu, sd = new_mu, new_sd
        if done:
            break
    return mu, sd, total


def _limits_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source and unit with the censoring posterior at each."""
    pdf = pdf.sort_values("len")
    lengths = pdf["len"].to_numpy()
    n, unclosed = pdf["n"].to_numpy(float), pdf["n_unclosed"].to_numpy(float)
    share = unclosed.sum() / max(1.0, n.sum())
    candidates = {int(v) for v, k, m in zip(lengths, n, unclosed) if m >= MIN_AT_LIMIT and m > 2 * share * k}
    rows = []
    if candidates:
        mu, sd, total = fit_censored(pdf, candidates)
        for v, k, m in zip(lengths, n, unclosed):
            if int(v) in candidates:
                z = (math.log(v) - mu) / sd
                expected = total * _phi(z) / (sd * v)  # uncensored values of just this length
                rows.append((pdf["source"].iloc[0], pdf["unit"].iloc[0], int(v), int(k), int(m), float(expected), float(max(0.0, 1 - expected / k))))
    return pd.DataFrame(rows, columns=["source", "unit", "len", "n_at", "n_unclosed", "expected", "posterior"])


LIMIT_SCHEMA = "source string, unit string, len long, n_at long, n_unclosed long, expected double, posterior double"


def source_limits(hist: DataFrame) -> DataFrame:
    """Per source and unit: the candidate limits and the censoring posterior there.

    Works on the histogram, of which one source has at most one row per
    distinct length, so the group in a task is bounded by the longest text.
    """
    return hist.groupBy("source", "unit").applyInPandas(_limits_of, LIMIT_SCHEMA)


#: A "line" is judged by its length as well: half-octaves of characters.
def _evidence(kind: Column, chars: Column) -> Column:
    octave = F.floor(2 * F.log2(F.greatest(chars, F.lit(1)).cast("double")))
    return F.when(kind == "line", F.concat(F.lit("line"), octave.cast("string"))).otherwise(kind)


def ending_odds(counts: list[tuple[str, float, float, float]]) -> tuple[dict[str, float], float]:
    """({evidence: log P(evidence | cut) / P(evidence | complete)}, log-odds of a cut away from the limits).

    ``counts``: (evidence, values away from every limit, values at limits,
    censored values at limits as the posterior expects them). What stands at
    the limits beyond the background is cut for certain and shows how cuts
    end. Away from the limits cut and complete texts are mixed; the share of
    cuts there is the largest that the texts stopping inside a sentence
    allow, and what remains shows how complete texts end.
    """
    away, at, cens = ({e: row[k] for e, *row in counts} for k in range(3))
    n_away, n_at, n_cens = sum(away.values()), sum(at.values()), sum(cens.values())
    kinds = sorted(away)
    k = max(1, len(kinds))
    # the background at the limits has the mix found away from them
    back = max(0.0, n_at - n_cens) / max(1.0, n_away)
    inside = ("open", "marked")
    if n_cens >= MIN_AT_LIMIT:
        raw = {e: max(0.0, at[e] - back * away[e]) for e in kinds}
    else:  # nothing is censored: a cut stops inside a sentence
        raw = {e: away[e] + at[e] if e in inside else 0.0 for e in kinds}
    total = sum(raw.values()) + SMOOTH * k
    p_cut = {e: (raw[e] + SMOOTH) / total for e in kinds}
    share = min(0.5, sum(away.get(e, 0.0) for e in inside) / max(1.0, n_away) / max(1e-9, sum(p_cut.get(e, 0.0) for e in inside) or 1.0))
    rest = {e: max(0.0, away[e] - share * n_away * p_cut[e]) if e not in inside else 0.0 for e in kinds}
    total = sum(rest.values()) + SMOOTH * k
    odds = {e: math.log(p_cut[e]) - math.log((rest[e] + SMOOTH) / total) for e in kinds}
    share = max(share, 1e-4)
    return odds, math.log(share / (1 - share))


def truncation_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, source, kind, posterior, p_cut) for every document.

    The log-odds of a cut are those of the censoring posterior of the value's
    length (away from every limit: of the share of cuts there) plus what the
    ending is worth, which is learned from this very table. Null or blank
    texts are never cut; a null source is a source of its own; repeated rows
    are scored alike; extra columns are ignored; an empty table gives no rows.
    """
    title = F.col("title") if "title" in docs.columns else None
    ends = docs.select("doc_id", F.coalesce("source", F.lit("\u0000")).alias("source"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), end_kind(F.col("text"), title).alias("kind")).filter(F.col("chars").isNotNull())
    ends = materialize(ends, "p10")
    limits = materialize(source_limits(length_histogram(ends)), "p10lim")
    # a source has at most 1 / MIN_AT_LIMIT of its rows as limits; shuffle join on (source, length) spreads a hot source by length
    by = lambda unit, col: limits.filter(F.col("unit") == unit).select("source", F.col("len").alias(col), F.col("posterior").alias(f"post_{unit}"))
    j = ends.join(by("chars", "chars"), ["source", "chars"], "left").join(by("bytes", "bytes"), ["source", "bytes"], "left")
    post = F.greatest(F.coalesce("post_chars", F.lit(0.0)), F.coalesce("post_bytes", F.lit(0.0)))
    j = materialize(j.select("doc_id", F.nullif("source", F.lit("\u0000")).alias("source"), "kind", _evidence(F.col("kind"), F.col("chars")).alias("evidence"), post.alias("posterior")), "p10j")
    # one row per kind of ending, however many documents
    seen = j.groupBy("evidence").agg(F.count_if(F.col("posterior") == 0).alias("away"), F.count_if(F.col("posterior") > 0).alias("at"), F.sum("posterior").alias("cens")).collect()
    odds, base = ending_odds([(r.evidence, float(r.away), float(r["at"]), float(r.cens)) for r in seen])
    value = F.lit(0.0)
    for name, x in odds.items():
        value = F.when(F.col("evidence") == name, F.lit(x)).otherwise(value)
    clipped = F.least(F.lit(0.9999), F.greatest(F.lit(0.0001), F.col("posterior")))
    prior = F.greatest(F.lit(base), F.log(clipped / (1 - clipped)))
    # a text that ends with its sentence is complete, wherever a limit lies
    p_cut = F.when(F.col("kind") == "closed", 0.0).otherwise(1 / (1 + F.exp(-(prior + value))))
    return j.select("doc_id", "source", "kind", "posterior", p_cut.alias("p_cut"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_scores(read_table(spark, sf_dir, "documents")).filter(F.col("p_cut") > CUT_AT).select("doc_id").distinct()


def p10_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: its documents, the cut ones and their share."""
    s = truncation_scores(read_table(spark, sf_dir, "documents"))
    cut = F.count_if(F.col("p_cut") > CUT_AT)
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), cut.alias("n_cut"), F.round(cut / F.count("*"), 6).alias("share_cut"))


QUERIES = {"p10_found": p10_found, "p10_source_rates": p10_source_rates}
