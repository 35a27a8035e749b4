"""Relevance, placement and category scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import constants as C
from loomspan.functions import urls as U
from loomspan.functions.text import WORD, count_of


def relevance_score(query: Column, title: Column, body: Column) -> Column:
    """Share of the query's first eight words (over two letters) that occur in title or body."""
    q = F.slice(F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: F.length(w) > 2), 1, 8)
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    hits = F.size(F.array_distinct(F.filter(q, lambda w: t.contains(w) | b.contains(w))))
    return F.when(F.size(q) == 0, 0.0).otherwise(hits / F.greatest(F.size(q), F.lit(1)))


def content_relevance(query: Column, text: Column) -> Column:
    """Share of the query's words in the text, gated by one adjacent word pair.

    A text under 200 characters counts 0.3, words that occur three times
    add up to 0.2; the result is at most 1.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")
    t = norm(F.coalesce(text, F.lit("")))
    pw = F.filter(F.split(F.trim(norm(query)), " "), lambda w: (F.length(w) >= 2) & ~w.isin(C.SCORE_STOP_WORDS))
    hw = F.filter(pw, lambda w: F.length(w) > 2)
    pairs = F.transform(F.sequence(F.lit(1), F.size(pw) - 1), lambda i: F.concat(F.element_at(pw, i), F.lit(" "), F.element_at(pw, i + 1)))
    gate = F.when(F.size(pw) >= 2, F.exists(pairs, lambda p: t.contains(p))).otherwise(True)
    n = F.greatest(F.size(hw), F.lit(1))
    base = F.size(F.filter(hw, lambda w: t.contains(w))) / n * F.when(F.length(text) < 200, 0.3).otherwise(1.0)
    often = F.size(F.filter(hw, lambda w: count_of(t, w) >= 3)) / n * 0.2
    return F.when((F.coalesce(F.length(text), F.lit(0)) == 0) | (F.size(hw) == 0) | ~gate, 0.0).otherwise(F.least(base + often, F.lit(1.0)))


def authority_factor(query: Column, title: Column, url: Column, snippet: Column, text: Column | None = None) -> Column:
    """Placement factor: official, documentation, paper and phrase boosts; penalties
    for uncovered hyphenated anchors and contradicted versions and years."""
    q = F.regexp_replace(F.lower(F.trim(query)), r"\s+", " ")
    tokens = F.regexp_extract_all(q, F.lit(WORD), 0)
    host, u = U.host_of(url), F.lower(url)
    t = F.lower(F.coalesce(title, F.lit("")))
    short = F.concat_ws(" ", t, F.lower(F.coalesce(snippet, F.lit(""))), u)
    full = F.concat_ws(" ", short, F.lower(F.coalesce(text, F.lit("")))) if text is not None else short
    official = F.lit(False)
    for word, hosts in C.OFFICIAL_HOSTS.items():
        official = official | (F.array_contains(tokens, word) & U.host_in(host, hosts))
    some = lambda ws: F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in ws]))
    docs = some(C.DOCS_WORDS) & U.contains_any(u, C.DOCS_HINTS)
    paper = some(C.PAPER_WORDS) & U.host_in(host, C.PAPER_HOSTS)
    phrase = (F.length(q) > 3) & t.contains(q)
    anchors = F.array_distinct(F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)+"), 0))
    missed = F.size(F.filter(anchors, lambda a: ~(full.contains(a) | full.contains(F.replace(a, F.lit("-"), F.lit(" "))) | full.contains(F.replace(a, F.lit("-"), F.lit(""))))))
    version, year = r"\b(\d+)\.(\d+)(?:\.(\d+))?\b", r"\b(?:19|20)\d{2}\b"
    conflict = lambda p, g: (F.size(F.regexp_extract_all(q, F.lit(p), g)) > 0) & (F.size(F.regexp_extract_all(short, F.lit(p), g)) > 0) & ~F.arrays_overlap(F.regexp_extract_all(q, F.lit(p), g), F.regexp_extract_all(short, F.lit(p), g))
    times = lambda c, f: F.when(c, f).otherwise(1.0)
    factor = times(official, C.OFFICIAL_FACTOR) * times(docs, C.DOCS_FACTOR) * times(paper, C.PAPER_FACTOR) * times(phrase, C.PHRASE_FACTOR)
    factor = factor * F.pow(F.lit(C.MISS_FACTOR), missed) * times(conflict(version, 1), C.MISS_FACTOR) * times(conflict(year, 0), C.MISS_FACTOR)
    return F.round(factor, 3)


def category_scores(url: Column, title: Column, body: Column) -> Column:
    """Array of (score, precedence, name): 3 a signal word in the body, 2 in the title, 1 in the url."""
    u, t, b = (F.lower(F.coalesce(c, F.lit(""))) for c in (url, title, body))
    out = []
    for k, (name, signals) in enumerate(C.CATEGORIES.items()):
        score = sum((b.contains(w).cast("int") * 3 + t.contains(w).cast("int") * 2 + u.contains(w).cast("int") for w in signals), F.lit(0))
        out.append(F.struct(score.alias("score"), F.lit(-k).alias("precedence"), F.lit(name).alias("name")))
    return F.array(*out)


def combine_score(relevance: Column, rrf_norm: Column, weight: float = C.COMBINE_WEIGHT) -> Column:
    return weight * relevance + (1 - weight) * rrf_norm
