"""Text expressions: tokens, titles, page text, challenge and liveness rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import constants as C

#: A word as scripting languages see it: letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]+"
RETRIEVAL_TOKEN = r"[\p{L}\p{N}_./:#\-]+"


def retrieval_tokens(text: Column) -> Column:
    """Lower-case tokens that keep dots, slashes, colons, hashes and hyphens; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RETRIEVAL_TOKEN), 0)


def words(text: Column, least: int = 3) -> Column:
    """Lower-case words of at least ``least`` characters, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0), lambda w: F.length(w) >= least)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays: 1 for two empty ones, 0 for one empty one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def title_normalize(title: Column) -> Column:
    """Key of a title: one closing site suffix off, lower case, words apart by single spaces."""
    t = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"\s+[|\-–—·•]\s*[\p{L}\p{N}_ .'’]{1,24}$", "")
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_]+", " "))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def challenge_kind(text: Column) -> Column:
    """Vendor of a challenge page, "generic" for an unnamed one, else null."""
    low = F.lower(text)
    out = None
    for marker, vendor in C.CHALLENGE_VENDORS + [(m, "generic") for m in C.CHALLENGE_MARKERS]:
        out = F.when(low.contains(marker), vendor) if out is None else out.when(low.contains(marker), vendor)
    return out


def is_login_gate(text: Column) -> Column:
    """At least two sign-in markers in a text of at least 60 characters."""
    low = F.lower(text)
    hits = sum((low.contains(m).cast("int") for m in C.LOGIN_MARKERS), F.lit(0))
    return F.coalesce((F.length(text) >= 60) & (hits >= 2), F.lit(False))


def count_of(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of ``word`` in ``text``."""
    return (F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)


def query_words(query: Column) -> Column:
    """A query's first eight words of more than two letters."""
    return F.slice(F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: F.length(w) > 2), 1, 8)


# What marks a sentence as saying something, 0.15 each; dates count 0.1, telephone numbers and quotations 0.05.
FACT_MARKERS = [
    r"ошиб(?:ка|ки|ок)|error|fault|code\s+\w+|fail(?:ed|ure)?",
    r"причин(?:а|ы|ой)|cause|because|из-за|due to|since|поскольку",
    r"исправ(?:ить|ление)|fix|repair|resolve|решение|устран(?:ить|ение|ения)",
    r"это\s+—|означает|means|definition|describe|описание|что такое",
    r"дата|date|year|год|since|established|основан",
    r"цена|price|стоимость|от\s+\d{2,6}|\d{2,6}\s*(?:руб|р\.|₽|\$|€|£)",
]
FACT_DATE, FACT_PHONE, FACT_QUOTE = r"\b(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4})\b", r"\+?\d[\d\s\-\(\)]{7,}\d", r"[\"«»][^\"«»]{3,120}[\"»]"
# Words of page furniture, and words that begin a menu entry.
FACT_NOISE = r"select citation style|cookie|accept all|reject all|subscribe|sign up|log in|register|search site|search form|navigation|menu|skip to content|back to top|advertisement|ad\b|click here|read more|learn more|show more|load more|buy now|add to cart|checkout|free shipping|sale|discount|promo code"
FACT_MENU = r"^(?:home|about|contact|policy|terms|privacy|faq|help|news)\b"


def sentence_score(words_: Column, sentence: Column) -> Column:
    """Share of the query words in the sentence and what its markers add, at most 1; 0 without query words."""
    low = F.lower(sentence)
    score = F.size(F.filter(words_, lambda w: low.contains(w))) / F.greatest(F.size(words_), F.lit(1))
    for pattern, value in [*((m, 0.15) for m in FACT_MARKERS), (FACT_DATE, 0.1), (FACT_PHONE, 0.05), (FACT_QUOTE, 0.05)]:
        score = score + F.when(low.rlike(pattern), value).otherwise(0.0)
    return F.when(F.size(words_) == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))


def is_clean_fact(text: Column) -> Column:
    """At least fifty characters, a quarter of them (and fifteen) letters, no menu entry and no page furniture."""
    t = F.trim(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.length(t) >= 50) & ~t.rlike("(?i)" + FACT_MENU) & ~t.rlike("(?i)" + FACT_NOISE) & (letters >= F.greatest(F.lit(15), F.floor(F.length(t) * 0.25)))


def excerpts(text: Column, claim: Column, most: int = 3, radius: int = 220) -> Column:
    """Up to ``most`` windows of the text around the places that state the claim; both already flattened."""
    half, at = radius // 2, None
    places: list[Column] = []
    for _ in range(most):
        start = at + F.length(claim) if places else F.lit(1)
        at = F.nullif(F.call_function("locate", claim, text, start), F.lit(0))
        places.append(at)
    window = lambda p: F.trim(F.substring(text, F.greatest(p - half, F.lit(1)), F.length(claim) + half + F.least(p - 1, F.lit(half))))
    return F.transform(F.filter(F.array(*places), lambda p: p.isNotNull()), window)


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sentence_score_sql(words_: str, sentence: str) -> str:
    low = f"lower({sentence})"
    parts = [f"(CASE WHEN regexp_matches({low}, {_q(p)}) THEN {v}::DOUBLE ELSE 0.0::DOUBLE END)" for p, v in [*((m, 0.15) for m in FACT_MARKERS), (FACT_DATE, 0.1), (FACT_PHONE, 0.05), (FACT_QUOTE, 0.05)]]
    return f"CASE WHEN len({words_}) = 0 THEN 0.0 ELSE least(1.0::DOUBLE, len(list_filter({words_}, lambda w: contains({low}, w)))::DOUBLE / len({words_}) + {' + '.join(parts)}) END"


def clean_fact_sql(text: str) -> str:
    return f"(len({text}) >= 50 AND NOT regexp_matches({text}, '(?i)' || {_q(FACT_MENU)}) AND NOT regexp_matches({text}, '(?i)' || {_q(FACT_NOISE)}) AND len(regexp_replace({text}, '[^\\p{{L}}]', '', 'g')) >= greatest(15, floor(len({text}) * 0.25)))"


def content_relevance_sql(query: str, text: str) -> str:
    """The same value as ``content_relevance``, for queries whose words hold no sign but letters and digits."""
    norm = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"
    stop = ", ".join(_q(w) for w in C.SCORE_STOP_WORDS)
    t, pw = norm(text), f"list_filter(string_split(trim({norm(query)}), ' '), lambda w: len(w) >= 2 AND NOT w IN ({stop}))"
    hw = f"list_filter({pw}, lambda w: len(w) > 2)"
    return f"""(CASE WHEN coalesce(len({text}), 0) = 0 OR len({hw}) = 0 OR (len({pw}) >= 2 AND len(list_filter(range(1, len({pw})), lambda i: contains({t}, {pw}[i] || ' ' || {pw}[i + 1]))) = 0) THEN 0.0
 ELSE least(1.0::DOUBLE, len(list_filter({hw}, lambda w: contains({t}, w)))::DOUBLE / len({hw}) * (CASE WHEN len({text}) < 200 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END) + len(list_filter({hw}, lambda w: (len({t}) - len(replace({t}, w, ''))) / len(w) >= 3))::DOUBLE / len({hw}) * 0.2::DOUBLE) END)"""
