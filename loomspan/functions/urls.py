"""URL expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import constants as C

_EDGE = r"[\s\p{Z}<>\"'()\[\]{},;.«»“”„‘’`|]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def trim_edges(url: Column) -> Column:
    """Strip white space and punctuation that surrounds a pasted address."""
    return F.regexp_replace(url, f"^{_EDGE}+|{_EDGE}+$", "")


def percent_decode(text: Column) -> Column:
    """Decode %XX as UTF-8; '+' stays; text that cannot be decoded stays as it is."""
    plain = ~text.contains("%")
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(plain, text).otherwise(F.coalesce(decoded, text))


def site_of(url: Column) -> Column:
    """Host of ``url``: lower case, no port, no leading ``www.``; null for null."""
    rest = F.regexp_replace(trim_edges(url), r"^[A-Za-z][A-Za-z0-9+.\-]*:/*", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?#@\\]*@)?([^/?#:\\]*)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.regexp_replace(host, r"^www\.", "")


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def netloc_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def host_of(url: Column) -> Column:
    """Host name: lower case, without user and port; "" where there is none."""
    return F.regexp_extract(netloc_of(url), r"^(?:[^@]*@)?([^:]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _pairs(query: Column) -> Column:
    return F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(C.TRACKING_PARAMS))


def normalize_url(url: Column) -> Column:
    """Scheme and host lower case, one closing slash off, runs of three or more
    equal path segments made one, tracking fields and fragment dropped, other
    fields sorted. What is no absolute url stays as it is."""
    path = F.regexp_replace(path_of(url), "/$", "")
    path = F.regexp_replace(path, r"(/[^/]+)\1{2,}(?=/|$)", "$1")
    query = F.array_join(F.array_sort(_pairs(query_of(url))), "&")
    out = F.concat(scheme_of(url), F.lit("://"), netloc_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme_of(url) == "", url).otherwise(out)


def strip_tracking_params(url: Column) -> Column:
    """Drops tracking fields only; order, bytes and fragment of the rest stay."""
    query, fragment = query_of(url), F.regexp_extract(url, r"^[^#]*(#.+)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(C.TRACKING_PARAMS))
    base = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    out = F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), fragment)
    return F.when((query == "") | (F.size(kept) == F.size(F.split(query, "&"))), url).otherwise(out)


def registrable_domain(host: Column, suffixes: Sequence[str] = tuple(C.MULTI_LABEL_SUFFIXES)) -> Column:
    """Last two labels, three under one of the two-label ``suffixes``; IPv4 hosts stay; null gives ""."""

    def of(h: Column) -> Column:
        last = lambda k: F.substring_index(h, ".", -k)
        return F.when(h.rlike(r"^(?:\d{1,3}(?:\.\d{1,3}){3}|[^.]*(?:\.[^.]*)?)$"), h).when(last(2).isin(list(suffixes)), last(3)).otherwise(last(2))

    return let(F.regexp_replace(F.lower(F.trim(F.coalesce(host, F.lit("")))), r"\.+$", ""), of)


def host_in(host: Column, domains: list[str]) -> Column:
    """Is the host one of ``domains`` or below one? Dot boundaries, a set lookup per suffix."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.exists(suffixes, lambda s: s.isin(domains))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def in_allowlist(url: Column, allow: Sequence[str]) -> Column:
    return host_in(host_of(url), list(allow)) if allow else F.lit(False)


def third_party(url: Column, page_url: Column, suffixes: Sequence[str] = tuple(C.MULTI_LABEL_SUFFIXES)) -> Column:
    """Do both have a host, under different registrable domains?"""
    a, b = host_of(url), host_of(page_url)
    return F.coalesce((a != "") & (b != "") & (registrable_domain(a, suffixes) != registrable_domain(b, suffixes)), F.lit(False))


def is_ad_url(url: Column, page_url: Column | None = None, allow: Sequence[str] = (), suffixes: Sequence[str] = tuple(C.MULTI_LABEL_SUFFIXES)) -> Column:
    """An advertising host, an advertising word (or its plural) among the words of host and path, or a banner size on a third party's address.

    Hosts in or below ``allow`` never are.
    """
    words = F.split(F.lower(F.concat(netloc_of(url), F.lit("/"), path_of(url))), r"[^\p{L}\p{N}_]+")
    ad = host_in(host_of(url), C.AD_HOSTS) | F.arrays_overlap(words, F.array(*[F.lit(w + s) for w in C.AD_WORDS for s in ("", "s")]))
    if page_url is not None:
        ad = ad | (url.rlike(r"[-_/]\d{2,4}[xX]\d{2,4}[-_/.]") & third_party(url, page_url, suffixes))
    return ad & ~in_allowlist(url, allow)


def is_video_url(url: Column) -> Column:
    return contains_any(F.lower(url), C.VIDEO_PATTERNS)


def is_junk_url(url: Column) -> Column:
    return host_in(host_of(url), C.AD_HOSTS) | contains_any(F.lower(url), C.JUNK_PATTERNS)


def skip_crawl(url: Column, extra: Sequence[str] = (), allow: Sequence[str] = ()) -> Column:
    """Is the link no page worth a visit: no host, a file, an ad host, a service segment, tracking fields only?

    ``extra``: further segments, of at least three letters; hosts in or below
    ``allow`` are always visited.
    """
    path, query = F.lower(path_of(url)), query_of(url)
    segments = F.split(path, "/")
    keys = F.transform(F.split(query, "&"), lambda p: F.lower(F.substring_index(p, "=", 1)))
    endings = path.rlike(r"\.(?:" + "|".join(C.FILE_ENDINGS) + ")$")
    only = (query != "") & F.forall(keys, lambda k: k.isin(C.REDIRECT_KEYS))
    stop = [*C.SKIP_SEGMENTS, *(w for w in (e.strip().lower().strip("/") for e in extra) if len(w) >= 3)]
    ads = host_in(host_of(url), C.AD_HOSTS) | contains_any(F.lower(url), C.AD_NETWORKS)
    skip = F.when((scheme_of(url) == "") | (netloc_of(url) == ""), True).otherwise(endings | ads | F.arrays_overlap(segments, F.array(*[F.lit(s) for s in stop])) | only)
    return skip & ~in_allowlist(url, allow)


def disposition(url: Column) -> Column:
    """First reason to drop a search result: blocked, homepage, search, video, ad; else kept."""
    low, path = F.lower(url), F.regexp_replace(F.lower(path_of(url)), "^/+|/+$", "")
    return (
        F.when(host_in(host_of(url), C.BLOCKED_DOMAINS), "blocked").when(path.isin(C.HOME_PATHS), "homepage").when(contains_any(low, C.SEARCH_PATTERNS), "search")
        .when(is_video_url(url), "video").when(is_ad_url(url), "ad").otherwise("kept")
    )


def url_words(url: Column) -> Column:
    """Distinct words of at least three letters in the path, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(path_of(url)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))
