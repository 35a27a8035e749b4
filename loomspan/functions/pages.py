"""Predicates and clean-up of fetched bodies, candidates and image addresses, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import constants as C
from loomspan.functions import urls as U
from loomspan.functions.text import strip_tags

# Phrases that only a page which blocks the reader holds.
BLOCK_PHRASES = [
    "cf-chl-check", "checking your browser", "please verify you are human", "access denied", "403 forbidden", "429 too many", "503 service unavailable", "challenge-platform",
    "browser left", "attention required", "anomaly-detected", "perimeterx", "px-captcha", "turn on javascript", "enable cookies", "javascript is disabled",
    "enable javascript and then reload", "you need to enable javascript", "requires javascript",
    "данный контент недоступен", "доступ к данной странице ограничен", "эта страница недоступна", "контент заблокирован", "доступ запрещён", "доступ закрыт",
    "доступ к информационному ресурсу ограничен", "информация на данной странице ограничена", "ресурс заблокирован", "доступ временно ограничен", "доступ приостановлен",
    "please complete the captcha", "enter the captcha", "complete the captcha to continue",
]
# Words that block only together with one of the others.
BLOCK_PAIRS = [
    ("hcaptcha", ["challenge", "<iframe", "hcaptcha-widget"]),
    ("recaptcha", ["verify", "g-recaptcha"]),
    ("cdn-cgi", ["challenge", "cf-chl"]),
]
# Codes of what blocks, in order of precedence, by phrase.
AWS_WAF = ["awswaf", "token.awswaf", "challenge.js", "aws.waf", "awswaf-token"]
CLOUDFLARE = ["cf-chl-check", "checking your browser", "challenge-platform", "cf_chl_", "cf-chl-", "cf-clearance", "turnstile", "attention required", "just a moment"]
JS_REQUIRED = ["turn on javascript", "javascript is disabled", "enable javascript and then reload", "you need to enable javascript", "requires javascript", "enable javascript"]
REGIONAL = ["данный контент недоступен", "доступ к данной странице ограничен", "эта страница недоступна", "контент заблокирован", "доступ запрещён", "доступ закрыт", "ресурс заблокирован", "доступ временно ограничен", "доступ приостановлен"]
LOGIN_CHARS = 20_000
# Wording of robot checks in titles and snippets.
BOT_CHALLENGE = (
    r"captcha|cloudflare|are you a robot|are you not a robot|verify you are human|verify you are a human|verify your identity|checking your browser|attention required|access is denied|ddg verification"
    r"|robot challenge|sorry, you have been blocked|please enable javascript"
)
# Lines and short phrases of page furniture, and what begins the end matter of a page.
NOISE_LINES = [
    r"Posted by \w+ at \d+:\d+", r"Email This BlogThis!", r"Share to \w+", r"Blog Archive", r"Newer Post", r"Older Post", r"Subscribe to:", r"Post a Comment", r"No comments:", r"Labels?:", r"Powered by",
    r"Picture Window theme", r"©\d{4}", r"Followers", r"About Me", r"View web version", r"Home\s+About\s+Privacy", r"Desktop Version", r"Mobile Version", r"Login to add", r"Have your say",
    r"Edit Page", r"Help keep", r"Recommended$", r"Six Degrees", r"Contributors$", r"Top Contributors", r"Follow .* on Facebook", r"\d{4}\s*►|►\s*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)",
    r"Original Resolution:", r"Jump to navigation", r"Jump to search", r"Picture Of", r"See more ideas",
]
NOISE_PHRASES = [
    "about", "faq", "copyright policy", "privacy notice", "terms of service", "remove ads", "cookie policy", "contact us", "advertise", "what is", "there are some things",
    "we would also be interested", "discussions", "have your say", "be the first to make a comment",
]
END_MATTER = r"Blog Archive|Newer Post|Older Post|Subscribe to|Picture Window"
# Hosts under which every first path segment is a site of its own.
PLATFORMS = [
    "blogspot.com", "blogspot.co.uk", "blogspot.de", "blogspot.fr", "wordpress.com", "wordpress.org", "livejournal.com", "dreamwidth.org", "tumblr.com", "posterous.com", "typepad.com", "webnode.com",
    "wixsite.com", "weebly.com", "substack.com", "medium.com", "github.io", "gitlab.io", "forumhouse.ru", "pikabu.ru",
]
# One site under several hosts.
MIRRORS = {"bunkr.fi": "bunkr", "bunkr.ci": "bunkr", "bunkr.ax": "bunkr", "bunkr.si": "bunkr"}
# Words of addresses that hold content, and of galleries.
CONTENT_WORDS = [
    "view", "show", "gallery", "album", "photo", "image", "pic", "media", "full", "display", "post", "entry", "article", "story", "video", "watch", "page", "item", "content", "viewer", "collection",
    "detail", "preview", "original", "fullsize", "large", "thread", "threads", "posts",
]
GALLERY_WORDS = ["gallery", "wallpapers", "wallpaper", "ai-generated", "artwork", "ai-art", "art-ai", "generated", "photo", "photos", "pictures", "pics", "illustration", "image", "img", "text2img", "text-to-image"]
# Words that build no phrase of a query.
PHRASE_STOP_WORDS = [
    "the", "and", "for", "with", "from", "that", "this", "are", "was", "has", "had", "have", "not", "but", "can", "will", "all", "any", "free", "image", "gallery", "photo", "photos", "picture", "pictures",
    "video", "videos", "forum", "site", "web", "online", "best", "top", "new", "old", "more", "very", "just", "about", "also",
]
IMAGE_ENDING = r"\.(?:jpe?g|png|gif|webp|avif|bmp|svgz?)(?:$|[?#])"


def is_blocked(html: Column) -> Column:
    """Does the body block the reader? A missing body does; a mere mention of a robot check does not."""
    low = F.lower(html)
    out = U.contains_any(low, BLOCK_PHRASES)
    for word, others in BLOCK_PAIRS:
        out = out | (low.contains(word) & U.contains_any(low, others))
    return F.when(F.coalesce(html, F.lit("")) == "", True).otherwise(out)


def block_type(html: Column) -> Column:
    """What blocks, as a stable code, the most specific first; "unknown" where nothing does."""
    low = F.lower(html)
    has = lambda *ws: U.contains_any(low, list(ws))
    logins = sum((low.contains(m).cast("int") for m in C.LOGIN_MARKERS), F.lit(0))
    return (
        F.when(F.coalesce(html, F.lit("")) == "", "unknown").when(has(*AWS_WAF), "aws_waf").when(has(*CLOUDFLARE), "cloudflare").when(has("recaptcha") & has("g-recaptcha", "verify"), "recaptcha")
        .when(has("captcha"), "captcha").when((logins >= 2) & (F.length(html) < LOGIN_CHARS), "login").when(has("access denied", "403 forbidden"), "access_denied").when(has("429 too many"), "rate_limited")
        .when(has("503 service unavailable"), "service_unavailable").when(has(*JS_REQUIRED), "js_required").when(has("enable cookies"), "cookies_required").when(has(*REGIONAL), "regional_block").otherwise("unknown")
    )


def is_valid_content(html: Column) -> Column:
    """At least fifty characters of text, and no form that only asks for an age, a check or consent."""
    form = F.lower(F.regexp_extract(html, r"(?s)<form[^>]*>(.*?)</form>", 1))
    asks = U.contains_any(form, ["age", "verify", "captcha", "cookie"]) & ~(form.contains("input") & form.contains("submit"))
    gate = html.rlike(r"<form[^>]*action") & asks
    return F.coalesce((F.length(strip_tags(html)) >= 50) & ~gate, F.lit(False))


def is_bot_challenge(*texts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]).rlike("(?i)" + BOT_CHALLENGE)


def is_reader_antibot(body: Column) -> Column:
    """A reader service's rendering of a robot check: its warning with the check's structure, or a named vendor's block page."""
    low = F.lower(F.coalesce(body, F.lit("")))
    warned = low.contains("warning:") & U.contains_any(low, ["requiring captcha", "requires captcha"])
    built = U.contains_any(low, ["title: just a moment...", "## performing security verification", "title: attention required! | cloudflare"])
    named = low.contains("title: attention required! | cloudflare") & U.contains_any(low, ["ray id", "/cdn-cgi/challenge-platform/"])
    return (warned & built) | named


def clean_content(text: Column) -> Column:
    """The lines that say something, up to the end matter: ten characters at least, no furniture, no bare address."""
    noise = "(?i)" + "|".join(NOISE_LINES)
    keep = lambda x: (F.length(x) >= 10) & ~x.rlike(noise) & ~((F.length(x) < 40) & U.contains_any(F.lower(x), NOISE_PHRASES)) & ~(x.startswith("http") & ~x.contains(" "))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), keep)
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), rf"(?s)(?:{END_MATTER}).*", ""), r"^\s+|\s+$", "")


def is_pdf_url(url: Column) -> Column:
    low = F.lower(url)
    return U.path_of(low).rlike(r"\.pdf$") | (U.host_in(U.host_of(low), ["arxiv.org"]) & U.path_of(low).contains("/pdf/"))


def dedup_key(url: Column, suffixes: Sequence[str] = tuple(C.MULTI_LABEL_SUFFIXES)) -> Column:
    """Whose page it is: host and first path segment on platforms, else the registrable domain."""

    def of(u: Column) -> Column:
        first = F.split(F.regexp_replace(U.path_of(u), "^/+|/+$", ""), "/")[0]
        mirrors = F.create_map(*[F.lit(x) for pair in MIRRORS.items() for x in pair])
        own = lambda h: F.when(U.host_in(h, PLATFORMS), F.concat(h, F.lit("/"), first)).otherwise(U.registrable_domain(h, suffixes))
        return U.let(U.host_of(u), lambda h: U.let(F.coalesce(F.try_element_at(mirrors, h), h), own))

    return U.let(U.normalize_url(F.coalesce(url, F.lit(""))), of)


def is_likely_content(url: Column) -> Column:
    """Does the address look like a page of content rather than of navigation?"""
    low = F.lower(url)
    path = U.path_of(low)
    rest = F.concat_ws(" ", path, U.query_of(low), F.regexp_extract(low, r"#(.*)$", 1))
    return U.contains_any(rest, CONTENT_WORDS) | path.rlike(r"\d+\.html$|/\d{3,}|/(?:19|20)\d{2}/(?:0[1-9]|1[0-2])/")


def is_keyword_soup(url: Column, query: Column) -> Column:
    """A path of words joined by plus signs, most of them the query's."""
    path = U.path_of(url)
    words = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"[a-zа-яё]{3,}"), 0))
    tokens = F.filter(F.transform(F.split(path, r"\+"), lambda t: F.regexp_replace(t, "^[/ ]+|[/ ]+$", "")), lambda t: t != "")
    n, hits = F.size(tokens), F.size(F.filter(tokens, lambda t: F.array_contains(words, F.lower(t))))
    enough = F.when(n == 2, hits == 2).otherwise(hits >= F.greatest(F.lit(2), F.floor(n / 2)))
    return path.contains("+") & (F.size(words) >= 2) & (n >= 2) & enough


def has_query_phrase(text: Column, query: Column) -> Column:
    """Do two or three neighbouring words of the query stand together in the text?"""
    w = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda x: (F.length(x) >= 2) & ~x.isin(PHRASE_STOP_WORDS))
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, i, F.lit(2)), " "))
    low = F.lower(F.coalesce(text, F.lit("")))
    # three words that stand together hold two that do
    hit = F.exists(pairs, lambda p: F.regexp_like(low, F.concat(F.lit(r"(?:^|[^\p{L}\p{N}_])\Q"), p, F.lit(r"\E(?:$|[^\p{L}\p{N}_])"))))
    return F.when(F.size(w) >= 2, hit).otherwise(False)


def _hay(url: Column, title: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))))


def strict_match(url: Column, title: Column, query: Column) -> Column:
    """Does any query word of three letters stand in url or title?"""
    w = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda x: F.length(x) >= 3)
    return F.exists(w, lambda x: _hay(url, title).contains(x))


def matches_query(url: Column, title: Column, query: Column) -> Column:
    """A query word in url or title, or a title of thirty characters; queries without such words match all."""
    w = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda x: F.length(x) >= 3)
    return (F.size(w) == 0) | strict_match(url, title, query) | (F.length(F.trim(F.coalesce(title, F.lit("")))) >= 30)


def is_gallery(url: Column, title: Column) -> Column:
    return U.contains_any(_hay(url, title), GALLERY_WORDS)


def image_bonus(n_images: Column, gallery: Column) -> Column:
    """What a page of fifteen images or more adds to a visual query's score."""
    return F.when(gallery & (n_images >= 15), F.least((n_images - 14) * 0.02, F.lit(0.25))).otherwise(0.0)


# Rewrites from a thumbnail's address to that of the whole picture (pattern, replacement, host that it needs): sizes, size words and size fields as image hosts write them.
UPGRADES = [
    (r"(?i)-(?:\d+x\d+|small|thumb|medium|preview|thumbnail|scaled|crop|resize)(\.\w{3,4})$", "$1", None),
    (r"(?i)_(?:s|m|n|q|t|sq)(\.(?:jpg|jpeg|png|webp|gif))$", "_b$1", None),
    (r"/(?:thumbs|thumb|preview|small|medium|thumbnail|crop|resize)/", "/", None),
    (r"^https?://t\.", "https://i.", None),
    (r"^https?://thumbnails\.", "https://images.", None),
    (r"^https?://thumb\.", "https://cdn.", None),
    (r"[?&](?:w|h|width|height|size|dim|quality|q)=\d+", "", None),
    (r"\?$", "", None),
    (r"/?thumbs/", "/images/", "imgur.com"),
    (r"_b(\.\w+)$", "_o$1", "imgur.com"),
    (r"_(?:q|sq|t|s|m|n)(\.(?:jpg|jpeg|png))$", "_o$1", "staticflickr.com"),
]


def full_size(url: Column) -> Column:
    """The address of the whole picture, as far as the patterns of image hosts tell; implausible rewrites are refused."""
    out = url
    for pattern, target, host in UPGRADES:
        step = F.regexp_replace(out, pattern, target)
        out = step if host is None else F.when(out.contains(host), step).otherwise(out)
    return F.when(is_plausible_upgrade(url, out), out).otherwise(url)


def is_plausible_upgrade(original: Column, candidate: Column) -> Column:
    """Still an image: no embedded data, one query at most, and an image ending unless the original had none."""
    low = F.lower(F.trim(candidate))
    return (candidate != "") & ~low.startswith("imagus://") & ~low.startswith("data:") & (F.length(candidate) - F.length(F.replace(candidate, F.lit("?"))) <= 1) & (low.rlike(IMAGE_ENDING) | ~F.lower(original).rlike(IMAGE_ENDING))


def referrer(url: Column) -> Column:
    """The root of the site the address is on."""
    return F.when(U.netloc_of(url) != "", F.concat(U.scheme_of(url), F.lit("://"), U.netloc_of(url), F.lit("/")))


def videos(text: Column, most: int = 3) -> Column:
    """Addresses of the first distinct clips that the text names."""
    ids = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:youtube\.com/watch\?v=|youtu\.be/)([A-Za-z0-9_-]{11})"), 1))
    return F.transform(F.slice(ids, 1, most), lambda i: F.concat(F.lit("https://www.youtube.com/watch?v="), i))
