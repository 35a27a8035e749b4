"""Literal cases of the body, candidate and image rules; chunks against a plain packer."""

import random
import re

from pyspark.sql import functions as F

from loomspan.functions import pages as P
from loomspan.functions import text as X
from loomspan.functions import urls as U
from loomspan.operators import chunks as K


def each(spark, cases, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i long, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_blocked_bodies(spark):
    cases = {
        '<script>var c = {"need": "hcaptcha"}</script><form>search</form>': False, "404 page not found": False, '<a href="/cdn-cgi/l/email">mail</a>': False, "/cdn-cgi/ challenge": True,
        "Please complete the CAPTCHA": True, "g-recaptcha recaptcha": True, "": True, None: True, "plain words": False,
    }
    assert each(spark, cases, P.is_blocked) == list(cases.values())


def test_block_types(spark):
    cases = {
        "AwsWaf token": "aws_waf", "Just a moment...": "cloudflare", "recaptcha: verify": "recaptcha", "a captcha": "captcha", "Log in. Sign in to continue": "login", "403 Forbidden": "access_denied",
        "429 Too Many": "rate_limited", "503 service unavailable": "service_unavailable", "please enable JavaScript": "js_required", "enable cookies": "cookies_required", "Доступ закрыт": "regional_block", "hello": "unknown", None: "unknown",
    }
    assert each(spark, cases, P.block_type) == list(cases.values())


def test_valid_content(spark):
    long = "words and words " * 10
    cases = {long: True, "short": False, None: False, f'<form action="/x">verify your age</form>{long}': False, f'<form action="/x">age <input type=submit></form>{long}': True}
    assert each(spark, cases, P.is_valid_content) == list(cases.values())


def test_crawl_and_ads(spark):
    crawl = {"https://a.test/story": False, "https://a.test/login": True, "https://a.test/x.css": True, "https://a.test/p?utm_source=x": True, "https://a.test/p?utm_source=x&id=1": False, "/relative": True, "https://a.test/shop/1": True, "https://ok.test/login": False}
    assert each(spark, crawl, lambda u: U.skip_crawl(u, ["shop", "ab"], ["ok.test"])) == list(crawl.values())
    page = F.lit("https://gallery.test/page")
    ads = {"https://gallery.test/x-300x250.jpg": False, "https://other.test/x-300x250.jpg": True, "https://a.test/banner123": False, "https://a.test/banners/1": True, "https://ok.test/banners/1": False}
    assert each(spark, ads, lambda u: U.is_ad_url(u, page, ["ok.test"])) == list(ads.values())


def test_candidates(spark):
    q = F.lit("old mill pump")
    assert each(spark, ["https://a.test/old+mill+pump", "https://a.test/old-mill-pump", "https://a.test/old+barn", None], lambda u: P.is_keyword_soup(u, q)) == [True, False, False, None]
    assert each(spark, ["the mill pump stands", "pump of the mill", None, "windmill pump"], lambda t: P.has_query_phrase(t, q)) == [True, False, False, False]
    keys = {"https://me.tumblr.com/x/y": "me.tumblr.com/x", "https://www.a.co.uk/x": "a.co.uk", "https://bunkr.si/a": "bunkr", "https://a.test/p?utm_id=1": "a.test"}
    assert each(spark, keys, P.dedup_key) == list(keys.values())
    assert each(spark, ["https://a.test/2024/05/x", "https://a.test/123.html", "https://a.test/about"], P.is_likely_content) == [True, True, False]


def test_full_size(spark):
    cases = {
        "https://a.test/x-150x150.jpg": "https://a.test/x.jpg", "https://a.test/thumbs/x.png": "https://a.test/x.png", "https://t.a.test/x.jpg?w=200&h=100": "https://i.a.test/x.jpg",
        "https://live.staticflickr.com/1_q.jpg": "https://live.staticflickr.com/1_b.jpg", "https://a.test/x.jpg": "https://a.test/x.jpg",
    }
    assert each(spark, cases, P.full_size) == list(cases.values())


def test_clean_content_and_excerpts(spark):
    text = "Home\nThe mill was repaired in the spring of that year.\nPost a Comment here\nhttps://a.test/only\ncookie policy of us\nA second line that says something.\nOlder Post\nBlog Archive of the page\nlast words of the page"
    assert each(spark, [text, None], P.clean_content) == ["The mill was repaired in the spring of that year.\nA second line that says something.\nlast words of the page", ""]
    assert each(spark, ["a b c b c", "nothing"], lambda t: X.excerpts(t, F.lit("b c"))) == [["a b c b c", "a b c b c"], []]


def plain_pack(parts, size, sep, overlap):
    out, part = [], ""
    for s in parts:
        if part and len(part) + len(sep) + len(s) > size:
            out.append(part)
            part = (part[-overlap:] + sep).lstrip() + s if overlap else s
        else:
            part = part + sep + s if part else s
    return [*out, part] if part else out


def test_packed_equals_a_plain_packer():
    rng = random.Random(3)
    for _ in range(300):
        parts = ["x" * rng.randrange(1, 40) for _ in range(rng.randrange(12))]
        size, overlap = rng.randrange(10, 90), rng.choice([0, 5])
        assert K.packed(parts, size, " ", overlap) == plain_pack(parts, size, " ", overlap)


def test_evidence(spark):
    short, blocks = "a short text", [" ".join(f"{w}{i}" for i in range(200)) for w in ("kiln", "weir", "loom", "quay")]
    docs = spark.createDataFrame([(1, "kiln", short), (2, "loom3 loom7", "\n\n".join(blocks)), (3, None, None)], "doc_id long, q string, text string")
    got = {r.doc_id: r.evidence for r in K.evidence_of(docs, "q", 2000).collect()}
    assert got[1] == short and got[2].startswith("loom0") and len(got[2]) <= 2000 and 3 not in got
    ranks = [r for r in K.ranked_chunks(docs, "q").orderBy("doc_id", "rank").collect() if r.doc_id == 2]
    assert ranks[0].chunk_id == [i for i, c in enumerate(K.chunk_text("\n\n".join(blocks))) if re.search(r"\bloom7\b", c)][0]
