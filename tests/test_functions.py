from pyspark.sql import functions as F

from loomspan.functions import network as N
from loomspan.functions import scoring as S
from loomspan.functions import text as X
from loomspan.functions import urls as U


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_registrable_domain(spark):
    for host, want in {"www.example.com.au": "example.com.au", "markhewittphotography.co.uk": "markhewittphotography.co.uk", "192.168.0.1": "192.168.0.1", None: "", "a.b.c.org": "c.org"}.items():
        assert one(spark, host, U.registrable_domain) == want


def test_strip_tracking(spark):
    cases = {
        "https://a.test/p?utm_source=x&id=5&fbclid=abc": "https://a.test/p?id=5", "https://a.test/p?utm_source=x#frag": "https://a.test/p#frag",
        "https://a.test/p?sig=b&exp=a": "https://a.test/p?sig=b&exp=a", "https://a.test/p": "https://a.test/p", None: None,
    }
    for url, want in cases.items():
        assert one(spark, url, U.strip_tracking_params) == want


def test_normalize_url(spark):
    assert one(spark, "HTTP://A.Test/x/x/x/y/?b=2&utm_id=1&a=1#f", U.normalize_url) == "http://a.test/x/y?a=1&b=2"
    assert one(spark, "http://a.test/x/x/y", U.normalize_url) == "http://a.test/x/x/y"


def test_site_of(spark):
    assert one(spark, " <https://WWW.News.Example:443/x> ", U.site_of) == "news.example"
    assert one(spark, None, U.site_of) is None


def test_jaccard(spark):
    j = lambda a, b: spark.range(1).select(X.jaccard(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>")).alias("r")).first().r
    assert j(["the", "quick", "brown", "fox"], ["the", "quick", "brown", "dog"]) == 0.6
    assert j([], []) == 1.0
    assert j(["a"], []) == 0.0


def test_title_normalize(spark):
    assert one(spark, "Article | Brand News", X.title_normalize) == one(spark, "Article — Official Site", X.title_normalize) == "article"
    assert one(spark, "Qwen-27B", X.title_normalize) == "qwen 27b"


def test_phrase_gate(spark):
    q = lambda text: spark.createDataFrame([("Sara St James", text)], "q string, t string").select(S.content_relevance(F.col("q"), F.col("t")).alias("r")).first().r
    assert q("Sara St. James biography") > 0
    assert q("James and Sara") == 0
    assert q(None) == 0


def test_authority(spark):
    f = lambda q, t, u, s="": spark.createDataFrame([(q, t, u, s)], "q string, t string, u string, s string").select(S.authority_factor(*map(F.col, "qtus")).alias("r")).first().r
    assert f("python asyncio", "x", "https://docs.python.org/3") == 1.6
    assert f("kiln-shelf sizes", "other", "https://a.test/") == 0.3
    assert f("flood 2019", "flood of 2015", "https://a.test/") == 0.3
    assert f("plain words", "nothing", "https://a.test/") == 1.0


def test_unsafe_url(spark):
    for url, want in {"http://10.1.2.3/": True, "ftp://a.test/": True, "https://a.test/": False, "http://100.64.0.1/": True, "http://8.8.8.8/": False, "http://localhost:80/": True}.items():
        assert one(spark, url, N.unsafe_url) is want


def test_retry_after(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    for value, want in {"120": 120.0, "-5": 0.0, "Thu, 01 Jan 2026 00:02:00 GMT": 120.0, "soon": None}.items():
        assert one(spark, value, lambda c: N.retry_after(c, now)) == want


def test_challenge_and_login(spark):
    assert one(spark, "Just a moment... Checking", X.challenge_kind) == "cloudflare"
    assert one(spark, "plain", X.challenge_kind) is None
    assert one(spark, "Please log in. You must be logged in to read this. Sign in to continue here.", X.is_login_gate) is True
    assert one(spark, None, X.is_login_gate) is False


def test_disposition(spark):
    for url, want in {"https://t.co/x": "blocked", "https://a.test/": "homepage", "https://a.test/search?q=1": "search", "https://vimeo.com/1": "video", "https://a.test/ads/banner.html": "ad", "https://a.test/story": "kept"}.items():
        assert one(spark, url, U.disposition) == want
