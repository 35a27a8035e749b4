import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.operators import chunks as K
from loomspan.operators import selection as L
from loomspan.operators import wall as W
from loomspan.operators.simjoin import similar_pairs
from loomspan.sources import feeds, html


def test_similar_pairs_equals_brute_force(spark):
    rng = random.Random(3)
    base = [rng.sample(range(40), 12) for _ in range(15)]
    rows = [(i, [str(x) for x in set(rng.choice(base)[: rng.randint(9, 12)] + rng.sample(range(40), 1))]) for i in range(80)] + [(80, []), (81, ["1"]), (82, ["1"])]
    got = similar_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", 0.7).collect()
    sets = {i: frozenset(t) for i, t in rows if t}
    first: dict = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(first[s], i) for i, s in sets.items() if first[s] != i}
    for a, b in itertools.combinations(first, 2):
        if len(a & b) / len(a | b) >= 0.7 - 1e-12:
            want.add(tuple(sorted((first[a], first[b]))))
    assert {(r.a, r.b) for r in got} == want


def fold(events):
    state = None
    for kind, t in events:
        state = W.step(state, kind, t / 1e6)
    return state


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["ok", "wall", "throttle"]), st.integers(0, 10**12)), min_size=1, max_size=40, unique_by=lambda e: e[1]))
def test_wall_states_equal_the_state_machine(spark, events):
    events.sort(key=lambda e: e[1])
    flags = {"ok": (True, False, 200), "wall": (False, True, 403), "throttle": (False, False, 429)}
    rows = [(k, "h", t, *flags[kind]) for k, (kind, t) in enumerate(events)]
    log = spark.createDataFrame(rows, "check_id long, host string, us long, alive boolean, blocked boolean, status int").withColumn("checked_at", F.timestamp_micros("us"))
    got = [tuple(r)[1:] for r in W.wall_states(log).collect()]
    want = fold(events)
    assert got == ([] if want is None else [want])


def test_wall_ladder():
    state, boxes = None, []
    for t in range(5):
        state = W.step(state, "wall", t)
        boxes.append(state[2] - t)
    assert boxes == [900, 1800, 3600, 7200, 7200]
    assert W.step(None, "ok", 1) is None


def test_quota_and_fill():
    assert L.quota_fill(range(6), list("aaabbb"), 6, 1) == [0, 3, 1, 2, 4, 5]
    assert L.quota_fill(range(6), list("aaabbb"), 2, 1) == [0, 3]
    assert L.fill_skipping([5, 9, 4], 10, 100, 9) == [0, 2]
    assert L.until_saturated([frozenset("abc"), frozenset("abc"), frozenset(), frozenset("abc"), frozenset("xyz")]) == [0]


def test_mmr_prefers_what_is_new():
    sets = [frozenset("abcd"), frozenset("abcd"), frozenset("wxyz")]
    assert L.mmr([0.9, 0.89, 0.7], sets, ["", "", ""], 2) == [0, 2]
    assert L.mmr([], [], [], 3) == []


def test_greedy_distinct():
    s = [frozenset("abc"), frozenset("abcd"), frozenset(), frozenset(), frozenset("xy")]
    assert L.greedy_distinct(s, ["1", "2", "", "", "5"], 0.7) == [0, 2, 4]
    assert L.greedy_distinct(s, [""] * 5, 1) == [0, 1, 2, 3, 4]


def test_chunks():
    assert K.chunk_text(None) == K.chunk_text("  \n\n ") == []
    text = "A" * 50 + "\n\n" + "B" * 50
    assert K.chunk_text(text, 30) == [text]
    assert K.chunk_text(text, 20) == ["A" * 50, "B" * 50]
    long = " ".join(f"Sentence number {i} is here." for i in range(60))
    parts = K.chunk_text(long, 50, 10)
    assert len(parts) > 3 and all(len(p) <= 200 + 41 for p in parts)
    assert K.evidence("q", "short") == "short"


def test_feeds():
    rss = "<rss><channel><item><title>T</title><link>u</link><pubDate>Mon</pubDate><description>&lt;b&gt;S&lt;/b&gt;</description></item></channel></rss>"
    assert feeds.parse_feed(rss) == [{"title": "T", "link": "u", "date": "Mon", "summary": "S"}]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="v"/><updated>2020</updated></entry></feed>'
    assert feeds.parse_feed(atom)[0]["link"] == "v"
    assert feeds.parse_feed('{"version":"https://jsonfeed.org/version/1","items":[{"title":"J","url":"w"}]}')[0]["link"] == "w"
    assert feeds.parse_feed(None) == feeds.parse_feed("<broken") == []


def test_sitemaps_and_robots(spark):
    robots = spark.createDataFrame([("h", "User-agent: *\nSITEMAP: http://h/s.xml\nSitemap: http://h/s.xml")], "host string, body string")
    roots = feeds.robots_sitemaps(robots)
    maps = spark.createDataFrame([("http://h/s.xml", "<sitemapindex><sitemap><loc>http://h/1.xml</loc></sitemap></sitemapindex>"), ("http://h/1.xml", "<urlset><url><loc> http://h/a?x=1&amp;y=2 </loc></url></urlset>")], "url string, body string")
    assert [tuple(r) for r in feeds.expand_sitemaps(maps, roots).collect()] == [("h", "http://h/a?x=1&y=2")]


def test_cookies(spark, tmp_path):
    f = tmp_path / "c.txt"
    f.write_text("# c\n.a.test\tTRUE\t/\tFALSE\t0\tn\tv\n#HttpOnly_a.test\tFALSE\t/deep\tTRUE\t0\ts\tw\nb.test TRUE / FALSE 1 old x\nbroken\n")
    jar = feeds.read_cookies(spark, str(f))
    urls = spark.createDataFrame([("https://www.a.test/deep/x",), ("http://a.test/deeper",), ("http://b.test/",)], "url string")
    got = {r.url: r.header for r in feeds.cookie_headers(jar, urls, 100.0).collect()}
    assert got == {"https://www.a.test/deep/x": "s=w; n=v", "http://a.test/deeper": "n=v"}


def test_page():
    p = html.parse_page("<title>T</title><div id=nav><a href=/x>menu</a></div><article><h1>H</h1><p>" + "word " * 60 + "<p>more<img src=a.png alt=I></article><script type='application/ld+json'>{\"a\":1}</script>", "https://h.test/d/")
    assert p["title"] == "T" and p["h1"] == ["H"] and p["links"] == [{"url": "https://h.test/x", "text": "menu"}]
    assert p["images"] == [{"src": "https://h.test/d/a.png", "alt": "I"}] and p["data"] == ['{"a":1}']
    assert "menu" not in p["main_text"] and "word" in p["main_text"]
    assert html.parse_page(None) is None and html.parse_page("")["text"] == ""


@pytest.mark.parametrize("n", [0, 39])
def test_gunzip_limits(n):
    assert feeds.gunzip(b"x" * n) is None
    import gzip

    assert feeds.gunzip(gzip.compress(b"y" * 5000)) == b"y" * 5000


def test_hamming_pairs_equal_brute_force(spark):
    from loomspan.operators.hamming import difference_hash, hamming_pairs

    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(20)]
    rows = [(i, base[i % 20] ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(12)))) for i in range(100)] + [(100, base[0]), (101, base[0]), (102, None)]
    got = {(r.a, r.b): r.distance for r in hamming_pairs(spark.createDataFrame(rows, "id long, fp long"), "id", "fp").collect()}
    first: dict = {}
    for i, f in rows:
        if f is not None:
            first.setdefault(f, i)
    want = {(first[f], i): 0 for i, f in rows if f is not None and first[f] != i}
    for (f, i), (g, j) in itertools.combinations(first.items(), 2):
        if bin(f ^ g).count("1") <= 8:
            want[tuple(sorted((i, j)))] = bin(f ^ g).count("1")
    assert got == want
    pixels = [list(range(72)), [5] * 72, [1]]
    hashes = [r[0] for r in spark.createDataFrame([(p,) for p in pixels], "p array<int>").select(difference_hash(F.col("p"))).collect()]
    assert hashes == [-1, 0, None]


def test_rewrite_rules(spark):
    from loomspan.operators.rules import rewrite_urls

    rules = spark.createDataFrame([(1, "a.test", r"^https://a\.test/t/(\d+)$", "https://a.test/full/$1"), (2, None, r"_small\.jpg$", ".jpg"), (3, "a.test", "x", "y")], "rule_id int, domain string, pattern string, target string")
    urls = spark.createDataFrame([("https://a.test/t/7",), ("https://img.a.test/x",), ("https://b.test/p_small.jpg",), ("https://b.test/",), (None,)], "url string")
    got = {r.url: (r.rule_id, r.rewritten) for r in rewrite_urls(urls, rules).collect()}
    assert got == {"https://a.test/t/7": (1, "https://a.test/full/7"), "https://img.a.test/x": (3, "https://img.a.test/y"), "https://b.test/p_small.jpg": (2, "https://b.test/p.jpg"), "https://b.test/": (None, None), None: (None, None)}


def test_selectors_see_all_rows_of_a_query(spark):
    rng = random.Random(5)
    base = [rng.sample(range(300), 14) for _ in range(120)]
    words = [sorted(set(rng.choice(base)[: rng.randint(11, 14)] + rng.sample(range(300), 1))) for _ in range(450)]
    rows = [(q, f"u{i:03}", float(1000 - i) / 1000, " ".join(map(str, w)) if i % 90 else "", f"d{i % 7}", "x" * ((i * 37) % 400 if i < 440 else 0)) for q in "ab" for i, w in enumerate(words[: 450 if q == "a" else 40])]
    df = spark.createDataFrame(rows, "q string, url string, score double, body string, domain string, snippet string")
    order, tokens = [F.desc("score"), "url"], F.split(F.trim("body"), " ")
    tokens = F.filter(tokens, lambda w: w != "")
    sets = {q: [frozenset(r[3].split()) for r in rows if r[0] == q] for q in "ab"}
    texts = {q: [r[3] for r in rows if r[0] == q] for q in "ab"}
    for threshold in (0.7, 0.85):
        got = L.distinct_per_query(df, "q", order, tokens, F.col("body"), threshold)
        want = {(q, i + 1) for q in "ab" for i in L.greedy_distinct(sets[q], texts[q], threshold)}
        assert {(r.q, r.pos) for r in got.collect()} == want and max(p for _, p in want) > 200
    few = L.quota_per_query(got, "q", "domain", 20, 2)
    want = {(q, i + 1, k + 1) for q in "ab" for k, i in enumerate(L.quota_fill(L.greedy_distinct(sets[q], texts[q], 0.85), [r[4] for r in rows if r[0] == q], 20, 2))}
    assert {(r.q, r.pos, r.rank) for r in few.collect()} == want
    for threshold in (0.7, 0.95):
        got = L.saturated_per_query(L.distinct_per_query(df, "q", order, tokens, None, threshold), "q")
        assert {(r.q, r.pos) for r in got.collect()} == {(q, i + 1) for q in "ab" for i in L.until_saturated(sets[q], threshold)}
    fill = L.fill_candidates(df, "q", order, F.length("snippet") + 100, 1500, 18)
    sizes = [len(r[5]) + 100 for r in rows if r[0] == "a"]
    cut = L.select_per_query(fill, "q", order, lambda p: L.fill_skipping([len(s) + 100 for s in p["snippet"]], 2800, 1500, 18), "q string, url string, rank int")
    assert [r.url for r in cut.filter("q = 'a'").orderBy("rank").collect()] == [f"u{i:03}" for i in L.fill_skipping(sizes, 2800, 1500, 18)]


def test_mmr_finds_what_is_new_below_position_200(spark):
    rows = [("q", f"u{i:03}", 0.9 - i / 10_000, "", "a b c d" if i < 250 else f"w{i} x{i} y{i}") for i in range(260)] + [("q", "far", 0.1, "", "z")]
    df = spark.createDataFrame(rows, "q string, url string, score double, aspect string, body string")
    near = L.mmr_candidates(df, "q", [F.desc("score"), "url"], "score", ["aspect", "body"], 5)
    assert near.count() < 50
    got = L.select_per_query(near, "q", [F.desc("score"), "url"], lambda p: L.mmr(p["score"].tolist(), [frozenset(b.split()) for b in p["body"]], p["aspect"].tolist(), 5), "q string, url string, rank int")
    want = L.mmr([r[2] for r in rows], [frozenset(r[4].split()) for r in rows], [r[3] for r in rows], 5)
    assert [r.url for r in got.orderBy("rank").collect()] == [rows[i][1] for i in want] == ["u000", "u250", "u251", "u252", "u253"]


def test_jaccard_pairs_are_of_whole_document_texts(spark, tmp_path):
    from loomspan.plans.q_text import jaccard_pairs

    long = " ".join(f"word{i}" for i in range(2000))
    rows = [(1, None, long), (2, "t", long + " end"), (3, "t", long[: len(long) // 2]), (4, "t", None), (5, None, long)]
    spark.createDataFrame(rows, "doc_id long, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.a, r.b) for r in jaccard_pairs(spark, str(tmp_path)).collect()} == {(1, 2), (1, 5)}


def test_similar_pairs_of_common_words_leave_few_candidates(spark):
    from loomspan.operators.simjoin import _candidates

    rng = random.Random(11)
    words = [f"{'abcdefgh'[i % 8]}{'xyz' * (i % 3)}{i}" for i in range(150)]
    sets = [rng.sample(words, rng.randrange(30, 90)) for _ in range(500)]
    for base in sets[:60]:  # around the threshold: up to a tenth of the words dropped, changed or added
        k = rng.randrange(1, 1 + len(base) // 10)
        sets += [base[k:], base[k:] + [f"new{i}" for i in range(k)], base + [f"new{i}" for i in range(k)], base[::-1]]
    sets += [["one"], ["one"], ["one", "two"], [f"w{i}" for i in range(3000)], [f"w{i}" for i in range(400, 3000)], []]
    for threshold in (0.85, 0.7):
        rows = spark.createDataFrame(list(enumerate(sets)), "id long, t array<string>")
        want, first = set(), {}
        for i, s in enumerate(map(frozenset, sets)):
            if s and s in first:
                want.add((first[s], i, 1.0))
            elif s:
                want |= {(j, i, k / (len(s) + len(o) - k)) for o, j in first.items() if (k := len(s & o)) >= threshold * (len(s) + len(o) - k)}
                first[s] = i
        got = similar_pairs(rows, "id", "t", threshold).collect()
        assert {(r.a, r.b, r.similarity) for r in got} == want and len(got) == len(want) > 150
    cand = _candidates(rows.filter("id < 500").select(F.array_sort("t").alias("t")).select("t", F.xxhash64("t").alias("h"), F.size("t").alias("n")), 0.85)
    assert cand.count() < 20  # all 500 share words of their prefixes: some 60,000 pairs of fitting sizes
