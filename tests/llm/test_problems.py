"""Each problem against brute force, invariants, round trips or planted cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomspan.llm import catalog, p01_residue, p02_spam_pages, p03_near_duplicates, p04_encoding, p05_site_lines, p06_main_body, p07_addresses, p08_packing, p09_mixing, p10_truncation
from loomspan.llm.common import attach_by_key, components, may_be_in
from tests.llm.conftest import READS, article
from tests.oracle import connect, rows


def reads(spark, texts, urls=None):
    return spark.createDataFrame([(i, (urls or {}).get(i, f"https://x{i}.test/a/{i}"), f"t{i}", t, None, None) for i, t in enumerate(texts)], READS)


def test_p1_recall_of_the_candidates_at_0_8(spark):
    rng = np.random.default_rng(4)
    sides, truth = ([], []), set()
    for k in range(500):
        both = rng.integers(0, 2**63, 200, dtype=np.uint64)
        for side in (0, 1):  # 200 shared of 250 shingles
            s = np.concatenate([both, rng.integers(0, 2**63, 25, dtype=np.uint64)])
            sides[side].append((2 * k + side, 225, *p01_residue.fingerprints(p01_residue.mix(s))))
        truth.add((2 * k, 2 * k + 1))
    seeds, others = (spark.createDataFrame(r, "rep long, size int, fp long, fp1 long, fp2 long") for r in sides)
    found = {(r.a, r.b) for r in p01_residue.candidate_pairs(seeds, others).collect()}
    assert len(found & truth) >= 0.95 * len(truth)


def test_p1_labels_reach_edited_copies_that_no_rule_knows(spark):
    rng = random.Random(8)
    texts, planted = [article(k, 6) for k in range(20)], set()
    lines = lambda ws: "\n".join(" ".join(ws[i : i + 5]) for i in range(0, len(ws), 5))
    for k in range(40):
        body = [f"{rng.choice('bcdfg')}{rng.randrange(10**6)}q" for _ in range(300)]
        page = " ".join(w.translate(str.maketrans("0123456789", "abcdefghij")) for w in body)
        texts.append("Just a moment... Please enable JavaScript to view this page.\n" + lines(page.split()))  # seen by rule
        words = page.split()
        words[rng.randrange(300)] = "edited"
        planted |= {len(texts), len(texts) + 1}
        texts.append(lines(words))  # a copy of the rest, one word edited
        words[0] = "again"
        texts.append(lines(words) + " and more words at the end")  # a copy of the copy
    labels = {r.read_id: r for r in p01_residue.residue_labels(reads(spark, texts)).collect()}
    got = {i for i, r in labels.items() if r.propagated}
    assert got <= planted and len(got) >= 0.9 * len(planted)
    assert not any(labels[i].residue for i in planted)


def test_bloom_filter_misses_nothing(spark):
    rows, keys = spark.range(20_000).selectExpr("id as k", "id as x"), spark.range(0, 20_000, 7).selectExpr("id as k")
    got = {r.k for r in may_be_in(rows, keys, "k").collect()}
    assert got >= set(range(0, 20_000, 7)) and len(got) < 3_100


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(0, k) for k in range(100, 140)] + [(200 + k, 201 + k) for k in range(12)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_hot_keys_join_whole(spark):
    members = spark.createDataFrame([(i, i % 3 if i < 60 else 7) for i in range(100)], "id long, k long")
    groups = members.groupBy("k").count().withColumnRenamed("count", "n")
    assert attach_by_key(members, groups, ["k"], "n", hot_rows=30).count() == 100


def test_p1_labels_and_spread(spark):
    wall = "Just a moment...\nChecking if the connection to news.a.test is secure\nRay {}"
    texts = [wall.format("8f3a91c2"), article(3), "Dear {{ first_name }}, thank you for your visit", article(4) + "\nThe script replaces ${title} with the headline before printing.",
             "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod", article(5).replace("bridge", "[[item.sku]]", 1), article(6) + "\n“Just a moment,” said the keeper, and went to look for the key."]
    got = {r.read_id for r in p01_residue.residue_labels(reads(spark, texts)).filter("residue or propagated").collect()}
    assert got == {0, 2, 4} | ({5} if "[[item.sku]]" in texts[5] else set())


def test_p1_spreads_only_from_whole_pages(spark):
    odd = "\n".join(f"unheard{c} notice of {c}" for c in "abcdefghijkl")
    texts = [odd, odd, article(1)]
    labels = p01_residue.residue_labels(reads(spark, texts))
    assert labels.filter("residue or propagated").count() == 0
    near = "Just a moment...\n" + odd
    got = {(r.read_id, r.residue, r.propagated) for r in p01_residue.residue_labels(reads(spark, [near, odd, article(1)])).collect()}
    assert got == {(0, True, False), (1, False, True), (2, False, False)}


def test_p2_spam(spark):
    rng = random.Random(2)
    keys = "; ".join(f"{rng.choice(['cheap', 'best', 'buy'])} {rng.choice(['pump', 'kiln', 'loom'])}" for _ in range(80))
    links = "\n".join(f"https://{rng.choice(['mor', 'lorn', 'quill', 'ebb'])}{rng.choice(['wick', 'ford', 'dale'])}{rng.randrange(999)}.example/out/{rng.randrange(10**6)}" for _ in range(25))
    texts = [keys, links] + [article(k, 6) for k in range(30)] + ["- 8 bolts, kiln\n- 9 cables, weir\n" + article(99, 6)]
    assert {r.read_id for r in p02_spam_pages.spam_scores(reads(spark, texts)).filter("is_spam").collect()} == {0, 1}


def jaccard_pairs(texts):
    sets = {i: frozenset(re.findall(r"[^\W_]+", t.lower())) for i, t in enumerate(texts) if t}
    sets = {i: s for i, s in sets.items() if len(s) >= 60}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}


def test_p3_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = []
    for k in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(120)]
        texts.append(" ".join(words))
        for edits in (0, 8, 15, 30):
            edited = list(words)
            for _ in range(edits):
                edited[rng.randrange(120)] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(edited).upper() if edits == 0 else " ".join(edited))
    texts += ["too short", None, ""]
    reads(spark, texts).write.parquet(f"{tmp_path}/webtools_bridge.parquet")
    got = {tuple(r) for r in p03_near_duplicates.p3_found(spark, str(tmp_path)).collect()}
    want = jaccard_pairs(texts)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 60


def test_p3_signature_is_circulant():
    sigma, pi = p03_near_duplicates.permutations()
    window = np.lib.stride_tricks.sliding_window_view(pi, p03_near_duplicates.BANDS * p03_near_duplicates.ROWS)
    places = np.array([5, 77, p03_near_duplicates.DOMAIN - 3])
    sig = p03_near_duplicates.signature(places, window, step=2)
    for k in (0, 1, 500):
        assert sig[k] == min(pi[(p + k) % p03_near_duplicates.DOMAIN] for p in places)


GARBLE = {"utf-8>cp1252": ("utf-8", "cp1252"), "utf-8>latin-1": ("utf-8", "latin-1"), "utf-8>cp1251": ("utf-8", "cp1251"), "utf-8>mac_roman": ("utf-8", "mac_roman"), "cp1251>cp1252": ("cp1251", "cp1252"), "koi8-r>cp1251": ("koi8-r", "cp1251")}


def test_p4_restores_held_out_lines(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet").select("text").filter("text is not null")
    lines = [x for r in docs.orderBy("text").collect() for x in r.text.split("\n") if len(x) > 60 and not x.isascii()]
    train, held = lines[::2], lines[1::2]
    model, ch = p04_encoding.Classifier(train), p04_encoding.Chains()
    fixer = p04_encoding.Repairer(model.logp)
    assert not [x for x in fixer.fields(held) if x[0]][3:], "clean lines are left alone"
    tried = right = 0
    for k, chain in enumerate(p04_encoding.CHAINS):
        if len(chain) == 1 and ">".join(chain[0]) in GARBLE:
            pairs = [(g, x) for x in held if (g := ch.garble(x, k)) and g != x and (chain[0][0] == "utf-8" or re.search("[а-я]{4}", x))][:60]
            out = fixer.fields([g for g, _ in pairs])
            tried += len(pairs)
            right += sum(o[1] == x for o, (_, x) in zip(out, pairs))
    assert tried > 150 and right >= 0.95 * tried


def test_p4_chains_invert():
    ch = p04_encoding.Chains()
    for k in range(len(p04_encoding.CHAINS)):
        for text in ("Überfall – naïve", "кот и пёс", "źródło łąka", "plain"):
            g = ch.garble(text, k)
            assert g is None or ch.invert(g, k) in (text, None)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), connect(sf).execute(catalog.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_p5_removes_what_repeats(spark):
    texts = [f"Menu  of the SITE\r\n{article(k)}\nline {k % 2} of two\n\nImprint" for k in range(12)]
    r = reads(spark, texts, {i: f"https://www.one.test:443/{i}" for i in range(12)})
    found = p05_site_lines.excess_lines(r)
    assert {x.line for x in found.filter("n >= 6").collect()} >= {"menu of the site", "imprint", "line 0 of two", "line 1 of two"}
    clean = {x.read_id: x.text for x in p05_site_lines.remove_lines(r, found.filter("n >= 6")).collect()}
    assert clean == {k: f"{article(k)}\n" for k in range(12)}


def test_p6_differences(spark):
    texts = [f"Home | Maps | Letters | Trade\nBy the desk of the paper\n{article(k)}\nA heading in the middle\n{article(k + 40)}\nBack to top\n© 2026 The Paper. All rights reserved by its owner." for k in range(8)]
    r = reads(spark, texts, {i: f"https://paper.test/2024/story-{i}" for i in range(8)})
    got = defaultdict(set)
    for x in p06_main_body.boilerplate_lines(r).collect():
        got[x.read_id].add(x.line_no)
    n = len(texts[0].split("\n"))
    assert all(got[i] >= {1, 2, n - 1, n} for i in range(8))
    assert all(not got[i] & set(range(3, 7)) for i in range(8))


def test_p6_pages_that_share_a_legal_sentence_are_compared(spark):
    legal = "The paper is a trade name of Morrow and Daughters Publishing, registered in the town of Thornwick under no. {}."
    texts = [f"{article(k * 3)}\nShort remark number {'abcdefgh'[k]} of the day\n{legal.format(77)}" for k in range(8)] + [f"Opening hours of {x}\n{legal.format(77)}" for x in ("ann", "ben", "cid")]
    r = reads(spark, texts, {i: f"https://paper.test/2024/story-{i:02}" for i in range(11)})
    pages = {p.read_id: p for p in p06_main_body.difference_pages(r).collect()}
    assert all(p.paired and p.shared[-1] and not any(p.shared[:-1][:4]) for p in pages.values() if p.read_id < 8)
    assert all(pages[i].paired and pages[i].shared == [False, True] for i in (8, 9, 10))
    copies = [article(1, 6) + f"\nSeen {x}" for x in ("here", "there")]
    r = reads(spark, copies, {0: "https://b.test/a", 1: "https://b.test/b"})
    assert not any(p.paired for p in p06_main_body.difference_pages(r).collect())


def test_p6_common_lines():
    rng = random.Random(5)
    for _ in range(50):
        a, b = [[rng.choice("abcde") for _ in range(rng.randrange(9))] for _ in range(2)]
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        x, y = p06_main_body.common_lines(a, b)
        assert len(x) == len(y) == best[-1, -1] and [a[i] for i in sorted(x)] == [b[j] for j in sorted(y)]


def test_p7_spellings(spark):
    same = ["https://a.test/x/y-z?b=2&a=1", " HTTPS://A.TEST:443/x/y%2Dz/?a=1&b=2&utm_source=m#top ", "<https://a.test//X/Y-Z/?&b=2&&a=1&>", "https://a.test/x/y-z?gclid=9&a=1&b=2,"]
    other = ["http://a.test/x/y-z?b=2&a=1", "https://a.test/x/y-z?b=1&a=2", "https://www.a.test/x/y-z?b=2&a=1", "https://a.test/xy-z?b=2&a=1", "https://a.test/x/y-z?b=2", None]
    r = reads(spark, [""] * 10, dict(enumerate(same + other)))
    keys, groups = p07_addresses.collapse_addresses(r)
    assert Counter(g.n for g in groups.collect()) == {4: 1, 1: 5}


def test_p8_hilbert_visits_every_cell_by_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=2)))
    order = np.argsort(p08_packing.hilbert_index(grid, bits=3))
    steps = np.abs(np.diff(grid[order], axis=0)).sum(axis=1)
    assert (steps == 1).all() and len(set(p08_packing.hilbert_index(grid, bits=3))) == 64


def test_p8_containers(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    packed = p08_packing.p8_pack(spark, big).toPandas()
    size = {r.doc_id: r.tokens for r in p08_packing.sized_documents(spark.read.parquet(f"{big}/documents.parquet")).collect()}
    for (name, cap), g in packed.groupby(["limit_name", "capacity_tokens"]):
        used = g.groupby("container_id").tokens.sum()
        assert used.max() <= cap and g.groupby("doc_id").tokens.sum().to_dict() == size
        pieces = g.groupby("doc_id").piece_no.count()
        assert all(size[d] > cap for d in pieces[pieces > 1].index)
        assert used.sum() >= 0.97 * cap * (len(used) - 1), name


def test_p9_shares(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    docs, targets = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/mix_targets.parquet")
    mix = p09_mixing.Mix(docs, targets)
    got = mix.copies().toPandas()
    want = {r.source: r for r in targets.collect()}
    largest = got.groupby("source").tokens.max()
    assert (got.groupby(["source", "doc_id"]).size().reset_index(name="k").apply(lambda r: r.k <= want[r.source].max_repeats, axis=1)).all()
    for s, t in got.groupby("source").tokens.sum().items():
        assert abs(t - want[s].target_share * mix.total) <= largest[s] / 2 + 1
    small = p09_mixing.Mix(docs, targets, budget=10_000).copies().toPandas()
    assert abs(small.tokens.sum() - 10_000) <= largest.sum()


def test_p10_planted_cuts(spark):
    rng = random.Random(6)
    rows, cut = [], set()
    for i in range(400):
        text = article(rng.randrange(99), rng.randrange(1, 8))
        kind = i % 8
        if kind == 0 and len(text) > 400:
            text, _ = text[:400], cut.add(i)
        elif kind == 1:
            text, _ = text[: rng.randrange(80, len(text) - 3)].rstrip(".").rstrip(), cut.add(i)
        elif kind == 2:
            text += "\n— Ada Quill"
        elif kind == 3:
            text += "\nPhoto: Lornhaven"
        elif kind == 4:
            text += "\nhttps://a.test/q1"
        elif kind == 5:
            text = "The kiln at Marrow and the weir question"
        rows.append((i, "s" if kind == 0 else f"s{kind}", text))
    cut = {i for i in cut if not re.search(r"[.!?]$", rows[i][2])}
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id for r in p10_truncation.truncation_scores(docs).filter("p_cut > 0.5").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 2


def test_p10_censored_fit_recovers_the_distribution():
    import pandas as pd

    x = np.minimum(np.random.default_rng(7).lognormal(6.0, 0.8, 20_000).astype(int), 600)
    hist = pd.Series(x).value_counts().rename_axis("len").reset_index(name="n")
    mu, sd, _ = p10_truncation.fit_censored(hist, {600})
    assert abs(mu - 6.0) < 0.05 and abs(sd - 0.8) < 0.05


def test_p8_containers_hold_neighbours_of_the_curve(spark, sf):
    for r in p08_packing.p8_fill(spark, sf.replace("sf0.001", "sf0.1")).collect():
        assert r.fill >= 0.985 and r.mean_span <= 0.2 * r.random_span, r


def test_p10_odds_come_from_the_censored_lengths():
    # (evidence, away from the limits, at limits, censored there)
    odds, base = p10_truncation.ending_odds([("open", 50.0, 90.0, 89.0), ("closed", 900.0, 9.0, 5.0), ("listed", 50.0, 1.0, 0.9)])
    assert base < -2 and odds["open"] > 5 and odds["closed"] < -2.5 and odds["listed"] < -1
    plain, _ = p10_truncation.ending_odds([("open", 5.0, 0.0, 0.0), ("closed", 95.0, 0.0, 0.0)])
    assert plain["open"] > plain["closed"]


def test_p6_long_pages_align_without_a_table():
    a = [f"line {i}" for i in range(3000)]
    b = [x for i, x in enumerate(a) if i % 7] + ["tail"] * 50
    x, y = p06_main_body.common_lines(a, b)
    assert len(x) == len(y) == len(b) - 50 and [a[i] for i in sorted(x)] == [b[j] for j in sorted(y)]


def test_p6_neighbour_behind_copies(spark):
    texts = [article(1, 6) + "\nTerms of the house"] + [article(5, 6) + f"\nTerms of the house\nSeen by {n}" for n in ("ann", "bea", "cyd", "dot", "eve", "fay")]
    pages = {p.read_id: p for p in p06_main_body.difference_pages(reads(spark, texts, {i: f"https://c.test/{i}" for i in range(7)})).collect()}
    assert all(p.paired for p in pages.values())


def test_p6_long_pages_of_repeated_lines_align_exactly():
    rng = random.Random(8)
    a, b = [[f"line {rng.randrange(12)}" for _ in range(n)] for n in (300, 260)]
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    x, y = p06_main_body.common_lines(a, b)
    assert len(x) == len(y) == best[-1, -1] and [a[i] for i in sorted(x)] == [b[j] for j in sorted(y)]


def test_p5_counts_only_what_decides(spark, monkeypatch):
    written = []
    monkeypatch.setattr(p05_site_lines, "materialize", lambda df, label: written.append(df) or df)
    texts = [f"Notice of all\nonly here {k}\n{'of six' if k % 40 < 6 else 'of the rest ' + str(k)}" for k in range(240)]
    found = p05_site_lines.excess_lines(reads(spark, texts, {k: f"https://s{k // 120}.test/{k}" for k in range(240)})).collect()
    # 120 reads of two sites: 18 of "of six" in each, and the notice of every site
    assert {(r.site, r.line, r.n, r.n_site) for r in found} == {(f"s{k}.test", x, n, 120) for k in (0, 1) for x, n in (("notice of all", 120), ("of six", 18))}
    assert max(df.count() for df in written) == 4  # no table of a background: nothing but the sites and the cases
