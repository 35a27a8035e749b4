"""Every operator on nulls, blanks, giants, repeats, clashing names and empty tables."""

import pytest

from loomspan.llm import p01_residue, p02_spam_pages, p03_near_duplicates, p04_encoding, p05_site_lines, p06_main_body, p07_addresses, p08_packing, p09_mixing, p10_truncation

ON_READS = {
    "p1": lambda r: p01_residue.residue_labels(r),
    "p2": lambda r: p02_spam_pages.spam_scores(r),
    "p3": lambda r: p03_near_duplicates.NearDuplicates(r).labelled(),
    "p4": lambda r: p04_encoding.repair_fields(r, [r]),
    "p5": lambda r: p05_site_lines.excess_lines(r),
    "p5_clean": lambda r: p05_site_lines.remove_lines(r, p05_site_lines.excess_lines(r)),
    "p6": lambda r: p06_main_body.boilerplate_lines(r),
    "p7": lambda r: p07_addresses.collapse_addresses(r)[1],
}


@pytest.mark.parametrize("name", sorted(ON_READS))
def test_odd_reads(odd_reads, no_reads, name):
    got = {r[0]: r for r in ON_READS[name](odd_reads).collect()}
    assert ON_READS[name](no_reads).count() == 0
    if name == "p1":
        assert got[10].residue and not got[3].residue and 0 not in got and 1 not in got and 2 not in got
    if name == "p2":
        assert not any(r.is_spam for i, r in got.items() if i in (3, 4, 5))
    if name == "p3":
        assert got[3].rep == got[4].rep == 3 and 8 not in got
    if name == "p4":
        assert got[8].chain == "lost" and not got[8].recovered and 7 not in got and 3 not in got
    if name == "p5_clean":
        assert len(got) == 12 and got[0].text is None and got[1].text == ""
    if name == "p6":
        assert not {0, 1, 2, 10} & set(got)
    if name == "p7":
        assert sum(r.n for r in got.values()) == 9


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return df.selectExpr("*", "1 as tokens", "2 as curve", "3 as u", "4 as run", "'x' as kind", "5 as chars", "6 as len", "7 as n")


def test_odd_documents(spark):
    rows = [(0, None, None), (1, "s", ""), (2, "s", "one two three"), (3, "s", "one two three"), (3, "s", "one two three"), (4, None, "word " * 5000), (5, "t", "\x00")]
    d = docs(spark, rows)
    limits = spark.createDataFrame([("tight", 4), ("none", None), ("zero", 0)], "limit_name string, capacity_tokens int")
    packed = p08_packing.pack_documents(d, limits).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, 5} and {r.limit_name for r in packed} == {"tight"}
    assert p08_packing.pack_documents(d.filter("doc_id < 0"), limits).count() == 0
    targets = spark.createDataFrame([("s", 1.0, 2), (None, 0.5, 1), ("u", 0.0, 1)], "source string, target_share double, max_repeats int")
    got = p09_mixing.Mix(d, targets).copies().collect()
    assert {r.doc_id for r in got} == {2, 3} and max(r.repeat_no for r in got) == 1 and len(got) == 6
    assert p09_mixing.Mix(d.filter("doc_id < 0"), targets).copies().count() == 0
    cut = {r.doc_id: r.p_cut for r in p10_truncation.truncation_scores(d).collect()}
    assert set(cut) == {1, 2, 3, 4, 5} and cut[1] < 0.5
    assert p10_truncation.truncation_scores(d.filter("doc_id < 0")).count() == 0


def test_queries_run(spark, sf):
    from loomspan.llm import catalog

    for name, query in catalog.queries().items():
        df = query(spark, sf)
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0, name
        if name.endswith("_found"):
            assert df.count() == df.distinct().count(), name
