import pytest

READS = "read_id long, url string, title string, text string, links array<struct<handle:string,url:string,text:string>>, blocked string"

PROSE = [
    "The old mill by the river was repaired in the spring, and the council paid most of the cost.",
    "Visitors who came from the coast asked for a map of the paths, but none had been printed yet.",
    "A second survey found that the roof of the barn had been lost in the storm of last autumn.",
    "Nobody in the village expected the new bridge to take longer than the work on the harbour.",
    "In the archive there is a letter that describes how the first pump was carried up the hill.",
    "The report lists several faults, most of which were known before the inspection had begun.",
]


def code(k: int) -> str:
    return "".join(chr(97 + (k // 17**i) % 17) for i in range(3))


def article(k: int, n: int = 4) -> str:
    names = ["kiln", "weir", "loom", "quay", "forge", "tannery", "orchard", "viaduct", "granary", "sluice", "beacon", "cistern"]
    return "\n".join(PROSE[(k + i) % 6].replace("mill", names[(k * 5 + i) % 12]).replace("map", names[(k * 3 + i) % 12]) + f" It was item {k * 31 + i} of the list kept by Mor{code(k * 9 + i)}, who lives at Thorn{code(k * 7 + i)}wick." for i in range(n))


@pytest.fixture(scope="session")
def odd_reads(spark):
    """Nulls, empty and blank texts, a very long one, repeated texts, columns whose names clash with inner ones."""
    long = " ".join(f"word{i % 5000} and then" for i in range(200_000)) + "."
    texts = [None, "", "   \n\t", article(1), article(1), article(2), long, "é" * 3000, "�", "\x00\x01", "{{ name }}", "a" * 20_000]
    rows = [(i, None if i % 4 == 0 else f"https://s{i % 2}.test/p/{i}", None if i % 3 == 0 else f"T{i}", t, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, READS)
    return df.selectExpr("*", "'x' as site", "'y' as line", "1 as h1", "2 as n", "3 as rep", "4 as a", "5 as b", "6 as comp", "7 as key", "'z' as lang", "0.5 as share", "8 as pos")


@pytest.fixture(scope="session")
def no_reads(odd_reads):
    return odd_reads.filter("read_id < 0")
