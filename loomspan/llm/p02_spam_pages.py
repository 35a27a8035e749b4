"""Problem 2: keyword-stuffed pages, link lists and masses of tags.

Method: block-wise compression ratio, normalized by length and language
with the corpus's own prose as the norm; extreme redundancy is confirmed by
low sentence-punctuation density.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.residue_rules import judge
from loomspan.session import materialize, read_table

BLOCK = 2048
#: Loose text (lines that are no sentences) below this size says nothing.
MIN_BYTES = 120
#: It must be most of the page, ...
MIN_SHARE = 0.5
#: ... with hardly a sentence end in it, ...
MAX_ENDS_PER_WORD = 0.04
#: ... of more than a few words, none of which makes it up (that is filler), ...
MIN_WORDS, MAX_TOP = 6, 0.55
#: ... and against prose of its length and language be extremely redundant,
#: or as redundant over some length, or nearly so as one long line without
#: the language's function words.
EXTREME, REDUNDANT, LISTED = 0.8, 1.0, 1.5
LONG_LINE, MAX_GLUE = 180, 0.04
#: Lists that come back to one word in every entry.
RECURRING, RECURRING_TOP = 1.2, 0.15
#: Keywords put into sentences: prose this much more redundant than prose,
#: of some length and with the language's function words (filler has none).
STUFFED, STUFFED_BYTES, MIN_PROSE_GLUE = 0.78, 240, 0.02

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with on by from which not are it at",
    "de": "der die das und von den mit für ist im zu nicht ein eine auf bei wurde dem",
    "fr": "le la les des et du en une est dans pour que sur par plus au de l",
    "es": "el la los las de y en que por con para una es del se lo más al",
    "pt": "o a os as de e em que por com para uma é do da não se ao",
    "pl": "i w na z do nie się że jest od po o za przez dla jak który ile",
    "ru": "и в на с не что по из к за от для о у как это его но",
}




def blocks(data: bytes, size: int = BLOCK) -> tuple[int, int, int, int]:
    """(full blocks, their compressed bytes, length of the rest, its compressed bytes)."""
    full, packed = len(data) // size, 0
    for k in range(full):
        packed += len(zlib.compress(data[k * size : (k + 1) * size], 6))
    rest = data[full * size :]
    return full, packed, len(rest), len(zlib.compress(rest, 6)) if rest else 0


FEATURES = ["lang", "share", "top", "glue", "prose_glue", "distinct", "ends", "words", "longest", "loose_full", "loose_full_c", "loose_tail", "loose_tail_c", "prose_full", "prose_full_c", "prose_tail", "prose_tail_c"]
FEATURE_TYPES = ["string"] + ["double"] * 4 + ["long"] * 12
FEATURE_SCHEMA = ", ".join(f"{n} {t}" for n, t in zip(FEATURES, FEATURE_TYPES))
_ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}


def make_profiler():
    """A function of one text giving its FEATURES."""
    inner = re.compile(r"[^\W\d_][.!?…][\"”»“’)]*\s")
    part = re.compile(r"(?:[-–—•*·▪]\s*)?\d+\s*[×x]?\s|[-–—•*·▪]\s")
    word, cyrillic = re.compile(r"[^\W\d_]+"), re.compile("[Ѐ-ӿ]")
    sets = {lang: frozenset(ws.split()) for lang, ws in FUNCTION_WORDS.items()}

    def profile(text: str) -> tuple:
        loose, prose = [], []
        for x in text.split("\n"):
            x = x.strip()
            if x:
                sentence = x.rstrip("\"”»“’)]")[-1:] in ".!?…:;" or part.match(x) or len(inner.findall(x)) >= 1 + len(x) / 200
                (prose if sentence else loose).append(x)
        a, b = "\n".join(loose), "\n".join(prose)
        ws, bs = Counter(word.findall(a.lower())), Counter(word.findall(b.lower()))
        count = lambda bag, known: sum(bag[w] for w in known & bag.keys())
        hits = {lang: count(ws, known) + count(bs, known) for lang, known in sets.items()}
        lang = max(hits, key=hits.__getitem__)
        if not hits[lang]:
            lang = "ru" if re.search("[а-я]", text) else "xx"
        known = sets.get(lang, frozenset())
        n, m, total = ws.total(), bs.total(), len(a) + len(b)
        loose_bytes, prose_bytes = a.encode("utf-8", "replace"), b.encode("utf-8", "replace")
        other = len(b) - len(b.encode("ascii", "ignore"))
        # garbled text repeats itself too: mostly signs and letters that no language here has in such numbers
        plain = other <= 0.25 * len(b) or other - len(cyrillic.findall(b)) <= 0.25 * len(b)
        return (
            lang, len(a) / total if total else 0.0, max(ws.values(), default=0) / max(1, n), count(ws, known) / max(1, n), count(bs, known) / max(1, m) if plain else 0.0,
            len(ws), len(inner.findall(a)), n, max(map(len, loose), default=0), *blocks(loose_bytes), *blocks(prose_bytes),
        )

    return profile


def feature_arrays(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows)) if rows else [[]] * len(FEATURES)
    return [pa.array(c, _ARROW[t]) for c, t in zip(cols, FEATURE_TYPES)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    profile = make_profiler()
    for batch in batches:
        # what stands instead of content is problem 1's, however redundant it is
        rows = [profile("" if judge(t)[1] else t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *feature_arrays(rows)], names=["read_id", *FEATURES])


def page_features(reads: DataFrame) -> DataFrame:
    texts = reads.select("read_id", "text").filter(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    return texts.mapInArrow(_features, "read_id long, " + FEATURE_SCHEMA)


def _bin(length):
    """Half-octave bins of a block's length: at most 2 * log2(BLOCK) of them."""
    return F.floor(2 * F.log2(F.greatest(length, F.lit(1)).cast("double")))


def prose_norms(features: DataFrame) -> DataFrame:
    """(lang, bin, ratio): mean compression ratio of the corpus's prose blocks.

    At most eight languages times 23 length bins, whatever the corpus.
    """
    tails = features.filter("prose_tail >= 32").select("lang", _bin(F.col("prose_tail")).alias("bin"), F.col("prose_tail").alias("size"), F.col("prose_tail_c").alias("packed"))
    full = features.filter("prose_full > 0").select("lang", _bin(F.lit(BLOCK)).alias("bin"), (F.col("prose_full") * BLOCK).alias("size"), F.col("prose_full_c").alias("packed"))
    both = tails.union(full)
    own = both.groupBy("lang", "bin").agg((F.sum("packed") / F.sum("size")).alias("ratio"), F.count("*").alias("m")).filter("m >= 5").drop("m")
    return own


def spam_scores(reads: DataFrame) -> DataFrame:
    """One row of measures and the verdict ``is_spam`` per non-empty text.

    Null and blank texts are never spam, an empty table gives no rows,
    repeated rows are scored alike, other columns are ignored. A block whose
    language and length has no prose in the corpus is measured against the
    general norm 0.2 + 4 / log2(bytes)**1.05, a fit to plain prose.
    """
    return spam_verdicts(materialize(page_features(reads), "p2"))


def spam_verdicts(f: DataFrame) -> DataFrame:
    """The measures and verdicts of profiled texts (read_id and FEATURES)."""
    norms = F.broadcast(prose_norms(f))
    full_n = norms.filter(F.col("bin") == int(2 * math.log2(BLOCK))).select("lang", F.col("ratio").alias("full_ratio"))
    general = lambda n: 0.2 + 4 / F.pow(F.log2(F.greatest(n, F.lit(4)).cast("double")), F.lit(1.05))
    j = f.join(F.broadcast(full_n), "lang", "left")
    out = {}
    for part in ("loose", "prose"):
        tail_n = norms.select("lang", F.col("bin").alias(f"{part}_bin"), F.col("ratio").alias(f"{part}_ratio"))
        full, tail = F.col(f"{part}_full") * BLOCK, F.col(f"{part}_tail")
        j = j.withColumn(f"{part}_bin", _bin(tail)).join(F.broadcast(tail_n), ["lang", f"{part}_bin"], "left")
        expected = full * F.coalesce("full_ratio", general(F.lit(BLOCK))) + tail * F.coalesce(f"{part}_ratio", general(tail))
        out[part] = (full + tail, (F.col(f"{part}_full_c") + F.col(f"{part}_tail_c")) / F.greatest(expected, F.lit(1.0)))
    (size, loose), (prose_size, prose) = out["loose"], out["prose"]
    ends = F.col("ends") / F.greatest(F.col("words"), F.lit(1))
    mostly = (F.col("share") >= MIN_SHARE) & (ends <= MAX_ENDS_PER_WORD) & (F.col("distinct") >= MIN_WORDS) & (F.col("top") < MAX_TOP)
    listed = mostly & (size >= MIN_BYTES) & (
        (loose <= EXTREME)
        | ((loose <= REDUNDANT) & (size >= 2 * MIN_BYTES))
        | ((loose <= RECURRING) & (size >= 4 * MIN_BYTES) & (F.col("top") >= RECURRING_TOP))
        | ((loose <= LISTED) & (F.col("longest") >= LONG_LINE) & (F.col("glue") <= MAX_GLUE))
    )
    stuffed = (F.col("share") < MIN_SHARE) & (prose_size >= STUFFED_BYTES) & (prose <= STUFFED) & (F.col("prose_glue") >= MIN_PROSE_GLUE)
    return j.select(
        "read_id", "lang", "share", "top", "glue", "distinct", "longest", size.alias("loose_bytes"), loose.alias("normalized"), prose_size.alias("prose_bytes"), prose.alias("prose_normalized"),
        ends.alias("ends_per_word"), (listed | stuffed).alias("is_spam"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_scores(read_table(spark, sf_dir, "webtools_bridge")).filter("is_spam").select("read_id").distinct()


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's redundancy against prose of its length and language."""
    return spam_scores(read_table(spark, sf_dir, "webtools_bridge"))


QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores}
