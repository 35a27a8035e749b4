"""Problem 4: text decoded with a wrong character encoding.

Method: a multinomial classifier on hashed byte bigrams, trained on clean
lines garbled through every known chain of encodings, predicts a line's
chain; the chain is inverted and must decode strictly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import read_table

#: Bound of the training sample: texts taken per table, and as many in rarer scripts.
SAMPLE_TEXTS = 200
BINS = 1 << 14
SMOOTH = 0.05
#: A line is garbled if its chain beats "clean" by this many nats, ...
MARGIN = 0.0
#: chains this many nats less likely than the best one are not tried, ...
RULED_OUT = 60.0
#: ... and what it inverts to is likelier clean text by as many nats a bigram.
GAIN = 0.4
#: ... or by this many, if characters were lost and only runs of it decode.
LOSSY_GAIN = 0.8

# Fixed values: (written in, read as) steps, the last step last.
CHAINS: list[tuple[tuple[str, str], ...]] = [
    (("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1250"),), (("utf-8", "cp1251"),), (("utf-8", "cp437"),), (("utf-8", "cp850"),), (("utf-8", "mac_roman"),),
    (("utf-8", "iso8859-2"),), (("utf-8", "iso8859-15"),), (("utf-8", "cp1254"),), (("utf-8", "koi8-r"),), (("utf-8", "cp866"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("utf-8", "latin-1"), ("utf-8", "latin-1")), (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    (("cp1251", "cp1252"),), (("cp1251", "latin-1"),), (("koi8-r", "cp1251"),), (("cp1251", "koi8-r"),), (("cp866", "cp1251"),), (("cp1251", "cp866"),), (("koi8-r", "cp1252"),), (("koi8-r", "latin-1"),), (("iso8859-5", "cp1251"),), (("cp866", "cp1252"),), (("cp1251", "mac_roman"),),
    (("cp1250", "cp1252"),), (("iso8859-2", "cp1252"),), (("iso8859-2", "latin-1"),), (("cp1250", "iso8859-2"),), (("iso8859-2", "cp1250"),), (("cp1252", "cp437"),), (("cp1252", "cp850"),), (("cp1252", "mac_roman"),), (("mac_roman", "cp1252"),), (("cp437", "cp1252"),), (("cp850", "cp1252"),),
    (("cp1252", "cp1250"),), (("cp1252", "cp1251"),),
]
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
#: What rightly written text hardly holds: a sign inside a word, two scripts in
#: a word, a Latin word mostly of foreign letters, a capital after a small Cyrillic letter.
_ODD = re.compile(
    r"[^\W\d_][^\w\s\x00-\x7f’‘…–—·«»“”„‹›]+[^\W\d_]|[A-Za-zÀ-ɏ][Ͱ-ϿЀ-ӿ]|[Ͱ-ϿЀ-ӿ][A-Za-zÀ-ɏ]"
    r"|(?<!\w)(?=\w{3,})[a-zA-Z]?[À-ÖØ-öø-ÿ]{2,}[a-zA-Z]?[À-ÖØ-öø-ÿ]*(?!\w)|[а-яё][А-ЯЁ]|[\x80-\x9f]"
)
_RUN = re.compile(r"[^\x00-\x7f]+")


def _table(codec: str) -> dict[int, str]:
    """Byte to character; bytes the codec leaves undefined pass as control characters."""
    out = {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


class Chains:
    """Garbling and its strict inverse for every chain."""

    def __init__(self) -> None:
        codecs = {c for chain in CHAINS for step in chain for c in step if c != "utf-8"}
        self.read = {c: _table(c) for c in codecs}
        self.write = {c: {v: k for k, v in t.items()} for c, t in self.read.items()}

    def decode(self, data: bytes, codec: str) -> str:
        return "".join(map(self.read[codec].__getitem__, data))

    def garble(self, text: str, k: int) -> str | None:
        for src, dst in CHAINS[k]:
            try:
                text = self.decode(text.encode(src), dst)
            except UnicodeEncodeError:
                return None
        return text

    def invert(self, text: str, k: int) -> str | None:
        """The only text that chain ``k`` turns into ``text``, or None."""
        for src, dst in reversed(CHAINS[k]):
            table = self.write[dst]
            try:
                data = bytes([table[c] for c in text])
                text = data.decode(src, "strict") if src == "utf-8" else self.strict(data, src)
            except (KeyError, UnicodeDecodeError):
                return None
        return text

    @staticmethod
    def strict(data: bytes, codec: str) -> str:
        return data.decode(codec, "strict")

    def invert_runs(self, text: str, k: int) -> tuple[str, int, int]:
        """Run by run, for lines of which characters were lost: (text, runs inverted, runs not)."""
        good = bad = 0

        def fix(m: re.Match) -> str:
            nonlocal good, bad
            r = self.invert(m.group(), k)
            if r is None or r == m.group():
                bad += 1
                return m.group()
            good += 1
            return r

        return _RUN.sub(fix, text), good, bad


def bigrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed bin of each byte bigram that touches a non-ASCII byte, its line)."""
    data = [b"\n" + x.encode("utf-8", "surrogatepass") + b"\n" for x in lines]
    lens = np.array([len(b) for b in data])
    a = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(lines)), lens)
    first, second = a[:-1], a[1:]
    use = ((first | second) >= 128) & (owner[:-1] == owner[1:])
    # digits are one sign, letters keep their case
    f, s = first[use], second[use]
    f, s = np.where((f >= 48) & (f <= 57), 48, f), np.where((s >= 48) & (s <= 57), 48, s)
    return (((f * np.uint32(256) + s) * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), owner[:-1][use]


class Classifier:
    """Multinomial naive Bayes: class 0 is clean, class k + 1 is chain k."""

    def __init__(self, clean_lines: list[str]) -> None:
        lines = sorted({x for x in clean_lines if _NON_ASCII.search(x)})
        self.fit(lines)
        # lines of the sample that are garbled themselves teach nothing about clean text
        kept = [x for x, (chain, _, _) in zip(lines, Repairer(self.logp).fields(lines)) if chain is None]
        if len(kept) < len(lines):
            self.fit(kept)

    def fit(self, lines: list[str]) -> None:
        ch = Chains()
        lines = lines + [x.upper() for x in lines if len(x) < 120]  # headlines in capitals
        rows = [self.row(lines)]
        for k in range(len(CHAINS)):
            garbled = (ch.garble(x, k) for x in lines)
            rows.append(self.row([g for g in garbled if g is not None and _NON_ASCII.search(g)]))
        self.logp = np.vstack(rows).astype(np.float32)

    @staticmethod
    def row(lines: list[str]) -> np.ndarray:
        count = np.bincount(bigrams(lines)[0], minlength=BINS) if lines else np.zeros(BINS)
        p = count + SMOOTH
        return np.log(p / p.sum())

    def scores(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lines x classes log-likelihoods, bigrams per line)."""
        bins, owner = bigrams(lines)
        n = np.bincount(owner, minlength=len(lines))
        out = np.zeros((len(lines), len(self.logp)), dtype=np.float64)
        for c, row in enumerate(self.logp):
            out[:, c] = np.bincount(owner, weights=row[bins], minlength=len(lines))
        return out, n


class Repairer:
    """Judges and restores lines; built once per task."""

    def __init__(self, logp: np.ndarray) -> None:
        self.model = Classifier.__new__(Classifier)
        self.model.logp = logp
        self.chains = Chains()

    def clean_score(self, line: str) -> float:
        """Mean log-likelihood of the line's bigrams as clean text; 0 for plain ASCII."""
        bins, _ = bigrams([line])
        return float(self.model.logp[0][bins].mean()) if len(bins) else -3.0

    def fix(self, line: str, order: list[int], clean: float) -> tuple[int, str, bool] | None:
        """(chain, restored, complete) of a garbled line, or None if it is clean after all.

        UTF-8 read as something else leaves byte sequences that decode by
        chance hardly ever; a chain of one-byte encodings always decodes, so
        it has to explain oddly written words as well.
        """
        best = None
        odd = len(_ODD.findall(line))
        for k in order:
            r = self.chains.invert(line, int(k))
            if r is not None and r != line:
                if CHAINS[k][0][0] != "utf-8" and (not odd or 2 * len(_ODD.findall(r)) >= odd):
                    continue
                gain = self.clean_score(r) - clean
                if gain >= GAIN and (best is None or gain > best[3]):
                    best = (int(k), r, True, gain)
        if best is None:
            for k in order:
                if CHAINS[k][0][0] != "utf-8" and not odd:
                    continue
                r, good, bad = self.chains.invert_runs(line, int(k))
                gain = self.clean_score(r) - clean
                if good and good >= bad and gain >= LOSSY_GAIN and (not odd or 2 * len(_ODD.findall(r)) < odd) and (best is None or gain > best[3]):
                    best = (int(k), r, False, gain)
        return best[:3] if best else None

    def fields(self, texts: list[str | None]) -> list[tuple[str | None, str | None, bool]]:
        """(chain or None, restored text, complete) for each field."""
        lines, where, out = [], [], []
        for f, text in enumerate(texts):
            if text and not text.isascii():
                for i, line in enumerate(text.split("\n")):
                    if not line.isascii():
                        lines.append(line)
                        where.append((f, i))
        repaired: dict[int, dict[int, tuple[str, str, bool]]] = {}
        if lines:
            s, n = self.model.scores(lines)
            lead = s[:, 1:].max(axis=1) - s[:, 0]
            for j, line in enumerate(lines):
                f, i = where[j]
                if "�" in line:
                    repaired.setdefault(f, {})[i] = ("lost", line, False)
                elif lead[j] > MARGIN:
                    # every chain that explains the line better than "clean" and is not ruled out by the best one is tried
                    least = max(s[j, 0] + MARGIN, s[j, 1:].max() - RULED_OUT)
                    order = [k for k in np.argsort(-s[j, 1:]) if s[j, k + 1] > least]
                    hit = self.fix(line, order, float(s[j, 0] / max(1, n[j])))
                    if hit:
                        name = " ".join(f"{a}>{b}" for a, b in CHAINS[hit[0]])
                        repaired.setdefault(f, {})[i] = (name, hit[1], hit[2])
        for f, text in enumerate(texts):
            fixes = repaired.get(f)
            if not fixes:
                out.append((None, None, False))
                continue
            parts = text.split("\n")
            for i, (_, r, _) in fixes.items():
                parts[i] = r
            names = [x[0] for x in fixes.values()]
            out.append((max(sorted(set(names)), key=names.count), "\n".join(parts), all(x[2] for x in fixes.values())))
        return out


def _repair(logp: np.ndarray, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Repairer(logp)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for k, name in ((1, "text"), (2, "title")):
                for i, (chain, text, whole) in zip(ids, r.fields(batch.column(k).to_pylist())):
                    if chain is not None:
                        rows.append((i, name, chain, whole, text if with_text else None))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()))], names=["read_id", "field_name", "chain", "recovered", "restored"])

    return run


# What texts in scripts and languages that may be rare look like.
_RARE = r"[а-я]{3}.*[а-я]{4} (?:и|в|на|не) |[ąęłżśćń].*(?: się | na | za | od )|ção|ções| não "


def training_lines(tables: list[DataFrame], texts: int = SAMPLE_TEXTS) -> list[str]:
    """Lines of a bounded sample, one scan a table.

    Of each table about ``texts`` texts, and as many of those in Cyrillic,
    Polish or Portuguese, by the hash of the text; at most four times as
    many are taken. Everything else covers all rows.
    """
    out: list[str] = []
    for df in tables:
        t = df.select("text").filter(F.col("text").isNotNull())
        n = max(1, df.count())  # from the files' footers
        u = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
        # rare scripts are looked for in sixteen times the sample
        pick = (u < texts / n) | ((u < min(1.0, 16 * texts / n)) & F.col("text").rlike(_RARE))
        rows = t.filter(pick).orderBy(F.xxhash64("text")).limit(4 * texts).collect()
        for r in rows:
            out.extend(r.text.split("\n"))
    return out


def repair_fields(reads: DataFrame, clean: list[DataFrame], with_text: bool = True) -> DataFrame:
    """(read_id, field_name, chain, recovered, restored) of every garbled field.

    Null, empty and plain ASCII fields are never garbled; a field with
    replacement characters is garbled beyond recovery (chain "lost");
    ``recovered`` says that all its garbled lines decoded strictly. An empty
    table gives no rows, repeated rows give repeated rows, other columns
    are ignored.
    """
    model = Classifier(training_lines(clean))
    schema = "read_id long, field_name string, chain string, recovered boolean, restored string"
    return reads.select("read_id", "text", "title").mapInArrow(_repair(model.logp, with_text), schema)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = read_table(spark, sf_dir, "webtools_bridge")
    return repair_fields(reads, [read_table(spark, sf_dir, "documents"), reads], with_text=False).select("read_id", "field_name").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled fields with the encoding chain and the text restored as far as it can be."""
    reads = read_table(spark, sf_dir, "webtools_bridge")
    return repair_fields(reads, [read_table(spark, sf_dir, "documents"), reads])


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored}
