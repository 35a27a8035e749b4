"""Problem 9: sources mixed to target shares of the total size.

Method: weighted fair queueing. Each document of a source's shuffled queue
gets a virtual finish time, the source's cumulative tokens divided by its
target share; the copies of all sources are range-sorted by it and cut off
at the total budget; of each source at most one copy lies across the cut,
and stays if most of it lies inside, so that large documents round evenly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.tokens import TOKENIZER, make_counter
from loomspan.session import materialize, read_table

SEED = 7
#: A source's queue is cut into 2**BUCKET_BITS runs of the shuffle order, so
#: that no task holds a whole source; sources x runs bounds the run table.
BUCKET_BITS = 10


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make_counter(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())], names=["doc_id", "source", "tokens"])

    return run


def clean_targets(targets: DataFrame) -> DataFrame:
    """Usable rows of the settings table: a source, a positive share and at least one use."""
    return targets.filter("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))


class Mix:
    """The queues of the sources in ``targets``, sized and ordered.

    Documents with null text, null source or a source without target are no
    candidates; empty texts have no size and are left out; a repeated row is
    another document. A target source without documents makes every budget
    zero, as its share cannot be met. ``budget`` (tokens) caps the total;
    without it the mix is the largest that max_repeats allows.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, budget: int | None = None, tokenizer: str = TOKENIZER) -> None:
        t = clean_targets(targets)
        # the settings table does not grow: one row per mixed source
        rows = docs.select("doc_id", "source", "text").filter(F.col("text").isNotNull()).join(F.broadcast(t.select("source")), "source", "left_semi").select("doc_id", "source", "text")
        sized = rows.mapInArrow(_count(tokenizer), "doc_id long, source string, tokens long").filter("tokens > 0")
        key = F.xxhash64(F.lit(SEED), "doc_id")
        self.sized = materialize(sized.select("doc_id", "source", "tokens", key.alias("u"), F.shiftright(key, 64 - BUCKET_BITS).alias("run")), "p9")
        runs = self.sized.groupBy("source", "run").agg(F.sum("tokens").alias("run_tokens"))
        order = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("source")
        self.runs = materialize(runs.select("source", "run", F.coalesce(F.sum("run_tokens").over(order), F.lit(0)).alias("before"), F.sum("run_tokens").over(whole).alias("source_tokens")), "p9runs")
        self.sources = t.join(self.runs.groupBy("source").agg(F.first("source_tokens").alias("source_tokens")), "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
        largest = self.sources.agg(F.min(F.col("source_tokens") * F.col("max_repeats") / F.col("share")).alias("t")).first().t or 0.0
        self.total = min(largest, float(budget)) if budget is not None else largest

    def copies(self) -> DataFrame:
        """(doc_id, source, repeat_no, tokens, finish_time) of every copy in the mix."""
        runs = self.runs.join(F.broadcast(self.sources.select("source", "share", "max_repeats")), "source")
        # sources x 2**BUCKET_BITS rows at most
        d = self.sized.join(F.broadcast(runs), ["source", "run"])
        queue = Window.partitionBy("source", "run").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = d.withColumn("cum", F.col("before") + F.sum("tokens").over(queue))
        # the copy that the budget cuts stays if most of it lies inside
        fits = F.floor((F.lit(self.total) * F.col("share") - F.col("cum") + F.col("tokens") / 2) / F.col("source_tokens")) + 1
        d = d.withColumn("times", F.least(F.greatest(fits, F.lit(0)), F.col("max_repeats")).cast("int")).filter("times > 0")
        d = d.select("doc_id", "source", "tokens", "cum", "share", "source_tokens", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("repeat_no"))
        finish = (F.col("repeat_no") * F.col("source_tokens") + F.col("cum")) / F.col("share")
        return d.select("doc_id", "source", "repeat_no", "tokens", finish.alias("finish_time"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))
    return mix.copies().orderBy("finish_time", "source", "doc_id", "repeat_no")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: target and reached share, tokens, copies and the repeats really used."""
    mix = Mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))
    got = mix.copies().groupBy("source").agg(F.sum("tokens").alias("mix_tokens"), F.count("*").alias("n_copies"), F.max("repeat_no").alias("last"))
    all_tokens = F.sum("mix_tokens").over(Window.partitionBy())  # one row per mixed source
    j = mix.sources.join(got, "source", "left").withColumn("mix_tokens", F.coalesce("mix_tokens", F.lit(0)))
    return j.select(
        "source", F.col("share").alias("target_share"), F.round(F.col("mix_tokens") / all_tokens, 6).alias("actual_share"), "source_tokens", "mix_tokens", F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        F.round(F.col("mix_tokens") / F.greatest("source_tokens", F.lit(1)), 6).alias("mean_repeats"), F.coalesce(F.col("last") + 1, F.lit(0)).alias("max_repeats_used"), "max_repeats",
    )


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
