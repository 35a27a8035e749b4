"""The wall memory as a Structured Streaming job over the check log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from loomspan.operators import wall as W
from loomspan.session import shared_dir

_STATE_TYPE = "rung int, wall_streak int, boxed_until double, last_seen double, verdict string, n_walls long"


def wall_stream(spark: SparkSession, path: str, late: str = "7 days") -> DataFrame:
    """Streaming states per host: every trigger gives the hosts that changed.

    Checks delivered twice are dropped within ``late`` of the newest event
    time, which bounds the memory of their ids.
    """
    schema = spark.read.parquet(path).schema
    log = spark.readStream.schema(schema).parquet(path + "*")
    kind = W.outcome(F.col("alive"), F.col("blocked"), F.col("status"))
    rows = log.withWatermark("checked_at", late).dropDuplicatesWithinWatermark(["check_id"]).select(W.host_key(F.col("host")).alias("host"), F.unix_micros("checked_at").alias("ts"), "check_id", kind.alias("kind"))
    rows = rows.filter("host is not null and host <> '' and ts is not null and kind is not null")
    return rows.groupBy("host").applyInPandasWithState(W.update_state, W.STATE, _STATE_TYPE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(spark: SparkSession, path: str) -> DataFrame:
    """Drain what lies at ``path`` and return the last state of every host."""
    base = f"{shared_dir(spark)}/loomspan-stream-{uuid.uuid4().hex}"
    out = f"{base}/states"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    wall_stream(spark, path).writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(out).groupBy("host").agg(F.max_by(F.struct("rung", "wall_streak", "boxed_until", "last_seen", "verdict", "n_walls"), "batch").alias("s"))
    return latest.select("host", "s.*")
