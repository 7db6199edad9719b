"""Sinks and feeds of streaming queries: every micro-batch is committed once under its number."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotlens.plans.session import materialise
from lotlens.sources.commits import commit, committed
from lotlens.streaming.keyed import STATE_STORE


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    name, value = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def tail(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> StreamingQuery:
    """Commit every micro-batch under its number, then call ``each``; processes what is there and stops.

    A micro-batch repeated after a failure keeps its number, so its rows count once. ``each`` runs before the entry is
    made: where it fails, the batch has not happened.
    """
    def write(batch: DataFrame, number: int) -> None:
        if each:
            each(batch, number)
        commit(batch, path, number)
    with state_store(stream.sparkSession):
        return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and read its committed rows back; update mode adds the batch number of each."""
    tail(stream, f"{folder}/out", f"{folder}/checkpoint", mode=mode).awaitTermination()
    out = committed(stream.sparkSession, f"{folder}/out", stream.schema, with_batch=mode != "append")
    return out if mode == "append" else out.withColumn("batch", F.col("batch").cast("long"))


def upsert(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last row per key of an update-mode stream's drained rows."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def feed(rows: DataFrame, folder: str, time: str, slices: int = 4, disorder: str = "6 hours", held: Column | None = None, rows_per_file: int = 2_000_000,
         until: str = "400 days") -> DataFrame:
    """The table as a stream of ``slices`` micro-batches in which rows are up to ``disorder`` late and out of order.

    A hash decides each row's delay, so late rows fall into a later slice; rows that ``held`` names come with the last
    slice, too late for any watermark before it. A last row of nulls but for a time ``until`` after all others moves the
    watermark beyond them; keyed operators ignore it.
    """
    spark, rows = rows.sparkSession, materialise(rows)  # every slice reads them
    at = F.unix_micros(F.col(time).cast("timestamp"))
    low, high, n = rows.agg(F.min(at), F.max(at), F.count("*")).first()
    if not n:
        rows.write.mode("append").parquet(f"{folder}/in")
        return spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    span = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {disorder}"))
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(1000)) / 1000 * span
    slot = F.least(F.lit(slices - 1), F.floor((at + late - F.lit(low)) / math.ceil((high - low + 1) / slices)))
    if held is not None:
        slot = F.when(held, F.lit(slices - 1)).otherwise(slot)
    per_slice = max(1, math.ceil(n / slices / rows_per_file))
    for i in range(slices):
        rows.where(slot == i).repartition(per_slice).write.mode("append").parquet(f"{folder}/in")
    last = rows.agg(F.max(F.col(time).cast("timestamp")).alias("_at")).select((F.col("_at") + F.expr(f"INTERVAL {until}")).alias("_at"))
    last.select(*[(F.col("_at") if c == time else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_slice).parquet(f"{folder}/in")
