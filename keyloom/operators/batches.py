"""Write batches in a log: framing, torn batches, batches as arrays, the contiguous frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_counts(log: DataFrame, batch: Column, size: int) -> DataFrame:
    """Per batch its first offset, its number of frames, and whether that is the announced size."""
    counted = log.groupBy(batch.alias("batch")).agg(F.min("off").alias("first_off"), F.count(F.lit(1)).alias("frames"))
    return counted.withColumn("complete", F.col("frames") == size)


def cut_torn(log: DataFrame, batch: Column, size: int) -> DataFrame:
    """The log without a last batch that is incomplete: replay ends where that batch begins."""
    counts = frame_counts(log, batch, size)
    last = counts.agg(F.max_by(F.struct("first_off", "complete"), "batch").alias("b")).select("b.*")
    cut = last.select(F.when(~F.col("complete"), F.col("first_off")).alias("cut"))
    return log.join(F.broadcast(cut), F.col("cut").isNull() | (F.col("off") < F.col("cut"))).drop("cut")  # one row


def as_arrays(log: DataFrame, batch: Column, fields: list[str]) -> DataFrame:
    """One row per batch with its entries in offset order; a batch is a bounded unit of writing."""
    return log.groupBy(batch.alias("batch")).agg(F.min("off").alias("off"), F.array_sort(F.collect_list(F.struct("off", *fields))).alias("entries"))


def explode_batches(batches: DataFrame, fields: list[str]) -> DataFrame:
    """Entries of array batches; all share the batch's offset and are told apart by their place in it."""
    out = batches.select("batch", F.col("off").alias("batch_off"), F.posexplode("entries").alias("place", "e"))
    return out.select("batch", "batch_off", F.col("place").cast("long").alias("place"), *(F.col(f"e.{c}").alias(c) for c in fields))


def find_in_batches(batches: DataFrame, key: str) -> DataFrame:
    """Per batch the number of entries of a key, for batches that have it."""
    found = F.filter("entries", lambda e: e["k"] == key)
    return batches.select("batch", F.size(found).cast("long").alias("hits")).filter("hits > 0")


def frontier(done: DataFrame, order: str = "off") -> DataFrame:
    """The highest offset below which every offset from 0 on is done; -1 if 0 is not."""
    nxt = done.select((F.col(order) - 1).alias("pred"))
    ends = done.select(F.col(order).alias("pred")).join(nxt, "pred", "left_anti")
    started = done.agg((F.min(order) == 0).alias("s"))
    return ends.agg(F.min("pred").alias("m")).crossJoin(started).select(F.when(F.col("s"), F.col("m")).otherwise(F.lit(-1)).cast("long").alias("frontier"))
