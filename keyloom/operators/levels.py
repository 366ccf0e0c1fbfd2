"""Level planning: promotion, splitting, routing to shards, file occupancy, garbage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.operators import scan


def promotion(counts: DataFrame, n: str, threshold: int) -> DataFrame:
    return counts.withColumn("to_level", F.when(F.col(n) > threshold, "L1").otherwise("L0"))


def split_ranges(df: DataFrame, n: Column, limit: int, most_depth: int = 24) -> DataFrame:
    """Index ranges [lo, hi) bisected until none holds more than `limit`; each row of `df` gives one range [0, n).

    Bisection by index is closed: at depth d a range of n is cut at the points that halving gives; the loop runs on the
    driver over plans, not data, and ends when no range is too long.
    """
    ranges = df.select("*", F.lit(0).cast("long").alias("lo"), n.cast("long").alias("hi"))
    for _ in range(most_depth):
        if not ranges.filter(F.col("hi") - F.col("lo") > limit).limit(1).count():
            break
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
        parts = F.when(F.col("hi") - F.col("lo") > limit, halves).otherwise(F.array(F.struct("lo", "hi")))
        names = [c for c in ranges.columns if c not in ("lo", "hi")]
        ranges = ranges.select(*names, F.explode(parts).alias("r")).select(*names, "r.lo", "r.hi")
    return ranges


def shard_bounds(df: DataFrame, key: str, shards: int) -> DataFrame:
    """shard, lo, hi: bounds of `shards` parts of like size of the ordered, distinct keys; the parts leave no gap."""
    n = df.count()
    first = {i * n // shards + 1: i for i in reversed(range(shards))}
    placed = scan.ranked(df.select(key), key=key).filter(F.col("pos").isin([*first, n]))  # one row per shard, and the last key
    starts = placed.filter(F.col("pos").isin(list(first))).select(F.element_at(F.create_map(*(F.lit(x) for p, i in first.items() for x in (p, i))), F.col("pos").cast("int")).cast("long").alias("shard"), F.col(key).alias("lo"))
    top = placed.agg(F.max(key).alias("top"))
    ends = F.coalesce(F.lead("lo").over(Window.orderBy("shard")) - 1, F.col("top"))
    return starts.join(F.broadcast(top)).select("shard", "lo", ends.alias("hi"))  # one row


def _last_shard(probes: DataFrame, key: str, shards: DataFrame) -> DataFrame:
    """Probes with lo, hi and shard of the shard of the largest lo at or below the key, null if there is none.

    Shards and probes are dealt out together by range of lo and key; within a range the last shard before a probe is its
    own, and each range learns the last shard of the ranges before it. Neither side needs to be small.
    """
    marks = shards.select(F.col("lo").cast("long").alias("at"), F.lit(0).alias("probe"), F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("shard").cast("long").alias("shard")).alias("of"), F.lit(None).cast(probes.schema).alias("row"))
    asked = probes.select(F.col(key).cast("long").alias("at"), F.lit(1).alias("probe"), F.lit(None).cast(marks.schema["of"].dataType).alias("of"), F.struct(*probes.columns).alias("row"))
    placed = scan.in_ranges(marks.unionByName(asked), F.asc("at"), F.asc("probe"))
    inside = Window.partitionBy("range_part").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    tops = placed.groupBy("range_part").agg(F.max("of").alias("top"))  # one row per range; structs compare by lo
    before = Window.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("range_part", F.max("top").over(before).alias("carried"))
    found = placed.withColumn("mine", F.last("of", ignorenulls=True).over(inside)).join(F.broadcast(carried), "range_part")
    return found.filter("probe = 1").select("row.*", F.coalesce("mine", "carried").alias("of"))


def covering_shard(probes: DataFrame, key: str, shards: DataFrame) -> DataFrame:
    """Probes with the shard whose [lo, hi] covers them; shards do not overlap."""
    found = _last_shard(probes, key, shards).filter(F.col(key) <= F.col("of.hi"))
    return found.select(*probes.columns, F.col("of.lo").alias("lo"), F.col("of.hi").alias("hi"), F.col("of.shard").alias("shard"))


def owning_shard(probes: DataFrame, key: str, shards: DataFrame) -> DataFrame:
    """Probes with the shard of the largest lo at or below the key; keys below all go to the first."""
    first = shards.agg(F.min_by("shard", "lo").cast("long").alias("first_shard"))  # one row
    found = _last_shard(probes, key, shards).join(F.broadcast(first))
    return found.select(*probes.columns, F.coalesce("of.shard", "first_shard").alias("shard"))


def occupancy(entries: DataFrame, file: Column, size: Column, file_size: Column) -> DataFrame:
    """Per file its live bytes, its own size and the share of it that is live, in percent."""
    return entries.groupBy(file.alias("file")).agg(F.sum(size).cast("long").alias("live_bytes"), F.max(file_size).cast("long").alias("file_bytes"))


def reclaimable(files: DataFrame, live: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Files with no live entry, below all cut-offs."""
    return files.join(live, "file", "left_anti").filter(F.col("file") < min(cutoffs))
