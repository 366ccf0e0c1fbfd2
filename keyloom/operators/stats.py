"""Statistics of logs and states, and the integrity check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions import scalars
from keyloom.operators import scan

PERCENTS = (10, 50, 90, 99)


def by_kind(log: DataFrame, size: str) -> DataFrame:
    """Per kind: entries, bytes, average bytes (whole), share of all bytes in percent."""
    g = log.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.sum(size).cast("long").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy(F.lit(0)))
    return g.select("kind", "entries", "bytes", F.expr("bytes div entries").alias("avg_bytes"), scalars.share(F.col("bytes"), total).alias("share"))


def by_space(log: DataFrame, size: str) -> DataFrame:
    return log.groupBy("ks").agg(F.count_if(F.col("kind") == "record").alias("records"), F.count_if(F.col("kind") == "remove").alias("removes"), F.sum(size).cast("long").alias("bytes"))


def sizes(log: DataFrame, key_size: str, value_size: str) -> DataFrame:
    """Smallest, largest and average key size of all entries, and value size of records."""
    value = F.when(F.col("kind") == "record", F.col(value_size))
    return log.agg(
        F.min(key_size).cast("long").alias("min_key"), F.max(key_size).cast("long").alias("max_key"), F.floor(F.sum(key_size) / F.count(key_size)).cast("long").alias("avg_key"),
        F.min(value).cast("long").alias("min_value"), F.max(value).cast("long").alias("max_value"), F.floor(F.sum(value) / F.count(value)).cast("long").alias("avg_value"),
    )


def percentile_name(p: float) -> str:
    """p50, p99, p99_999."""
    return f"p{p:g}".replace(".", "_")


def distribution(df: DataFrame, by: list[str], value: str, percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    """Count, sum, whole average, least, most and exact percentiles (rank min(n * p div 100, n - 1)) of whole numbers.

    Values are counted first; the distinct ones of all groups are dealt out by range, so a group may have any number.
    """
    counts = df.groupBy(*by, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = scan.places(counts, by, [F.asc("x")], F.col("c"), "upto")
    pick = lambda p: F.min(F.when(F.col("upto") >= scalars.percentile_rank(F.col("upto_all"), p), F.col("x"))).cast("long").alias(percentile_name(p))
    return upto.groupBy(*by).agg(F.sum("c").cast("long").alias("n"), F.sum(F.col("x") * F.col("c")).cast("long").alias("total"), F.floor(F.sum(F.col("x") * F.col("c")) / F.sum("c")).cast("long").alias("mean"), F.min("x").cast("long").alias("least"), F.max("x").cast("long").alias("most"), *(pick(p) for p in percents))


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The exact median of each group: the middle value, or the mean of the two in the middle; nulls do not count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = scan.places(counts, by, [F.asc("x")], F.col("c"), "upto")
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("x")))
    n = F.col("upto_all")
    return upto.groupBy(*by).agg(((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2).alias("median"))


def throughput(df: DataFrame, by: list[str], at: str, size: str) -> DataFrame:
    """Operations and bytes a second of each group, from its first to its last time; null if these are one."""
    at_micros = F.unix_micros(F.col(at).cast("timestamp"))
    span = F.max(at_micros) - F.min(at_micros)
    rate = lambda x: F.when(span > 0, x * 1_000_000.0 / span)
    return df.groupBy(*by).agg(rate(F.count(F.lit(1))).alias("ops_per_second"), rate(F.sum(size)).alias("bytes_per_second"))


def verify(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """How many live keys of the log a state has, lacks, and has beside them."""
    e, f = expected.select(*keys).distinct().withColumn("e", F.lit(1)), found.select(*keys).distinct().withColumn("f", F.lit(1))
    both = e.join(f, keys, "full_outer")
    n = both.agg(F.count("e").alias("total"), F.count_if(F.col("e").isNotNull() & F.col("f").isNull()).alias("lacking"), F.count_if(F.col("e").isNull()).alias("surplus"))
    return n.withColumn("ok", (F.col("lacking") == 0) & (F.col("surplus") == 0))
