"""Maintenance jobs: state files with filters, sparse files rewritten, metrics of a run, jobs that can be cancelled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def walk(spark: SparkSession, path: str, start: int = 0, verify: bool = True) -> DataFrame:
    """A log from an offset on (inclusive), its pages' checksums verified or not."""
    if start < 0:
        raise ValueError("a log begins at 0")
    return spark.read.option("parquet.page.verify-checksum.enabled", str(verify).lower()).parquet(path).filter(F.col("off") >= start)


def write_state(state: DataFrame, path: str, cell: Column, key: str = "k", expected_keys: int = 1_000_000, rows_per_file: int = 5_000_000) -> None:
    """State files by cell, sorted by key, with row-group bounds and a bloom filter on the key.

    The rows of a cell are dealt out by key range too, so that a large cell is several files.
    """
    placed = state.withColumn("cell", cell)
    writer = placed.repartitionByRange("cell", key).sortWithinPartitions("cell", key).write.partitionBy("cell").option("maxRecordsPerFile", rows_per_file)
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(expected_keys)).parquet(path)


def sparse(files: DataFrame, percent: int) -> DataFrame:
    """Files whose live bytes are under a percentage of their size; the newest file is left alone."""
    top = files.agg(F.max("file").alias("top"))
    return files.join(F.broadcast(top)).filter((F.col("live_bytes") * 100 < F.col("file_bytes") * percent) & (F.col("file") < F.col("top"))).drop("top")  # one row


def rewrite(entries: DataFrame, chosen: DataFrame, next_file: int, entries_per_file: int) -> DataFrame:
    """Live entries of the chosen files moved to new files of so many entries, in key order; others as they are."""
    from keyloom.operators import scan

    moving = entries.join(chosen.select("file"), "file", "left_semi")
    moved = scan.ranked(moving).withColumn("file", F.lit(next_file) + F.expr(f"(pos - 1) div {entries_per_file}")).drop("pos")
    return entries.join(chosen.select("file"), "file", "left_anti").unionByName(moved.select(*entries.columns))


def observed(df: DataFrame, name: str, size: Column) -> tuple[DataFrame, Observation]:
    """`df` with counts of what passes through it when it runs: entries, records, removes, bytes."""
    seen = Observation(name)
    records, removes = F.count_if(F.col("kind") == "record"), F.count_if(F.col("kind") == "remove")
    return df.observe(seen, F.count(F.lit(1)).alias("entries"), records.alias("records"), removes.alias("removes"), F.sum(size).cast("long").alias("bytes")), seen


def in_group(spark: SparkSession, group: str, job: Callable[[], object]) -> object:
    """Run a job under a name by which `cancel` ends it from another thread."""
    context = spark.sparkContext
    context.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return job()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)
