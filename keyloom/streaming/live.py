"""Live state of a log that arrives as a stream of files, and commits per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keyloom.operators import state
from keyloom.sources.store import Store


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None, glob: str = "*.parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give what has arrived to `work`, batch by batch, then stop; a restart goes on from the checkpoint.

    After a failure the last batch comes again under its number, so `work` must be one that may be repeated.
    """
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def keep_newest(stream: DataFrame, folder: str, checkpoint: str, key: str = "k", order: str = "off") -> DataFrame:
    """The newest version of each key of all that has arrived, by offset and not by arrival, so late writes never win.

    Each batch is merged with the state before it into a folder of its own, which a repeated batch writes over: the
    state is a distributed table, and nothing of it comes to the driver.
    """
    spark = stream.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)

    def versions() -> list[int]:
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def merge(rows: DataFrame, batch: int) -> None:
        before = [v for v in versions() if v < batch]
        held = spark.read.schema(rows.schema).parquet(f"{folder}/{before[-1]}").unionByName(rows) if before else rows
        state.newest(held, [key], order).select(*rows.columns).write.mode("overwrite").parquet(f"{folder}/{batch}")

    run_batches(stream, merge, checkpoint)
    there = versions()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{there[-1]}") if there else spark.createDataFrame([], stream.schema)


def commit_batches(stream: DataFrame, store: Store, source: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch (ks, k, v, kind, nth) becomes one commit of the store, once, however often it is repeated."""
    return run_batches(stream, lambda rows, batch: store.commit(rows, source, batch), checkpoint)


def frontier(rows: DataFrame) -> int:
    """The highest offset of a state; -1 if it is empty."""
    got = rows.agg(F.max("off")).first()[0]
    return -1 if got is None else got


def periodically(stream: DataFrame, job: Callable[[DataFrame, int], None], every: str, checkpoint: str) -> StreamingQuery:
    """Run a job on each micro-batch at an interval: periodic snapshots, promotion. The caller stops the query."""
    return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def paced(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """A stream of writes at a steady pace: offsets and 16-digit hex keys."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rows.select(F.col("value").alias("off"), F.format_string("%016x", F.col("value") % 1000).alias("k"), F.lit("record").alias("kind"))
