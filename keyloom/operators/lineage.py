"""Cutting lineage through the shared checkpoint folder, folders for what a job writes, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context = spark.sparkContext
    if not hasattr(context, "_keyloom_folder"):
        context._keyloom_folder = tempfile.mkdtemp(prefix="checkpoint-")
    return context._keyloom_folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and read back from the shared checkpoint folder: no lineage, safe when executors are lost."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df`, marked for broadcast only if a count shows it has at most `rows` narrow rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
