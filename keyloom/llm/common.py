"""What several operators share: words in SQL, stable columns, cutting lineage, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.operators.lineage import cut, small

__all__ = ["BLANK", "NOT_BLANK", "broadcast_if_small", "cut", "look_up", "map_batches", "ship", "table", "words"]

#: ASCII white space, as a class of Java's and Python's regular expressions
BLANK = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; of null, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def ship(spark: SparkSession) -> None:
    """Give this package's source to the workers, once per context, so that they need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_keyloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    name = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="package-")), "keyloom.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    context.addPyFile(name)  # served by the driver to every executor
    context._keyloom_shipped = True


def map_batches(df: DataFrame, work: Callable, schema: T.StructType | str) -> DataFrame:
    """`df.mapInArrow(work, schema)` with this package at hand on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df`, marked for broadcast only if a count shows it has at most `rows` narrow rows."""
    return small(df, rows)


def look_up(rows: DataFrame, on: str, table: DataFrame, key: str, most: int = 100_000, hot: int = 1000) -> DataFrame:
    """`rows` left-joined on `on` with a table whose `key` is unique, without the key; its other names must be new.

    A table of at most `most` rows is broadcast. Else keys that more than one in `hot` of the rows have are looked up in
    a broadcast of those keys' rows, fewer than `hot`, and the others by a shuffle: no task gets all rows of a hot key.
    """
    renamed = table.withColumnRenamed(key, "key_of_table")
    match = F.col(on) == F.col("key_of_table")
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(renamed), match, "left").drop("key_of_table")
    total = rows.count()
    frequent = cut(rows.groupBy(F.col(on).alias("hot_key")).count().filter(F.col("count") * hot > total).select("hot_key"))
    known = F.broadcast(renamed.join(F.broadcast(frequent), F.col("key_of_table") == F.col("hot_key"), "left_semi"))
    is_hot = F.col(on) == F.col("hot_key")
    some = rows.join(F.broadcast(frequent), is_hot, "left_semi").join(known, match, "left")
    rest = rows.join(F.broadcast(frequent), is_hot, "left_anti").join(renamed.hint("shuffle_merge"), match, "left")
    return some.unionByName(rest).drop("key_of_table")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
