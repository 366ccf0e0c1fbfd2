"""Live state from a change log: the latest version of each key, now or as of an offset.

A log has a key, an offset that orders versions and is unique, and a kind: `record` or `remove`. Tombstones win over
older records and are dropped only after the latest version is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators import scan


def newest(log: DataFrame, keys: list[str], order: str = "off") -> DataFrame:
    """The row with the highest `order` of each key; map-side partial, so a key of many versions sends one per task."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def as_of(log: DataFrame, limit: int, order: str = "off") -> DataFrame:
    """Versions visible below an offset (exclusive); to be taken before the latest is chosen."""
    return log.filter(F.col(order) < limit)


def not_yet(log: DataFrame, limit: int, order: str = "off") -> DataFrame:
    return log.filter(F.col(order) >= limit)


def without_tombstones(state: DataFrame) -> DataFrame:
    return state.filter(F.col("kind") == "record")


def live(log: DataFrame, keys: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The live rows: newest version per key, as of `limit` if given, tombstones gone."""
    return without_tombstones(newest(log if limit is None else as_of(log, limit), keys or ["k"]))


def versions(log: DataFrame, keys: list[str]) -> DataFrame:
    """Every version with its number, 1 for the newest of its key; a key may have any number of versions."""
    newer = scan.earlier(log, keys, [F.desc("off")], F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "version", F.lit(1).cast("long"))
    return newer.withColumn("version", F.col("version") + 1)


def stale(log: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Writes that arrive after a write of a higher offset to the same key; `arrival` is a total order of a key's writes."""
    seen = scan.earlier(log, keys, [F.asc(c) for c in arrival], F.max, F.greatest, "highest", F.col("off"))
    return seen.filter(F.col("off") < F.col("highest"))


def difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two states: added, removed or changed."""
    b, a = before.select(F.col(key).alias("bk"), F.col(value).alias("old")), after.select(F.col(key).alias("ak"), F.col(value).alias("new"))
    both = b.join(a, F.col("bk") == F.col("ak"), "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("bk").isNull(), "added").when(F.col("ak").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("bk", "ak").alias(key), "old", "new", change.alias("change"))


def merge_levels(levels: list[DataFrame], keys: list[str], keep_tombstones: bool = False) -> DataFrame:
    """Levels, newest first, merged: of each key the version of the first level that has it, whatever the offsets."""
    tagged = [df.withColumn("lvl", F.lit(i)) for i, df in enumerate(levels)]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df)
    rest = [c for c in union.columns if c not in keys]
    best = union.groupBy(*keys).agg(F.min_by(F.struct(*rest), "lvl").alias("best"))
    merged = best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))
    return merged if keep_tombstones else without_tombstones(merged)


def last_wins(log: DataFrame, batch: Column, keys: list[str]) -> DataFrame:
    """Within each batch the last write of each key, tombstones included."""
    return newest(log.withColumn("batch", batch), ["batch", *keys])
