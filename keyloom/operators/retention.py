"""What goes from a log or state: dropped ranges, destroyed key spaces, compactors, relocation filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan, state


def drop_range(log: DataFrame, first: str, last: str, at: int) -> DataFrame:
    """The log after whole cells from key `first` to key `last` were dropped at an offset: earlier writes there go."""
    return log.filter(~(F.col("k").between(first, last) & (F.col("off") < at)))


def destroy(log: DataFrame, spaces: list[str]) -> DataFrame:
    return log.filter(~F.col("ks").isin(spaces))


def newest_of_prefix(df: DataFrame, prefix: list[str], order: list[str]) -> DataFrame:
    """The common compactor: of each prefix the newest entry stays."""
    rest = [c for c in df.columns if c not in prefix]
    best = df.groupBy(*prefix).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*prefix, *(F.col(f"b.{c}").alias(c) for c in rest))


def compact(state_rows: DataFrame, cell: str, keep: Callable[[Column, Column], Column], key: str = "k") -> DataFrame:
    """A compactor: which of a cell's live keys stay, by their place in key order. Tombstones are not counted, and stay.

    `keep(place, n)` gives a condition from a key's place, from 1, and the number of live keys in its cell; it may name
    the state's own columns too. Only keys are dealt out by range to be numbered, so a cell may be of any size.
    """
    shown = state_rows.filter("kind = 'record'")
    placed = scan.places(shown.select(cell, key), [cell], [F.asc(key)], F.lit(1), "place")
    kept = shown.join(placed, [cell, key]).filter(keep(F.col("place"), F.col("place_all"))).select(*state_rows.columns)
    return kept.unionByName(state_rows.filter("kind <> 'record'"))


def relocate_by_log(log: DataFrame, keys: list[str], decide: Column, filtered: Column) -> DataFrame:
    """Log mode: the first logged record of a filtered key space that decides `stop` sets a cut for all; live entries
    of filtered key spaces below the cut go. No stop means that all of them are below it."""
    stops = log.filter(filtered & (F.col("kind") == "record") & (decide == "stop"))
    cut = stops.agg(F.min("off").alias("cut"))
    live = state.live(log, keys)
    return live.join(F.broadcast(cut)).filter(~filtered | (F.col("cut").isNotNull() & (F.col("off") >= F.col("cut")))).drop("cut")  # one row


def relocate_by_index(log: DataFrame, keys: list[str], decide: Column, target: int) -> DataFrame:
    """Index mode: live entries below the target that decide `remove` go; all others stay."""
    return state.live(log, keys).filter(~((F.col("off") < target) & (decide == "remove")))


def repoint(index: DataFrame, copies: DataFrame, frontier: int, keys: list[str]) -> DataFrame:
    """Compare and set: an entry moves to its copy's offset unless it was written at or after the frontier."""
    moved = copies.select(*keys, F.col("off").alias("new_off"))
    took = F.col("new_off").isNotNull() & (F.col("off") < frontier)
    return index.join(moved, keys, "left").select(*keys, F.when(took, F.col("new_off")).otherwise(F.col("off")).alias("off"), F.coalesce(took, F.lit(False)).alias("moved"))


def target_position(log: DataFrame, ratio: float) -> DataFrame:
    """The position at a ratio, held to 0..1, of the way from the lowest to the highest offset."""
    r = min(max(ratio, 0.0), 1.0)
    return log.agg((F.min("off") + F.floor((F.max("off") - F.min("off")) * F.lit(r))).cast("long").alias("target"))
