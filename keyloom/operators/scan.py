"""Reads of a state: points, batches of points, existence, ordered ranges both ways, prefixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions import keys
from keyloom.operators.lineage import cut


def bounded(state: DataFrame, lower: str | None = None, upper: str | None = None, key: str = "k") -> DataFrame:
    """Keys from `lower` (inclusive) to `upper` (exclusive)."""
    if lower is not None:
        state = state.filter(F.col(key) >= lower)
    return state if upper is None else state.filter(F.col(key) < upper)


def ordered(state: DataFrame, reverse: bool = False, key: str = "k") -> DataFrame:
    return state.orderBy(F.desc(key) if reverse else F.asc(key))


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """`df` dealt out by range of a total order, checkpointed, with `range_part`, the number of each row's range."""
    return cut(df.repartitionByRange(*order).withColumn("range_part", F.spark_partition_id()))


def running_sum(df: DataFrame, order: Column | list[Column], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over all rows up to each in `order`, which must be total.

    Rows are dealt out by range and summed within their partitions; the partitions' totals, one row each, give what
    lies ahead. No task sees all rows. The dealt rows are checkpointed: both uses must see the same ranges.
    """
    order = order if isinstance(order, list) else [order]
    placed = in_ranges(df, *order)
    inside = placed.withColumn(name, F.sum(value).over(Window.partitionBy("range_part").orderBy(*order)))
    totals = placed.groupBy("range_part").agg(F.sum(value).alias("total_of_range"))
    ahead = F.sum("total_of_range").over(Window.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1))
    first = totals.select("range_part", F.coalesce(ahead, F.lit(0)).alias("ahead_of_range"))
    return inside.join(first, "range_part").withColumn(name, F.col(name) + F.col("ahead_of_range")).drop("range_part", "ahead_of_range")


def places(df: DataFrame, by: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """`df` with, within its group `by`, the sum of `weight` up to each row as `name`, and the group's sum as `<name>_all`.

    `order` must be total within a group. However large a group is, its rows are dealt out by range.
    """
    upto = running_sum(df.withColumn("weight_of_row", weight.cast("long")), [*(F.asc(c) for c in by), *order], F.col("weight_of_row"), name)
    groups = upto.groupBy(*by).agg(F.min(F.col(name) - F.col("weight_of_row")).alias("ahead_of_group"), F.sum("weight_of_row").alias(f"{name}_all"))
    return upto.join(groups, by).withColumn(name, F.col(name) - F.col("ahead_of_group")).drop("ahead_of_group", "weight_of_row")


def earlier(df: DataFrame, by: list[str], order: list[Column], fold: Callable[[Column], Column], join: Callable[[Column, Column], Column], name: str, value: Column) -> DataFrame:
    """`df` with `name`: `fold` of `value` over the rows before each in its group `by`, null where nothing comes before.

    `order` must be total within a group; `join` puts two results of `fold` together and passes over nulls. Rows are
    dealt out by range, so a group may be of any size: of the ranges ahead only the result for the group that goes on
    travels, one row per range.
    """
    placed = in_ranges(df.withColumn("value_of_row", value), *(F.asc(c) for c in by), *order)
    group = F.struct(*by)
    inside = Window.partitionBy("range_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("range_part").agg(F.min(group).alias("low"), F.max(group).alias("high"))
    last = placed.join(F.broadcast(ends.select("range_part", "high")), "range_part").filter(group.eqNullSafe(F.col("high")))
    held = last.groupBy(F.col("range_part").alias("from_part")).agg(fold(F.col("value_of_row")).alias("held"), F.first("high").alias("goes_on"))
    ahead = ends.join(F.broadcast(held), F.col("low").eqNullSafe(F.col("goes_on")) & (F.col("from_part") < F.col("range_part")))
    carried = ahead.groupBy("range_part", "low").agg(fold(F.col("held")).alias("carried"))
    both = placed.withColumn(name, fold(F.col("value_of_row")).over(inside)).join(F.broadcast(carried), "range_part", "left")
    of_group = F.when(group.eqNullSafe(F.col("low")), F.col("carried"))
    return both.withColumn(name, join(F.col(name), of_group)).drop("range_part", "value_of_row", "low", "carried")


def ranked(state: DataFrame, by: list[str] | None = None, reverse: bool = False, key: str = "k") -> DataFrame:
    """`state` with `pos`, the place in the order of `key`, unique in `by` or in the whole table; only keys are numbered."""
    order = F.desc(key) if reverse else F.asc(key)
    names = [*(by or []), key]
    numbered = places(state.select(*names), by, [order], F.lit(1), "pos").drop("pos_all") if by else running_sum(state.select(key), order, F.lit(1).cast("long"), "pos")
    return numbered if set(state.columns) == set(names) else state.join(numbered, names)


def get(state: DataFrame, key_value: str, key: str = "k") -> DataFrame:
    return state.filter(F.col(key) == key_value)


def multi_get(state: DataFrame, probes: DataFrame, key: str = "k") -> DataFrame:
    """The rows of the probed keys that are live; one job for all probes."""
    return probes.select(key).distinct().join(state, key)


def exists(state: DataFrame, probes: DataFrame, key: str = "k") -> DataFrame:
    """The probed keys that are live; reads no value."""
    return probes.join(state.select(key), key, "left_semi")


def missing(state: DataFrame, probes: DataFrame, key: str = "k") -> DataFrame:
    return probes.join(state.select(key), key, "left_anti")


def less_than(state: DataFrame, bound: str, n: int, key: str = "k") -> DataFrame:
    """Up to n entries below `bound`, the highest first."""
    return state.filter(F.col(key) < bound).orderBy(F.desc(key)).limit(n)


def neighbours(state: DataFrame, by: list[str], key: str = "k") -> DataFrame:
    """Each key with the one before and the one after it, within `by`; keys are dealt out by range, however many there are.

    Only the first and the last key of each range travel to the ranges beside it.
    """
    names = [*by, key]
    placed = in_ranges(state.select(*names), *(F.asc(c) for c in names))
    inside = Window.partitionBy("range_part").orderBy(*names)
    here = F.struct(*names)
    ends = placed.groupBy("range_part").agg(F.min(here).alias("low"), F.max(here).alias("high"))  # one row per range
    parts = Window.orderBy("range_part")
    beside = ends.select("range_part", F.lag("high").over(parts).alias("ahead"), F.lead("low").over(parts).alias("behind"))
    both = placed.withColumn("lag", F.lag(here).over(inside)).withColumn("lead", F.lead(here).over(inside)).join(F.broadcast(beside), "range_part")
    of = lambda c: F.when(F.struct(*(F.col(f"{c}.{n}") for n in by)) == F.struct(*by), F.col(f"{c}.{key}")) if by else F.col(f"{c}.{key}")
    both = both.withColumn("before", F.coalesce("lag", "ahead")).withColumn("after", F.coalesce("lead", "behind"))
    return both.select(*names, of("before").alias("prev_key"), of("after").alias("next_key"))


def cell_range(state: DataFrame, lower: bytes, upper: bytes, cells: int, key: str = "k", cell: str = "cell") -> DataFrame:
    """A range over a state that is partitioned by uniform cell: the cells of the bounds prune partitions."""
    first, last = keys.uniform_cell_of(lower, cells), keys.uniform_cell_of(upper, cells)
    return bounded(state.filter(F.col(cell).between(first, last)), lower.hex(), upper.hex(), key)
