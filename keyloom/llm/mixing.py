"""Mixing sources to target weights: whole corpus passes plus an exact cut per source.

Documents get a hash-random key. Within a source they are ordered by key; prefix sums of their sizes say where the
source's budget ends. The order is cut into key buckets, so that a source is never one group: bucket sums give each
bucket's offset (a window over at most 4**6 rows per source), and the sums inside a bucket are a window over that bucket
alone. A source whose budget exceeds its size is taken whole as often as it fits, and the rest from its first documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, words

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BUCKET_DIGITS = 3  # hexadecimal digits of the key that make a bucket


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target for one row per source: shares of the total by weight, capped, the excess reshared.

    Sources in code point order, null last, take the weights in turn. A target is min(most * size, level * weight) with
    the one level at which targets add up to the total. The table has one narrow row per source; it is ordered in one
    task, which some ten million sources would fill. Documents are never ordered there.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sources.withColumn("rank", rank).select("source", "source_size", "rank", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("double").alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(Window.partitionBy(F.lit(0))) - before) / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.select("*", level.alias("level"), F.row_number().over(by_ratio).alias("nth"))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    found = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("nth"))).over(Window.partitionBy(F.lit(0)))
    return levels.select("source", "source_size", F.least("cap", found * F.col("w")).alias("target"))


def _key(id_col: Column, size: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), id_col.cast("string"), size.cast("string")))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size (words), source_size, target, taken (words the mix takes, with repeats).

    `taken` adds up to the whole part of the source's target: only the document at the cut is taken in part. Null texts
    have size 0, a null source is a source of its own, null ids and repeated rows are rows like others; rows that agree
    in id and size are alike, so which of them comes first does not matter. An empty table gives an empty result.
    Other columns are ignored. Reruns agree: the key is a hash of id and size, not a random number.
    """
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size")))
    return _taken(sized, seed, weights, most).withColumnsRenamed({"id": id_col, "source": source_col})


def _taken(sized: DataFrame, seed: str, weights: tuple[int, ...], most: int) -> DataFrame:
    """`sized` (id, source, size and any more columns) with source_size, target and taken."""
    more = [c for c in sized.columns if c not in ("id", "source", "size")]
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # not null: a plain equality join keeps the partitioning
    keyed = sized.withColumn("key", _key(F.col("id"), F.col("size"), seed)).withColumns({"group": group, "bucket": F.substring("key", 1, BUCKET_DIGITS)})
    sums = cut(keyed.groupBy("group", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size")))
    goals = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    goals = goals.select(group.alias("group"), "source_size", "target", F.floor("target").alias("budget"))
    goals = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
    goals = goals.withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_size"))
    offset = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = sums.select("group", "bucket", offset.alias("offset")).join(goals, "group").select("group", "bucket", "offset", "source_size", "target", "passes", "rest")
    more_order = [F.xxhash64(c) for c in more]  # rows alike in id and size in a fixed order
    within = Window.partitionBy("group", "bucket").orderBy("key", "id", "size", *more_order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(buckets, ["group", "bucket"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.select("id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"), *more)


def mixed(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The mixed corpus itself: the columns of `docs`, each row as often as it is taken.

    A last, partial copy (one document per source) holds its first words, joined by blanks. Rows taken 0 times, and
    documents without a word (null and empty texts), are left out. `n_chars`, if there is such a column, follows a
    shortened text. A null source is a source, the last; null ids have a place in the order like others. Order within a
    source is by a hash of id and size; ties in it go by id and size, and rows that repeat both are interchangeable. A
    very long text is one row, and may be the one that is cut. An empty table gives an empty one. Other columns,
    whatever their names, go along.
    """
    names = docs.columns
    held = docs.select(F.col("doc_id").alias("id"), "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"))
    counted = _taken(held, seed, weights, most).filter("taken > 0")
    copies = F.concat(F.array_repeat(F.col("size"), F.expr("int(taken div size)")), F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(F.array().cast("array<bigint>")))
    each = counted.select("doc", "size", F.explode(copies).alias("part"))
    whole = F.col("part") == F.col("size")
    text = F.when(whole, F.col("doc")["text"]).otherwise(F.array_join(F.slice(words(F.col("doc")["text"]), 1, F.col("part").cast("int")), " "))
    columns = {c: F.col("doc")[c] for c in names} | {"text": text}
    if "n_chars" in names:
        columns["n_chars"] = F.when(whole, F.col("doc")["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return each.select(*(columns[c].alias(c) for c in names))
