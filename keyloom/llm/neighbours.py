"""Approximate nearest neighbours by cosine, with a forest of sorted hash strings.

A tree gives every vector a string of 64 bits, the signs of its projections on random directions through the mean of
the unit vectors, and keeps ids sorted by it; vectors stay where they are. A query descends in every tree to its longest
prefix match, which is where its own string stands. Then all trees ascend together, one bit of prefix at a time: at each
level a tree offers the rows that share so many first bits with the query. The trees stop at the deepest level at which
they have `candidates` rows together, repeats counted. Those rows are scored exactly, in double precision.

A tree is a range partitioning over the cluster, so no task holds a tree; places in a tree come from the partitions and
their counts, and a query goes to every partition that its ascent may reach, at most `candidates` rows on either side.
The first pass counts rows by level, the second sends the ids of the chosen level, those of a range of a tree in one row
per bucket of vectors. A bucket scores what its vectors meet. Equal vectors are taken together before, with their
smallest ids, as only those can be among the nearest.

Work per query is bounded by `candidates`, whatever the number of rows. Vectors without contrast (random ones, whose
near and far rows hardly differ) need more of them the more rows there are; the README has measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import blocks as B
from .common import cut, map_batches

TREES = 32
#: rows that all trees together offer a query at least, repeats counted
CANDIDATES = 30_000
BITS = 64
#: rows of a partition of the trees, and vectors of a bucket, about
PART_ROWS = 200_000
BUCKET_ROWS = 65_536
_OFFER = "bucket long, kind int, id long, body binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of double) of vectors that take part: not null, no null or non-finite component, not zero."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    held = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return held.filter(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0))


def _planes(tree: int, dim: int) -> np.ndarray:
    return np.random.default_rng([7, tree, dim]).normal(size=(dim, BITS)).astype(np.float32)


def _strings(trees: int, mean: dict[int, np.ndarray], schema: T.StructType):  # noqa: ANN202
    """A row per vector and tree: dim, tree, h (the string as an ordered long), id, asks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.uint64(1) << np.arange(BITS, dtype=np.uint64)[::-1]
        for batch in batches:
            ids, asks, lists = batch.column(0), batch.column(1), batch.column(2)
            length = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(length)])
            for dim in np.unique(length).tolist():
                rows = np.flatnonzero(length == dim)
                x = flat[(first[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)
                y = x / np.abs(x).max(axis=1, keepdims=True)
                unit = (y / np.linalg.norm(y, axis=1, keepdims=True) - mean.get(dim, 0)).astype(np.float32)
                take, n = pa.array(rows), len(rows)
                for tree in range(trees):
                    h = ((unit @ _planes(tree, dim) > 0) * powers).sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)  # signed order is the strings' order
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, dtype=np.int32)), pa.array(np.full(n, tree, dtype=np.int32)), pa.array(h.view(np.int64)), ids.take(take), asks.take(take)], names=schema.names)

    return work


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _by_tree(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """Of each part of a tree: its rows' ids and strings, and for its queries their ids, strings, level, the row that each
    one is (or -1), and the rows of this part, from and to, within `most` places of it."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    part, dim, tree, place, ids, level = (whole.column(c).to_numpy() for c in ("part", "dim", "tree", "place", "id", "level"))
    h = whole.column("h").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    asked = whole.column("asked").to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (dim[1:] != dim[:-1]) | (tree[1:] != tree[:-1]), [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        c = a + int(np.searchsorted(asked[a:b], True))  # rows, then queries
        if a < c < b:
            at = place[c:b] - place[a]  # places of a part's rows follow each other
            own = np.where((at >= 0) & (at < c - a), at, -1)
            yield ids[a:c], h[a:c], ids[c:b], h[c:b], level[c:b], own, np.maximum(at - most, 0), np.minimum(at + most + 1, c - a)


def _sharing(rows: np.ndarray, asked: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, from and to, that share the first `level` bits with each of the strings asked for."""
    free = np.where(level > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(level, 63).astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
    free = np.where(level >= BITS, np.uint64(0), free)
    return np.searchsorted(rows, asked & ~free, side="left"), np.searchsorted(rows, asked | free, side="right")


def _count(most: int):  # noqa: ANN202
    """(q, level, n): how many rows of a part share exactly `level` first bits with a query, itself aside."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, q, asked, _, own, low, high in _by_tree(batches, most):
            before = np.zeros(len(q), dtype=np.int64)
            out = []
            for level in range(BITS, -1, -1):
                first, last = _sharing(h, asked, np.full(len(q), level))
                n = np.maximum(np.minimum(last, high) - np.maximum(first, low), 0) - (own >= 0)
                some = np.flatnonzero(n > before)
                out.append((q[some], np.full(len(some), level, dtype=np.int32), (n - before)[some]))
                before = np.maximum(n, before)
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "level", "n"])

    return work


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _offer(most: int, buckets: int):  # noqa: ANN202
    """(bucket, kind 2, body): the ids, of one bucket, that a part of a tree offers its queries at their levels."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, q, asked, level, own, low, high in _by_tree(batches, most):
            first, last = _sharing(h, asked, level)
            first, last = np.maximum(first, low), np.minimum(last, high)
            order = np.argsort(ids)  # ids ascend in what is sent
            rank = np.empty(len(ids), dtype=np.int64)
            rank[order] = np.arange(len(ids))
            ascending, bucket = ids[order], bucket_of(ids[order], buckets)
            lists = []
            for i in range(len(q)):
                some = rank[first[i] : max(last[i], first[i])]
                lists.append(np.sort(some[some != rank[own[i]]] if own[i] >= 0 else some))
            flat = np.concatenate(lists)
            who = np.repeat(np.arange(len(q)), [len(x) for x in lists])
            for b in np.unique(bucket[flat]).tolist():
                mine = np.flatnonzero(bucket[flat] == b)
                listed = np.unique(flat[mine])  # places in this list are small numbers
                place = np.searchsorted(listed, flat[mine])
                begin = np.concatenate([[True], who[mine][1:] != who[mine][:-1]])
                step = np.where(begin, place, np.diff(place, prepend=0))
                body = B.pack(ascending[listed], q[who[mine][begin]], np.diff(np.append(np.flatnonzero(begin), len(mine))), B.planes(step.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([2], pa.int32()), pa.array([0]), pa.array([body], pa.binary())], names=["bucket", "kind", "id", "body"])

    return work


def _score(keep: int):  # noqa: ANN202
    """Over rows by (bucket, kind): vectors (0), queries (1), offers (2). The best `keep` of a bucket for each query."""

    def best(x_ids: list, x_raw: list[bytes], q_ids: list, q_raw: list[bytes], offers: list[bytes]) -> pa.RecordBatch | None:
        order = np.argsort(np.array(x_ids, dtype=np.int64))
        ids, raw = np.array(x_ids, dtype=np.int64)[order], [x_raw[i] for i in order.tolist()]
        length = np.array([len(r) for r in raw])
        places: dict[int, list[np.ndarray]] = {}
        for body in offers:
            listed, q, n, steps = B.unpack(body)
            local = np.searchsorted(ids, listed)
            flat, at = B.from_planes(steps).astype(np.int64), np.cumsum([0, *n.tolist()])
            for who, a, b in zip(q.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                places.setdefault(who, []).append(local[np.cumsum(flat[a:b])])
        matrix: dict[int, np.ndarray] = {}
        number = np.empty(len(ids), dtype=np.int64)
        for size in np.unique(length).tolist():
            rows = np.flatnonzero(length == size)
            number[rows] = np.arange(len(rows))
            matrix[size] = np.frombuffer(b"".join(raw[i] for i in rows.tolist()), dtype=np.float64).reshape(len(rows), -1)
        out = []
        for who, text in zip(q_ids, q_raw, strict=True):
            if who in places:
                some = np.unique(np.concatenate(places[who]))
                y = np.frombuffer(text, dtype=np.float64)
                x = matrix[len(text)][number[some]]
                score = cosine(x, np.broadcast_to(y, x.shape))
                if len(some) > keep:
                    limit = np.partition(score, -keep)[-keep]
                    top = np.flatnonzero(score >= limit)  # with all ties
                    top = top[np.lexsort((ids[some[top]], -score[top]))][:keep]
                    some, score = some[top], score[top]
                out.append((np.full(len(some), who), ids[some], score))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["q", "c", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [], [])
        for batch in batches:
            for bucket, kind, i, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if now is not None and (out := best(*held)) is not None:
                        yield out
                    now, held = bucket, ([], [], [], [], [])
                if kind == 2:
                    held[4].append(body)
                else:
                    held[2 * kind].append(i)
                    held[2 * kind + 1].append(body)
        if now is not None and (out := best(*held)) is not None:
            yield out

    return work


def _raw(buckets: int):  # noqa: ANN202
    """(bucket, kind, id, body) of vectors and of queries; a query goes to every bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            flat, edge = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            body = [flat[a:b].astype(np.float64).tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            some = np.flatnonzero(asks)
            where = np.concatenate([bucket_of(ids, buckets), np.repeat(np.arange(buckets), len(some))])
            kind = np.repeat(np.array([0, 1], dtype=np.int32), [len(ids), len(some) * buckets])
            names = np.concatenate([ids, np.tile(ids[some], buckets)])
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(kind), pa.array(names), pa.array(body + [body[i] for i in some.tolist()] * buckets, pa.binary())], names=["bucket", "kind", "id", "body"])

    return work


def _walks(ordered: DataFrame, levels: DataFrame | None, most: int) -> DataFrame:
    """Rows of the trees with their places, and each query once for every part of its tree that its ascent may reach.

    ordered: rows sorted by (dim, tree, h, id) over the parts in order, each with its part and its row there.
    """
    tree = Window.partitionBy("dim", "tree").orderBy("part")
    runs = ordered.groupBy("dim", "tree", "part").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("first_row"))
    runs = cut(runs.withColumn("ahead", F.sum("size").over(tree) - F.col("size")))  # a row per part and tree in it
    placed = ordered.join(F.broadcast(runs), ["dim", "tree", "part"]).withColumn("place", F.col("row") - F.col("first_row") + F.col("ahead"))
    names = ["part", "dim", "tree", "asked", "place", "id", "h", "level"]
    asking = placed.filter("asks").select("dim", "tree", "place", "id", "h", F.lit(True).alias("asked"))
    asking = asking.withColumn("level", F.lit(0)) if levels is None else asking.join(levels, "id")
    met = (F.col("ahead") <= F.col("place") + most) & (F.col("ahead") + F.col("size") > F.col("place") - most)
    return placed.withColumn("asked", F.lit(False)).withColumn("level", F.lit(0)).select(names).unionByName(asking.join(F.broadcast(runs), ["dim", "tree"]).filter(met).select(names))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = TREES, candidates: int = CANDIDATES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that `is_query` (of column `id`) selects.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do null ids. A query is never
    its own candidate; its copies are. Vectors of different lengths do not meet. Ties in score go to the smaller id;
    a row that repeats an id and its vector counts once. A table with fewer than k other rows gives them all; an empty
    one gives nothing. Other columns are ignored, whatever their names.
    """
    rows = usable(vectors, id_col, vector_col).withColumn("key", F.struct(F.xxhash64("v"), F.hash("v"))).dropDuplicates(["id", "key"])
    rows = cut(rows.select("id", "key", "v", is_query.alias("asks")))
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("nth") <= k + 1)
    asking = rows.filter("asks").groupBy("key").agg(F.count(F.lit(1)).alias("n_asks"))
    copies = cut(few.join(asking, "key", "left").select("key", "id", "nth", "v", F.col("n_asks").isNotNull().alias("asks")))
    one = copies.filter("nth = 1").select("id", "asks", "v")
    n = one.count()
    unit = one.select(F.size("v").alias("dim"), F.posexplode(F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)))).alias("at", "x"))
    means: dict[int, np.ndarray] = {}
    for r in unit.groupBy("dim", "at").agg(F.avg("x").alias("x")).collect():  # one number per component
        means.setdefault(r["dim"], np.zeros(r["dim"]))[r["at"]] = r["x"] if r["x"] is not None and np.isfinite(r["x"]) else 0.0
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("tree", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("id", T.LongType()), T.StructField("asks", T.BooleanType())])
    order = ["dim", "tree", "h", "id"]
    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, buckets = max(least, n * trees // PART_ROWS), max(least // 2, 1 + n // BUCKET_ROWS)
    long_ids = one.withColumn("id", F.col("id").cast("long"))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    strings = map_batches(long_ids, _strings(trees, means, schema), schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = cut(strings.select("dim", "tree", "h", "id", "asks", F.spark_partition_id().alias("part"), at.alias("row")))
    walk = lambda levels: _walks(ordered, levels, candidates).repartition(parts, "part").sortWithinPartitions("part", "dim", "tree", "asked", "place")
    counted = map_batches(walk(None), _count(candidates), "q long, level int, n long").groupBy("q", "level").agg(F.sum("n").alias("n"))
    deepest = Window.partitionBy("q").orderBy(F.desc("level"))  # 65 levels
    enough = counted.withColumn("sum", F.sum("n").over(deepest)).groupBy("q").agg(F.coalesce(F.max(F.when(F.col("sum") >= candidates, F.col("level"))), F.lit(0)).alias("level"))
    offers = map_batches(walk(cut(enough.withColumnRenamed("q", "id"))), _offer(candidates, buckets), _OFFER)
    meet = map_batches(long_ids, _raw(buckets), _OFFER).unionByName(offers).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    found = map_batches(meet, _score(k), "q long, c long, score double")
    best = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("nth") <= k)
    itself = one.filter("asks").select(F.col("id").alias("q"), F.col("id").alias("c"), F.lit(None).cast("double").alias("score"))
    both = best.select("q", "c", "score").unionByName(itself)
    # from distinct vectors back to rows: candidates are a vector's smallest ids, queries all of its query ids
    first_of = copies.filter("nth = 1").select("key", F.col("id").alias("first"))
    members = copies.join(first_of, "key").select(F.col("first").alias("c"), "id", "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))
    own = F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y) / (norm * norm)
    ids = both.join(members, "c").select("q", F.coalesce("score", own).alias("score"), F.col("id").alias("cid"))
    top = ids.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))).filter(F.col("nth") <= k + 1)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("cid").alias("c")))).alias("near"))  # k + 1 entries
    asked = rows.filter("asks").join(first_of, "key").select(F.col("id").alias("query_id"), F.col("first").alias("q"))
    each = asked.join(lists, "q").select("query_id", F.slice(F.filter("near", lambda x: x["c"] != F.col("query_id")), 1, k).alias("near"))
    out = each.select("query_id", F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.c").alias("vec_id"), (-F.col("x.s")).alias("score"))
