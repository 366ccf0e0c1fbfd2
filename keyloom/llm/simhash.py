"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 bits. Copies of one fingerprint are grouped first, so that all later work is on distinct
fingerprints. Bits that go together are put into the same partition, and partition i gets a threshold t_i with
sum(t_i + 1) = distance + 1: two fingerprints within the distance then agree up to t_i bits in some partition i. A
threshold of -1 skips a partition. Partitions and thresholds are chosen by dynamic programming on estimated candidate
counts, which come from counts over all fingerprints. Candidates share a probe key and are verified.

A probe key that too many fingerprints share is not compared pairwise. Its members take an exact way that is linear:
each emits itself and its 64 neighbours at one bit; fingerprints that meet in such a neighbour are within two bits, and
any two within two bits meet in one. At most 65 distinct fingerprints meet in a place.

Components come from labels that spread along links and jump to their label's label, in checkpointed rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import broadcast_if_small, cut, look_up, map_batches

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 2
#: a probe key with more fingerprints goes the linear way
MOST_COMPARED = 64


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text: per bit, whether over half of its word shingles' hashes have it."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint as a signed long) of every row; a null text has no word, hence fingerprint zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.slices(batches):
            known: dict[str, int] = {}  # copies within the slice
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                if text not in known:
                    known[text] = fingerprint(text)
                out.append(known[text])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return map_batches(docs.select(id_col, text_col), work, schema)


def bit_pairs(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64 counts, summed over partitions)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(fps), both + bits.T @ bits
        if n:
            cells = np.append(both.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    rows = map_batches(distinct.select("fp"), work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,097 numbers
    flat = np.zeros(BITS * BITS + 1)
    for cell, n in rows:
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of like size; a group grows by the bit that correlates most with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        room = (BITS - sum(map(len, out))) // (parts - k)
        group = [max(left, key=lambda b: (correlation[b, list(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < room:
            best = max(left, key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def _projected(part: list[int]):  # noqa: ANN202
    mask = sum(1 << b for b in part)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 and the least summed cost; costs[i][t + 1] for t = -1..distance."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (total, ts) in best.items():
            for t in range(-1, distance + 1):
                to = used + t + 1
                if to <= distance + 1 and (to not in new or total + cost[t + 1] < new[to][0]):
                    new[to] = (total + cost[t + 1], [*ts, t])
        best = new
    return best[distance + 1]


def plan(distinct: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, for two or three partitions, whichever is estimated cheaper."""
    n, both = bit_pairs(distinct)
    ways = [correlated_parts(n, both, m) for m in (2, 3)]
    parts = [part for way in ways for part in way]
    keys = distinct.select(F.explode(F.array(*(F.struct(F.lit(i).alias("part"), _projected(part).alias("v")) for i, part in enumerate(parts)))).alias("k"))
    counts = keys.groupBy("k.part", "k.v").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * F.when(F.col("count") <= MOST_COMPARED, F.col("count")).otherwise(BITS + 1)).alias("pairs")).collect()  # five numbers; large groups cost a linear way
    same = {r["part"]: r["pairs"] - n for r in counts}
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    found = []
    for k, way in enumerate(ways):
        costs = []
        for i, part in enumerate(way):
            ratios = differ[part] / np.maximum(1 - differ[part], 1e-9)
            once = ratios.sum()
            twice = (once**2 - (ratios**2).sum()) / 2
            pairs = same.get(sum(map(len, ways[:k])) + i, 0.0) + 1
            w = len(part)
            costs.append([0.0, n + pairs, n * (2 + w) + pairs * (1 + once), n * (2 + w + w * w / 2) + pairs * (1 + once + twice)][: distance + 2])
        found.append((*allocate(costs, distance), way))
    _, thresholds, way = min(found, key=lambda x: x[0])
    return [(part, t) for part, t in zip(way, thresholds, strict=True) if t >= 0]


def _probes(part_number: int, part: list[int], t: int):  # noqa: ANN202
    """Array of (part, key, own): the projection, and for a threshold above zero its changes in up to t bits."""
    own = _projected(part)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    flips = [0] + [1 << a for a in part] * (t > 0) + [1 << a | 1 << b for i, a in enumerate(part) for b in part[:i]] * (t > 1)
    return F.transform(F.array(*(F.lit(signed(f)).cast("long") for f in flips)), lambda f: F.struct(F.lit(part_number).alias("part"), own.bitwiseXOR(f).alias("v"), (f == 0).alias("own")))


def _links_in_groups(distance: int):  # noqa: ANN202
    """Verified links among neighbours in order of (part, v); groups are small, or were taken out before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def linked(part: np.ndarray, v: np.ndarray, own: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a_all, b_all = [], []
            alive = np.arange(len(fp))
            for d in range(1, len(fp)):
                alive = alive[alive + d < len(fp)]
                alive = alive[(part[alive] == part[alive + d]) & (v[alive] == v[alive + d])]
                if not len(alive):
                    break
                x, y = fp[alive], fp[alive + d]
                good = (own[alive] | own[alive + d]) & (np.bitwise_count(x ^ y) <= distance) & (x != y)
                a_all.append(np.maximum(x[good].view(np.int64), y[good].view(np.int64)))
                b_all.append(np.minimum(x[good].view(np.int64), y[good].view(np.int64)))
            empty = np.empty(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_all or [empty])), pa.array(np.concatenate(b_all or [empty]))], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[3] = cols[3].view(np.uint64)
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1]) + 1 if ((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])).any() else 0
            held = [c[last:].copy() for c in cols]  # the last group may go on
            if last:
                yield linked(*(c[:last] for c in cols))
        if held is not None and len(held[0]):
            yield linked(*held)

    return work


def links(distinct: DataFrame, distance: int = DISTANCE, most: int = MOST_COMPARED) -> DataFrame:
    """(a, b), a > b: links among distinct fingerprints `fp`, with the same components as all pairs within `distance`.

    Each is a pair within `distance`. Small groups give all their pairs; members of groups too large to compare are
    linked to the smallest fingerprint that they meet in a common neighbour.
    """
    if distance != 2:
        raise ValueError("the way for large groups is made for a distance of 2")
    chosen = plan(distinct, distance)
    probes = F.flatten(F.array(*(_probes(i, part, t) for i, (part, t) in enumerate(chosen))))
    keyed = cut(distinct.select("fp", F.explode(probes).alias("k")).select("k.part", "k.v", "k.own", "fp"))
    big = cut(keyed.groupBy("part", "v").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).filter(F.col("n") > most).select("part", "v", "any_own"))
    small = keyed.join(broadcast_if_small(big), ["part", "v"], "left_anti").select("part", "v", "own", "fp")
    compared = map_batches(small.repartition("part", "v").sortWithinPartitions("part", "v", "fp"), _links_in_groups(distance), "a long, b long")
    crowd = keyed.join(broadcast_if_small(big.filter("any_own")), ["part", "v"], "left_semi").select("fp").distinct()  # without an own member no pair meets
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)))
    met = crowd.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("z"))
    starred = met.groupBy("z").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    starred = starred.select(F.explode("fps").alias("a"), "b").filter("a <> b")
    return compared.unionByName(starred).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that it reaches) of every node on a link (a, b)."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(broadcast_if_small(labels), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # in a large component most nodes have one label
        jump = look_up(cut(lower), "label", labels.select(F.col("node").alias("at"), F.col("label").alias("to")), "at")
        new = cut(jump.select("node", "was", F.least("label", F.coalesce("to", "label")).alias("label")))
        changed = new.filter("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """id_col, fp, component (the smallest id reachable over links) of every row.

    Null and blank texts have fingerprint zero and are linked like any other. A null id takes part but names no
    component unless no other id is there; repeated rows are copies. An empty table gives an empty result. Columns
    besides the two are ignored. Ties do not arise: components do not depend on the order of links.
    """
    held = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(held.groupBy("fp").agg(F.min("id").alias("least")))
    edges = cut(links(distinct.select("fp"), distance))
    labels = components(edges)
    linked = labels.join(distinct, labels["node"] == distinct["fp"]).select("fp", "label", "least")
    roots = linked.groupBy("label").agg(F.min("least").alias("component"))
    of = cut(look_up(cut(linked.select("fp", "label")), "label", roots, "label").select("fp", "component"))
    named = cut(distinct.join(broadcast_if_small(of), "fp", "left").select("fp", F.coalesce("component", "least").alias("component")))
    # blank texts and boilerplate share a fingerprint
    return look_up(held, "fp", named, "fp").select(F.col("id").alias(id_col), "fp", "component")


#: bits of the map of rows that may have to go: 8 MB, whatever the table
MAP_BITS = 1 << 26


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row per component: one with the component's smallest id; rows that repeat it go too.

    Among rows of one id that stand for a component the one with the smallest text hash stays. A component that has no
    id but null keeps one row. Blank texts, null ones too, are copies of each other, so one of them stays. All columns
    stay as they are, whatever their names; an empty table stays empty; a very long text travels no more than others.

    Whole rows stay where they are: a bitmap of fixed size, broadcast, marks the hashes of rows that go or repeat.
    Only rows that it marks, those and few others, meet the list of rows to keep by a shuffle.
    """
    mark = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("h"))
    found = cut(near_duplicates(docs.select(mark.alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text").select("id", (F.col("id") == F.col("component")).alias("stays")))
    rows = found.groupBy("id").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    spot = lambda x: F.pmod(F.xxhash64(x), F.lit(MAP_BITS)) + 1
    doubtful = rows.filter(~F.col("stays") | (F.col("n") > 1)).select(spot(F.col("id")).alias("spot"))
    bits = cut(doubtful.groupBy(F.bitmap_bucket_number("spot").alias("of_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")))  # MAP_BITS at most
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), mark.alias("mark"))
    at = F.bitmap_bit_position(spot(F.col("mark")))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    seen = marked.join(F.broadcast(bits), F.bitmap_bucket_number(spot(F.col("mark"))) == F.col("of_bucket"), "left")
    is_set = F.col("bits").isNotNull() & (F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1)
    # a column that is not deterministic keeps the join with the list above this, so that only marked rows are shuffled
    seen = seen.select("doc", "mark", (is_set & (F.spark_partition_id() >= 0)).alias("is_marked"))
    is_marked = F.col("is_marked")
    keep = rows.filter("stays").select(F.col("id").alias("kept"))
    some = seen.filter(is_marked).join(keep, F.col("mark") == F.col("kept"), "left_semi")
    one = some.groupBy("mark").agg(F.first("doc").alias("doc"))  # combined before the shuffle, however often a row repeats
    return seen.filter(~is_marked).select("doc.*").unionByName(one.select("doc.*"))
