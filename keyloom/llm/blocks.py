"""Documents in numbered blocks, and messages between blocks and buckets of keys.

A block is some megabytes of documents, compressed into one row and checkpointed, so that its number, its order and its
texts are fixed once whatever happens to the input's partitions. An operator that must compare what lies in different
blocks sends from each block one row per bucket of keys, answers in the bucket, and lets the answers meet the block
again: Spark shuffles, sorts, spills and retries the rows; keys, counts and positions inside a row are NumPy arrays.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import cut, map_batches

BLOCK_BYTES = 4_000_000
#: text whose keys go to one bucket, on average
TASK_BYTES = 10_000_000
MESSAGE = "to long, block long, body binary"
#: the `to` of a block's own texts: below every bucket
TEXTS = -1
#: the `block` of what a bucket says of itself
NOTE = -1


def pack(*parts: object) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, 5))


def unpack(body: bytes) -> tuple:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(body))


def planes(numbers: np.ndarray) -> tuple[int, bytes]:
    """Unsigned numbers as byte planes, as few as the greatest needs: where most are small, the high planes compress away."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return width, np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(held: tuple[int, bytes]) -> np.ndarray:
    width, raw = held
    low = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, :width] = low
    return out.view("<u8").ravel()


def steps(ascending: np.ndarray) -> tuple[int, bytes]:
    """Planes of the differences of ascending unsigned numbers."""
    return planes(np.diff(ascending.astype(np.uint64), prepend=np.uint64(0)))


def from_steps(held: tuple[int, bytes]) -> np.ndarray:
    return np.cumsum(from_planes(held), dtype=np.uint64)


def message_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    to, block, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(block, pa.int64()), pa.array(body, pa.binary())], names=["to", "block", "body"])


def make(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Checkpointed (to, block, body, n_bytes): the rows of (id, text, more), in blocks of about `block_bytes` of text.

    A body holds ids, texts (UTF-8; null as empty) and `more`, in the order in which the partition had them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([TEXTS]), pa.array([number]), pa.array([pack(*held)], pa.binary()), pa.array([size])], names=["to", "block", "body", "n_bytes"])

        for batch in textvec.slices(batches):
            for i, t, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = (t or "").encode("utf-8", "surrogatepass")
                if held[0] and size + len(text) > block_bytes:
                    yield done()
                    number, held, size = number + 1, ([], [], []), 0
                for column, value in zip(held, (i, text, m), strict=True):
                    column.append(value)
                size += len(text)
        if held[0]:
            yield done()

    return cut(map_batches(rows, work, f"{MESSAGE}, n_bytes long"))


def tasks(blocks: DataFrame, task_bytes: int = TASK_BYTES) -> tuple[int, int, int]:
    """How many buckets the keys of the blocks fall into, how many tasks share the blocks, and the bytes of all texts."""
    n, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(total) // task_bytes), max(least, n // 4), int(total)


def groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Runs of messages that agree in column `by`."""
    held: list[tuple[int, int, bytes]] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][by] != row[by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def send(blocks: DataFrame, say: Callable[[int, tuple], list[tuple[int, bytes]]]) -> DataFrame:
    """Messages of every block: `say(number, texts)` gives (bucket, body)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(to, number, out) for to, out in say(number, unpack(body))]
                if rows:
                    yield message_batch(rows)

    return map_batches(blocks.select("block", "body"), work, MESSAGE)


def in_buckets(messages: DataFrame, buckets: int, reply: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """Messages again: `reply` gets the bodies of one bucket, by block, and gives as many; a None is not sent.

    One body more than it got is a note of the bucket's own; its `block` is NOTE.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 0):
            made = reply([r[2] for r in rows])
            blocks = [r[1] for r in rows] + [NOTE] * (len(made) - len(rows))
            out = [(rows[0][0], block, body) for block, body in zip(blocks, made, strict=True) if body is not None]
            if out:
                yield message_batch(out)

    return map_batches(messages.repartition(buckets, "to").sortWithinPartitions("to", "block"), work, MESSAGE)


def at_blocks(blocks: DataFrame, answers: DataFrame, parts: int, use: Callable[[int, tuple, list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """Every block's texts with its answers: `use(number, texts, [(bucket, body)...])`, buckets ascending."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 1):
            if rows[0][0] == TEXTS:
                yield from use(rows[0][1], unpack(rows[0][2]), [(to, body) for to, _, body in rows[1:]])

    both = blocks.select("to", "block", "body").unionByName(answers)
    return map_batches(both.repartition(parts, "block").sortWithinPartitions("block", "to"), work, schema)
