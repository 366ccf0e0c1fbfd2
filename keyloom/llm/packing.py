"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces of more than C/(k+1) and at most C/k tokens, and a
bin of class k takes exactly k pieces, whatever their order. A bin therefore needs no look at other bins: every worker
fills its own, with no shuffle and at most one open bin (under C tokens) per class.

Documents may be cut. A document first gives whole sequences; the rest stays one piece if its class wastes at most
`waste` of the bin, else a piece of exactly C/(k+1) is cut off, which class k+1 holds without loss, and the remainder is
treated alike. At the end of a partition the pieces of the open bins are laid end to end and cut at C; the last, short
stretch becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textvec
from .common import map_batches

SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def _classes() -> np.ndarray:
    """Of code points below U+0250: 0 blank, 1 letter, 2 number, 3 other, 4 not to be cut beside; others count as 4."""
    import unicodedata

    out = np.full(0x251, 4, dtype=np.uint8)
    for c in range(0x21, 0x250):
        kind = unicodedata.category(chr(c))
        out[c] = {"L": 1, "N": 2}.get(kind[0], 3) if kind not in ("Cc", "Zs") else 4
    for c in range(0x250):
        if len(chr(c).lower()) > 1:  # its small form ends in a mark, which the tokenizer may join to what follows
            out[c] = 4
    for c in " \t\n\r":
        out[ord(c)] = 0
    return out


def _lower() -> np.ndarray:
    out = np.arange(0x250, dtype=np.uint32)
    for c in range(0x250):
        if len(low := chr(c).lower()) == 1 and ord(low) < 0x250:
            out[c] = ord(low)
    return out


class Encoder:
    """Token ids of many texts; each distinct stretch of letters or of other characters meets the tokenizer once.

    The tokenizer's own splitting never joins letters with numbers, with blanks or (but for apostrophes) with other
    characters, so such stretches encode alike anywhere. Texts that are not in normal form C, or that hold a special
    token's string, go to the tokenizer whole.
    """

    def __init__(self, path: str | None) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.table = textvec.HashTable(21)
        self.classes, self.lower = _classes(), _lower()
        self._empty()

    def _empty(self) -> None:
        self.flat, self.used = np.empty(1 << 20, dtype=np.uint32), 0
        self.first, self.length = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        import unicodedata

        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        plain = []
        for i, text in enumerate(texts):
            if any(s in text for s in SPECIAL) or not unicodedata.is_normalized("NFC", text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                plain.append(i)
        mine = [texts[i] for i in plain]
        for a, b in textvec.blocks(mine):
            for i, ids in zip(plain[a:b], self._block(mine[a:b]), strict=True):
                out[i] = ids
        return out

    def _units(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased code points, and where each stretch starts and ends."""
        small = np.minimum(cps, 0x250)
        kind = self.classes[small]
        low = np.where(cps < 0x250, self.lower[np.minimum(cps, 0x24F)], cps)
        blank = kind == 0
        before, after = kind[:-1], kind[1:]
        mark = cps == 0x27
        parts = (before < 4) & (after < 4) & ((before != after) | (after == 2)) & ~mark[:-1] & ~mark[1:]
        edge = np.ones(len(cps) + 1, dtype=bool)
        edge[1:-1] = parts | blank[:-1] | blank[1:]
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        full = ~blank[starts]
        return low, starts[full], ends[full]

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        cps, doc_starts = textvec.code_points(texts)
        low, starts, ends = self._units(cps)
        keys = textvec.span_hashes(low, starts, ends)
        number = self.table.find(keys)
        if (number < 0).any():
            new, at = np.unique(keys[number < 0], return_index=True)
            if self.table.n + len(new) > self.table.room:  # start anew rather than grow without end
                self.table = textvec.HashTable(21 if len(keys) < (1 << 20) else int(2 * len(keys)).bit_length())
                self._empty()
                new, at = np.unique(keys, return_index=True)
                where = at
            else:
                where = np.flatnonzero(number < 0)[at]
            whole = " ".join(texts) + " "
            self._learn(new, [whole[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            number = self.table.find(keys)
        lengths = self.length[number].astype(np.int64)
        before = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=before[1:])
        ids = self.flat[np.repeat(self.first[number] - before[:-1], lengths) + np.arange(before[-1])]
        edges = before[np.searchsorted(starts, doc_starts)]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        self.table.add(keys)
        counts = np.empty(len(units), dtype=np.int32)
        got = []
        for a in range(0, len(units), 4096):
            some = units[a : a + 4096]
            begins = np.zeros(len(some) + 1, dtype=np.int64)
            np.cumsum([len(u) + 1 for u in some], out=begins[1:])
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            of = np.searchsorted(begins, np.array([o[0] for o in e.offsets], dtype=np.int64), side="right") - 1
            counts[a : a + len(some)] = np.bincount(of, minlength=len(some))[: len(some)]
            got.append(np.array(e.ids, dtype=np.uint32))
        ids = np.concatenate(got)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), dtype=np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(counts, dtype=np.int64) - counts
        self.first, self.length = np.concatenate([self.first, first]), np.concatenate([self.length, counts])
        self.used += len(ids)


def cuts(n: int, capacity: int, waste: float) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if capacity - k * n <= waste * capacity:
            out.append(n)
            break
        out.append(capacity // (k + 1))
        n -= out[-1]
    return out


class Packer:
    """The bins of one worker. A piece is (doc_id, start, ids, tokens of the document)."""

    def __init__(self, capacity: int, waste: float, first_sequence: int) -> None:
        self.capacity, self.waste, self.sequence = capacity, waste, first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        start = 0
        for n in cuts(len(ids), self.capacity, self.waste):
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, start, ids[start : start + n].copy(), len(ids)))
            start += n
            if len(bin_) == k:
                self._close(self.open.pop(k))

    def finish(self) -> None:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in rest)
        sizes = [self.capacity] * (total // self.capacity)
        total %= self.capacity
        sizes += [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        rest.reverse()
        for size in sizes:
            held = []
            while size:
                doc_id, start, ids, tokens = rest.pop()
                if len(ids) > size:
                    rest.append((doc_id, start + size, ids[size:], tokens))
                    ids = ids[:size]
                held.append((doc_id, start, ids, tokens))
                size -= len(ids)
            self._close(held)


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 2, waste: float = 1 / 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, packed: id_col, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens,
    sequence_id, offset.

    `tokenizer` is a tokenizers JSON file that every worker can read; None means the public word_bpe_49k.json. A null
    text is an empty one: its document is the single id `end_id`. A null id stays null, and repeated rows are packed
    once each. An empty table gives no piece. Other columns are ignored, whatever their names. Order within a partition
    of the input decides the bins, so reruns over the same files agree; sequence ids differ between partitions. Pieces
    of one length have no order but that. A very long text gives whole sequences and a rest, and is encoded in one task.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = None, Packer(capacity, waste, TaskContext.get().partitionId() << 33)
        arrow = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True))
            packer.rows = []
            kinds = (arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        for batch in textvec.slices(batches):
            arrow = batch.column(0).type
            encoder = encoder or Encoder(tokenizer)
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in textvec.blocks(texts):
                for doc_id, tokens in zip(ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    packer.add(doc_id, np.append(tokens, np.uint32(end_id)))
                if packer.rows:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return map_batches(docs.select(id_col, text_col), work, schema)
