"""Cross-entropy difference: how much more a text is like a target corpus than like the whole corpus, per token.

Bigram models of matched size share their vocabulary, smoothing and order; they differ only in the documents that they
count. The target model counts the marked ones. The background counts all, in as many folds by the hash of the id as
give each fold the target's size (FOLDS at most; what still differs is made up by scaling counts): a fold is a model
like the target's, and the background's loss is the mean of theirs. One model of everything would know more bigrams than
the target can, whatever the text. A text's score is the mean over its tokens of the background's loss less the target's.

No text is scored by counts of itself: its own words and bigrams are taken off first (leave one out), in every model that
has counted it. A word or bigram that no other text has is then unknown.

Every word and bigram of the corpus counts; there is no list of frequent ones. Blocks of documents send the keys and
counts of what they hold to buckets by key, one row per block and bucket. A bucket adds up the counts of each key and
answers each block with the totals of its keys. The answers meet the blocks' texts again, where the losses are summed.
A key occurs once per block, however frequent it is, so no bucket gets more of one key than there are blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks as B
from . import textvec
from .common import map_batches

#: tokens that the unigram estimate counts as beside those that followed a word
PRIOR = 100.0
#: what every word of the vocabulary counts as beside its occurrences
ALPHA = 0.05
#: most folds of the background
FOLDS = 8


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of its text; words are runs without ASCII white space, lower-cased."""
    cps, doc_starts = textvec.code_points([t.lower() for t in texts])
    blank = (cps == 32) | ((cps >= 9) & (cps <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return textvec.span_hashes(cps, starts, ends), np.searchsorted(doc_starts, starts, side="right") - 1


class Keys:
    """Words and bigrams of a block: distinct keys, ascending, and the number of each token's word and of its bigram."""

    def __init__(self, texts: list[bytes], bits: int = 64) -> None:
        hashes, self.doc = tokens([t.decode("utf-8", "surrogatepass") for t in texts])
        words, self.word = np.unique(hashes, return_inverse=True)
        self.second = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1  # tokens that have one before them
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        pairs = (mixed[self.second - 1] * np.uint64(0xD6E8FEB86659FD93) ^ hashes[self.second]) * np.uint64(0xBF58476D1CE4E5B9)
        pairs ^= pairs >> np.uint64(32)
        pairs, self.pair = np.unique(pairs, return_inverse=True)
        self.n_words = len(words)
        keys = np.concatenate([words, pairs])
        keys >>= np.uint64(64 - bits)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.place = np.empty(len(keys), dtype=np.int64)
        self.place[order] = np.arange(len(keys))

    def counted(self, weight: np.ndarray) -> np.ndarray:
        """Of every key, in order, how often the documents of weight 1 have it."""
        single = np.bincount(self.word, weights=weight[self.doc], minlength=self.n_words)
        double = np.bincount(self.pair, weights=weight[self.doc[self.second]], minlength=len(self.keys) - self.n_words)
        out = np.empty(len(self.keys), dtype=np.int64)
        out[self.place] = np.concatenate([single, double]).astype(np.int64)
        return out


def _own(number: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of every token how often its own text has its number."""
    if not len(number):
        return number
    _, which, n = np.unique(doc * (int(number.max()) + 1) + number, return_inverse=True, return_counts=True)
    return n[which]


def models(ids: list, how: list[int], folds: int) -> np.ndarray:
    """A row per model, the folds and then the target: which texts it counts (0 or 1)."""
    counted = np.array(how, dtype=np.int64)
    fold = np.array([zlib.crc32(str(i).encode()) % folds for i in ids], dtype=np.int64)
    return np.stack([*((counted & 1) * (fold == f) for f in range(folds)), counted >> 1])


def _by_bucket(keys: np.ndarray, shift: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of ascending keys the buckets that their first bits name, and where each bucket that occurs begins and ends."""
    bucket = (keys >> np.uint64(shift)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, dtype=np.int64)
    return bucket, list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _say_words(key_bits: int, bits: int, folds: int):  # noqa: ANN202
    """The keys of a block's words, of texts that count; and how many tokens each model counts, with one of the buckets."""

    def say(number: int, texts: tuple) -> list[tuple[int, bytes]]:
        ids, raw, how = texts
        hashes, doc = tokens([t.decode("utf-8", "surrogatepass") for t in raw])
        takes = models(ids, how, folds)
        keys = np.unique(hashes[takes.any(axis=0)[doc]]) >> np.uint64(64 - key_bits)
        sums = takes @ np.bincount(doc, minlength=len(ids))
        bucket, edges = _by_bucket(keys, key_bits - bits)
        return [(int(bucket[a]), B.pack(B.steps(keys[a:b]), sums if a == 0 else sums * 0)) for a, b in edges]

    return say


def _count_words(bodies: list[bytes]) -> list[bytes | None]:
    held = [B.unpack(body) for body in bodies]
    size = len(np.unique(np.concatenate([B.from_steps(h[0]) for h in held])))
    return [*[None] * len(held), B.pack(size, *sum(h[1] for h in held).tolist())]


def _say(key_bits: int, bits: int, folds: int):  # noqa: ANN202
    """(bucket, keys and counts) of a block. A key met once in it has one number: its fold, and whether it is marked."""

    def say(number: int, texts: tuple) -> list[tuple[int, bytes]]:
        ids, raw, how = texts
        held = Keys(raw, key_bits)
        bucket, edges = _by_bucket(held.keys, key_bits - bits)
        counts = np.stack([held.counted(w) for w in models(ids, how, folds)])
        every = counts[:-1].sum(axis=0)
        once = (every <= 1) & (counts[-1] <= every)
        code = np.where(every == 1, 1 + 2 * counts[:-1].argmax(axis=0) + counts[-1], 0)
        code[~once] = 2 * folds + 1
        out = []
        for a, b in edges:
            more = counts[:, a:b][:, ~once[a:b]]
            out.append((int(bucket[a]), B.pack(B.steps(held.keys[a:b]), code[a:b].astype(np.uint8), [B.planes(n) for n in more])))
        return out

    return say


def _counts(code: np.ndarray, more: list[tuple[int, bytes]]) -> np.ndarray:
    """What `_say` packed: a row of counts per model."""
    folds = len(more) - 1
    out = np.zeros((len(more), len(code)), dtype=np.int64)
    single = np.flatnonzero((code > 0) & (code <= 2 * folds))
    out[(code[single].astype(np.int64) - 1) >> 1, single] = 1
    out[-1, single] = (code[single] - 1) & 1
    rest = np.flatnonzero(code > 2 * folds)
    for row, held in zip(out, more, strict=True):
        row[rest] = B.from_planes(held)
    return out


def _add_up(bodies: list[bytes]) -> list[bytes]:
    """For every block, which of its keys other blocks have too, and their totals; the totals of the rest are its own."""
    held = [B.unpack(body) for body in bodies]
    keys = [B.from_steps(h[0]) for h in held]
    edges = np.cumsum([0, *map(len, keys)])
    counts = np.empty((len(held[0][2]), edges[-1]), dtype=np.int64)
    for h, a, b in zip(held, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        counts[:, a:b] = _counts(h[1], h[2])
    whole = np.concatenate(keys)
    order = np.argsort(whole, kind="stable")  # each block's keys ascend
    k = whole[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    times = np.diff(np.append(begin, len(k)))
    shared = np.empty(len(k), dtype=bool)
    shared[order] = np.repeat(times > 1, times)
    for row in counts:
        row[order] = np.repeat(np.add.reduceat(row[order], begin), times)
    return [B.pack(b - a, np.packbits(shared[a:b]), [B.planes(row[a:b][shared[a:b]]) for row in counts]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _totals(own: np.ndarray, replies: list[tuple]) -> np.ndarray:
    """Totals of a block's keys by model: what the replies say, and for keys that no other block has its own counts."""
    out, at = own.copy(), 0
    for n, bits, rows in replies:
        where = at + np.flatnonzero(np.unpackbits(bits, count=n))
        for row, held in zip(out, rows, strict=True):
            row[where] = B.from_planes(held)
        at += n
    return out


def losses(held: Keys, takes: np.ndarray, totals: list[np.ndarray], size: int, sums: list[int]) -> np.ndarray:
    """Summed losses of every text under background and target.

    A row of `takes` says which texts a model counts; its `totals` are of held.keys, its sum is of all words' totals;
    the target comes last. `size` is the number of different words.
    """
    n_texts = takes.shape[1]
    n_tokens = np.bincount(held.doc, minlength=n_texts)
    own_word, own_pair = _own(held.word, held.doc), _own(held.pair, held.doc[held.second])
    word, pair, at = held.place[held.word], held.place[held.n_words + held.pair], held.second
    out = np.zeros((n_texts, len(takes)))
    for m, (mine, total, whole) in enumerate(zip(takes, totals, sums, strict=True)):
        scale = sums[-1] / whole if whole and sums[-1] else 1.0
        count = (total[word] - own_word * mine[held.doc]) * scale
        p = (count + ALPHA) / ((whole - n_tokens * mine)[held.doc] * scale + ALPHA * (size + 1))
        p[at] = ((total[pair] - own_pair * mine[held.doc[at]]) * scale + PRIOR * p[at]) / (count[at - 1] + PRIOR)
        out[:, m] = np.bincount(held.doc, weights=-np.log(p), minlength=n_texts)
    used = [m for m in range(len(takes) - 1) if sums[m]] or [0]
    return np.stack([out[:, used].mean(axis=1), out[:, -1]], axis=1)


def score(docs: DataFrame, marked: Column, counted: Column | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """id_col, n_tokens, loss_background, loss_target (means, in nats) and score, their difference, of every row.

    Rows where `counted` (default: all) is true make up the background, those of them where `marked` is true the target;
    the others are scored only. A null counts as false. A null text, or one without a word, has 0 tokens, losses and
    score 0. With no marked row the target model is uniform, and the background is one model. Null ids and repeated rows are rows like others; a repeated
    row is another text, so the one makes the other's words known. A text longer than `block_bytes` is a block of its
    own. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    true = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    takes = true(F.lit(True) if counted is None else counted)
    blocks = B.make(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (takes + 2 * takes * true(marked)).alias("more")), block_bytes)
    bytes_ = F.octet_length(F.col(text_col))
    folds, = docs.agg(F.sum(F.when(true(marked) * takes == 1, bytes_)) / F.sum(F.when(takes == 1, bytes_))).first()
    folds = int(min(FOLDS, max(1, round(1 / folds)))) if folds else 1
    n, at, total = B.tasks(blocks)
    bits = (n - 1).bit_length()
    # of n keys, about one in 16 bytes, less than one pair is expected to meet at 2 * log2(n) bits
    key_bits = min(64, max(40, bits + 8, 2 * (total // 16).bit_length()))
    names = ["size", *(f"sum_{m}" for m in range(folds + 1))]

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [B.unpack(body) for body in batch.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    words = B.in_buckets(B.send(blocks, _say_words(key_bits, bits, folds)), n, _count_words)
    notes = map_batches(words.select("body"), stats, ", ".join(f"{c} long" for c in names))
    size, *sums = (x or 0 for x in notes.agg(*(F.sum(c) for c in names)).first())
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("loss_background", "loss_target", "score"))])

    def use(number: int, texts: tuple, got: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        ids, raw, how = texts
        held = Keys(raw, key_bits)
        takes = models(ids, how, folds)
        totals = _totals(np.stack([held.counted(w) for w in takes]), [B.unpack(body) for _, body in got])
        summed = losses(held, takes, totals, size, sums)
        n_tokens = np.bincount(held.doc, minlength=len(ids))
        mean = summed / np.maximum(n_tokens, 1)[:, None]
        columns = [pa.array(ids, to_arrow_type(kind)), pa.array(n_tokens), pa.array(mean[:, 0].copy()), pa.array(mean[:, 1].copy()), pa.array(mean[:, 0] - mean[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    answers = B.in_buckets(B.send(blocks, _say(key_bits, bits, folds)), n, _add_up)
    return B.at_blocks(blocks, answers, at, use, schema)
