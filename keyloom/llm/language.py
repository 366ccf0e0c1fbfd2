"""Language of texts and of the spans inside them.

A word is a run of letters. Its script (by code point range) narrows the languages that it may belong to; for those,
its score is the log probability of its letter trigrams, word edges included, under each language's trigram model. A
Viterbi pass over a text's word scores, with a penalty for each switch of language, labels every word; runs of a label
are spans, and the text's language is the one with most letters.

Models are trained here, on labelled rows: a hash sample of about `most` rows per language, a documented bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import map_batches

MOST_ROWS = 2000  # about so many training rows per language
SLOTS = 1 << 16  # hashed trigrams
PENALTY = 12.0  # log probability that a switch of language must win back
OUTSIDE = -40.0  # score of a word in a language that does not use its script
GROUP_CHARS = 4_000_000
UNKNOWN = "und"
#: First code points of ranges of scripts; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS], dtype=np.uint32)
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


@dataclass
class Model:
    """languages, trigram log probabilities (slot x language), and which languages use a script (script x language)."""

    languages: list[str]
    scores: np.ndarray
    uses: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, and its small form where that is one code point."""
    alpha = np.zeros(0x110000, dtype=bool)
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            alpha[c] = True
            if len(t := s.lower()) == 1:
                low[c] = ord(t)
    return alpha, low


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram slot of each letter; of each word the first letter's index, start, end and script; where texts start."""
    alpha, low = _letters()
    cps, doc_starts = textvec.code_points(texts)
    is_letter = alpha[cps]
    at = np.flatnonzero(is_letter)
    if not len(at):
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, none, doc_starts
    c = low[cps[at]].astype(np.uint64)
    first = np.ones(len(at), dtype=bool)
    first[1:] = at[1:] != at[:-1] + 1
    last = np.ones(len(at), dtype=bool)
    last[:-1] = first[1:]
    before, after = np.ones(len(at), dtype=np.uint64), np.full(len(at), 2, dtype=np.uint64)
    before[1:][~first[1:]] = c[:-1][~first[1:]]
    after[:-1][~last[:-1]] = c[1:][~last[:-1]]
    h = before * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    slots = (h >> np.uint64(48)).astype(np.int64)
    begins, ends = np.flatnonzero(first), at[last] + 1
    starts = at[begins]
    script = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, cps[starts], side="right") - 1]
    return slots, begins, starts, ends, script, doc_starts


def train(labelled: DataFrame, lang: Column, text: Column, pick: Column, most: int = MOST_ROWS) -> Model:
    """A model of the non-null languages in `labelled`, from a hash sample of about `most` rows each.

    `pick` is a column of well-spread integers in [0, 2**32). Languages are known by their labels, of which there are
    few; their counts and at most SLOTS trigram counts per language come to the driver. Null labels, texts and picks
    teach nothing; empty texts have no word; repeated rows are picked or left together and then all count; a very long
    text counts whole; an empty table gives a model without languages. Languages are in code point order.
    """
    rows = labelled.select(lang.alias("lang"), text.alias("text"), pick.alias("pick")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((SLOTS, 0), dtype=np.float32), np.zeros((len(SCRIPT_NAMES), 0), dtype=bool))
    bound = F.lit(0)
    for name in languages:
        bound = F.when(F.col("lang") == name, int(min(1.0, most / counts[name]) * 2**32)).otherwise(bound)
    sample = rows.filter(F.col("pick") < bound).select("lang", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((len(languages), SLOTS + len(SCRIPT_NAMES)), dtype=np.int64)
        for batch in textvec.slices(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, name in enumerate(languages):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == name]
                for a, b in textvec.blocks(mine, 1_000_000):
                    slots, begins, _, _, script, _ = words_of(mine[a:b])
                    got[k, :SLOTS] += np.bincount(slots, minlength=SLOTS)
                    got[k, SLOTS:] += np.bincount(script, minlength=len(SCRIPT_NAMES))
        for k in range(len(languages)):
            cell = np.flatnonzero(got[k])
            if len(cell):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k)), pa.array(cell), pa.array(got[k][cell])], names=["k", "cell", "n"])

    sums = map_batches(sample, work, "k long, cell long, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), SLOTS + len(SCRIPT_NAMES)))
    table[sums["k"].to_numpy(dtype=np.int64), sums["cell"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy()
    grams, scripts = table[:, :SLOTS], table[:, SLOTS:]
    scores = np.log((grams + 0.1) / (grams.sum(axis=1, keepdims=True) + 0.1 * SLOTS))
    uses = scripts >= 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, np.ascontiguousarray(scores.T, dtype=np.float32), np.ascontiguousarray(uses.T))


def word_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score (word x language), start, end and text number of every word; positions count within the word's text."""
    slots, begins, starts, ends, script, doc_starts = words_of(texts)
    doc = np.searchsorted(doc_starts, starts, side="right") - 1
    if not len(begins):
        return np.zeros((0, len(model.languages)), dtype=np.float32), starts, ends, doc
    scores = np.add.reduceat(model.scores[slots], begins, axis=0)
    uses = model.uses[script]
    scores = np.where(uses, scores, scores + OUTSIDE)
    scores[~uses.any(axis=1)] = 0  # a script that no language uses says nothing
    return scores, starts - doc_starts[doc], ends - doc_starts[doc], doc


def viterbi(scores: np.ndarray, firsts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, for texts whose words are scores[firsts[i]:firsts[i + 1]]; all texts step together."""
    n_words = np.diff(firsts)
    order = np.argsort(-n_words, kind="stable")
    begin, length = firsts[:-1][order], n_words[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # texts with more than t words
    value = np.zeros((len(order), scores.shape[1]), dtype=np.float64)
    stay = np.empty(scores.shape, dtype=bool)
    came = np.empty(len(scores), dtype=np.int16)
    for t in range(longest):
        k = active[t]
        at, v = begin[:k] + t, value[:k]
        best = v.argmax(axis=1)
        floor = (v[np.arange(k), best] - penalty)[:, None]
        held = v >= floor
        stay[at], came[at] = held, best
        value[:k] = np.where(held, v, floor) + scores[at]
    label = np.empty(len(scores), dtype=np.int16)
    now = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        label[at] = now[:k]
        now[:k] = np.where(stay[at, now[:k]], now[:k], came[at])
    return label


def label_texts(model: Model, texts: list[str], penalty: float = PENALTY) -> tuple[list[str], np.ndarray, pa.Array]:
    """Of each text its language, the share of its letters in that language, and its spans (lang, start, end)."""
    n_langs = len(model.languages)
    parts = []
    for a, b in textvec.blocks(texts, 1_000_000):
        scores, starts, ends, doc = word_scores(model, texts[a:b])
        parts.append((scores, starts, ends, doc + a))
    scores, starts, ends, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    firsts = np.searchsorted(doc, np.arange(len(texts) + 1))
    label = viterbi(scores, firsts, penalty).astype(np.int64) if n_langs else np.zeros(len(scores), dtype=np.int64)
    says = scores.any(axis=1) if n_langs else np.zeros(len(scores), dtype=bool)
    letters = (ends - starts).astype(np.float64)
    shares = np.bincount(doc * max(n_langs, 1) + label, weights=letters * says, minlength=len(texts) * max(n_langs, 1)).reshape(len(texts), -1)
    total = np.bincount(doc, weights=letters, minlength=len(texts))
    best = shares.argmax(axis=1)
    score = np.divide(shares[np.arange(len(texts)), best], total, out=np.zeros(len(texts)), where=total > 0)
    known = (total > 0) & (n_langs > 0)
    langs = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
    last = np.ones(len(doc), dtype=bool)
    last[:-1] = new[1:]
    names = pa.array(model.languages or [UNKNOWN], pa.string()).take(pa.array(label[new]))
    spans = pa.StructArray.from_arrays([names, pa.array(starts[new].astype(np.int64)), pa.array(ends[last].astype(np.int64))], names=["lang", "start", "end"])
    offsets = np.searchsorted(doc[new], np.arange(len(texts) + 1)).astype(np.int32)
    return langs, score, pa.ListArray.from_arrays(pa.array(offsets), spans)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """id_col, lang_pred, score (0 to 1) and spans (lang, start, end in code points) of every row.

    A null text, or one with no letter, is `und` with score 0 and no span; so is every text if no language was learned.
    Words in scripts that no language uses carry no score. Ties go to the language first in code point order. Null ids
    and repeated rows are rows like others, an empty table gives an empty result, other columns are ignored.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.slices(batches, 1, GROUP_CHARS):
            langs, score, spans = label_texts(model, [t or "" for t in batch.column(1).to_pylist()], penalty)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), spans], names=schema.names)

    return map_batches(docs.select(id_col, text_col), work, schema)


def remainder(id_col: Column, of: int = 5) -> Column:
    return F.crc32(id_col.cast("string")) % of


def train_outside_fold(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model learned from rows whose crc32(id as text) mod 5 is not 0; rows with a null id teach nothing."""
    learned = docs.filter(remainder(F.col(id_col)) != 0)
    return train(learned, F.col(lang_col), F.col(text_col), F.crc32(F.concat(F.lit("pick "), F.col(id_col).cast("string"))))


def with_language(docs: DataFrame, model: Model, lang_name: str, score_name: str, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """`docs` with two more columns: the language of the text and its share of the letters, as `identify` gives them.

    Null and empty texts, and those without a letter, are UNKNOWN with share 0. Ties go to the language that is first by
    code point. Repeated rows are labelled alike; a very long text is labelled whole, in one task, word after word; an
    empty table stays empty. The two names must be new; other columns, whatever their names, stay as they are.
    """
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.slices(batches, at, GROUP_CHARS):
            langs, score, _ = label_texts(model, [t or "" for t in batch.column(at).to_pylist()], penalty)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], names=schema.names)

    return map_batches(docs, work, schema)
