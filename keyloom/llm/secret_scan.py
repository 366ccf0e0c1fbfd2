"""Secret scans: one pass of an Aho-Corasick automaton finds keywords, and expressions run only where a keyword ends.

Every kind but runs of hexadecimal digits starts with a fixed keyword, so an expression anchored at the keyword's start
finds exactly what a scan of the whole text would. Runs of hexadecimal digits have no keyword; one expression scans for
them. Kinds with a checksum or an inner structure are kept only if it holds: the CRC-32 that ends a code host's or a
package registry's token, a web token's JSON header, the Luhn digit of a card number.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textvec
from .common import map_batches

# Alphabets and forms of public token formats.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: in the order in which kinds rank at equal starts
KINDS = ("assign", "access", "hex", "code_host", "registry", "chat", "cloud_key", "web_token", "private_key", "card")


def _crc_base62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _crc_token(found: re.Match) -> bool:
    return _crc_base62(found[1][:-6]) == found[1][-6:]


def _web_token(found: re.Match) -> bool:
    head = found[1]
    try:
        said = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(said, dict) and "alg" in said


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _card(found: re.Match) -> bool:
    return _luhn(re.sub(r"\D", "", found[1]))


def _always(found: re.Match) -> bool:
    return True


#: kind, keywords (lower case) that its matches start with, anchored expression, test of the match
RULES: tuple[tuple[str, tuple[str, ...], re.Pattern, Callable[[re.Match], bool]], ...] = (
    ("assign", ASSIGN_WORDS, re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    ("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20),
    ("code_host", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), _crc_token),
    ("registry", ("npm_",), re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), _crc_token),
    ("chat", ("xoxb-", "xoxp-", "xoxa-"), re.compile(r"xox[bpa]-[0-9]{10,13}-[0-9A-Za-z-]{10,72}"), _always),
    ("cloud_key", ("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), _always),
    ("web_token", ("eyj",), re.compile(r"(eyJ[0-9A-Za-z_-]{8,})\.(?:eyJ[0-9A-Za-z_-]+)\.[0-9A-Za-z_-]*"), _web_token),
    ("private_key", ("-----begin ",), re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"), _always),
    ("card", ("card:", "card ", "card="), re.compile(r"(?i:card)[:= ]+(\d(?:[ -]?\d){12,18})(?!\d)"), _card),
)
HEX = re.compile(r"[0-9a-f]{24,}")
_UPPER = {c: c + 32 for c in range(65, 91)}


def _automaton():  # noqa: ANN202
    import ahocorasick

    out = ahocorasick.Automaton()
    of: dict[str, list[int]] = {}
    for k, (_, keywords, _, _) in enumerate(RULES):
        for word in keywords:
            of.setdefault(word, []).append(k)
    for word, rules in of.items():
        out.add_word(word, (len(word), tuple(rules)))
    out.make_automaton()
    return out


def scan(text: str, automaton) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """(start, rank of the kind, end) of every secret, ordered; leftmost matches of a kind do not overlap."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer; keywords are ASCII
        low = text.translate(_UPPER)
    out: list[tuple[int, int, int]] = []
    hits: dict[int, list[int]] = {}
    for end, (n, rules) in automaton.iter(low):
        for k in rules:
            hits.setdefault(k, []).append(end - n + 1)
    for k, starts in hits.items():
        name, _, form, holds = RULES[k]
        free = 0
        for at in sorted(starts):
            if at >= free and (m := form.match(text, at)):
                free = m.end()
                if holds(m):
                    out.append((at, KINDS.index(name), free))
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and found, an array of (kind, start, end), of every row; positions are code points, ends exclusive.

    A null text is empty and has none. Null ids and repeated rows are rows like others, an empty table gives an empty
    result, other columns are ignored. Ties in start go by the order of KINDS. Each text is scanned whole, in one task.
    """
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = T.StructType([docs.schema[id_col], T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in textvec.slices(batches):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(x.as_py() or "", automaton)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(one))], names=[id_col, "found"])

    return map_batches(docs.select(id_col, text_col), work, schema)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every found span of the text replaced by `mask`; spans that overlap or touch are replaced together.

    Null texts stay null and empty ones empty; null ids and repeated rows are rows like others; other columns, whatever
    their names, stay as they are; an empty table stays empty. Each text is scanned whole, in one task.
    """
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in textvec.slices(batches, at):
            texts = [None if t is None else replace(t, [(a, b) for a, _, b in scan(t, automaton)], mask) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_batches(docs, work, docs.schema)


def replace(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """`text` with the spans, ordered by start, replaced."""
    out, at, end = [], 0, -1
    for a, b in spans:
        if a > end:  # neither within nor next to the last span
            out += [text[at:a], mask]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]
