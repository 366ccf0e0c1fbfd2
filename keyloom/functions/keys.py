"""Key functions as Column expressions: index keys, cells, layouts; and the maths of cell ranges on the driver.

Keys are binary. Their order is unsigned byte order, which is also the order of their lower-case hex strings.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hex_key(number: Column) -> Column:
    """A number as a 16-digit lower-case hex key; sorts as the number does."""
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def to_hex(key: Column) -> Column:
    return F.lower(F.hex(key))


def from_hex(text: Column) -> Column:
    """Bytes of a hex string; null where it is not one."""
    return F.try_to_binary(text, F.lit("hex"))


def must_be_hex(text: Column) -> Column:
    """Bytes of a hex string; an error where it is not one."""
    got = from_hex(text)
    return F.when(text.isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit("not a hex string: "), text))).otherwise(got)


def text_hex(text: Column) -> Column:
    """The UTF-8 bytes of a text in lower-case hex."""
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def bytes_hex(n: Column, byte: int) -> Column:
    """`n` times a byte, in hex."""
    return F.repeat(F.lit(f"{byte:02x}"), n)


def seeded_key(number: Column, seed: int, length: int = 16) -> Column:
    """A key of `length` bytes (32 at most), in hex, that number and seed determine; of other numbers, other keys."""
    return F.substring(F.sha2(F.concat_ws("/", F.lit(str(seed)), number.cast("string")), 256), 1, 2 * length)


def seeded_value(number: Column, seed: int, size: int) -> Column:
    """A value of `size` bytes that number and seed determine."""
    block = F.sha2(F.concat_ws("/", F.lit(f"value {seed}"), number.cast("string")), 256)
    return F.unhex(F.substring(F.repeat(block, (size + 31) // 32), 1, 2 * size))


def starting_u32(hex_text: Column) -> Column:
    """The first four bytes of a key, given in hex, as a number; short keys are padded with zeros."""
    return F.conv(F.rpad(F.substring(hex_text, 1, 8), 8, "0"), 16, 10).cast("bigint")


def uniform_cell(hex_text: Column, cells: int) -> Column:
    """The cell of a key among `cells` equal parts of the key range."""
    return F.shiftright(starting_u32(hex_text) * F.lit(cells), 32)


def prefix_cell(hex_text: Column, prefix_bytes: int, cluster_bits: int) -> Column:
    """The first `prefix_bytes` bytes, in hex, with the low `cluster_bits` bits of the last one cleared."""
    last = F.conv(F.substring(hex_text, 2 * prefix_bytes - 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(0xFF << cluster_bits & 0xFF))
    return F.concat(F.substring(hex_text, 1, 2 * prefix_bytes - 2), F.lower(F.lpad(F.hex(last), 2, "0")))


def prefix_bits(bits: int) -> tuple[int, int]:
    """(prefix bytes, cluster bits) of a prefix of so many bits."""
    return (bits + 7) // 8, (8 - bits % 8) % 8


def reduced(hex_text: Column, first: int, last: int) -> Column:
    """The index key: bytes first (counted from 0) to last (exclusive) of the key, in hex."""
    return F.substring(hex_text, 2 * first + 1, 2 * (last - first))


def hashed_sha(hex_text: Column) -> Column:
    """A 16-byte hash index key, in hex."""
    return F.substring(F.sha2(hex_text, 256), 1, 32)


def hashed_blake2b(hex_text: Column) -> Column:
    """The first 16 bytes of the 32-byte Blake2b digest of a key given in hex, in hex."""

    @F.pandas_udf(T.StringType())
    def digest(keys: pd.Series) -> pd.Series:
        return keys.map(lambda h: None if h is None else hashlib.blake2b(bytes.fromhex(h), digest_size=32).digest()[:16].hex())

    return digest(hex_text)


def uniform_cell_of(key: bytes, cells: int) -> int:
    return int.from_bytes(key[:4].ljust(4, b"\0"), "big") * cells >> 32


def uniform_cell_range(cell: int, cells: int, length: int) -> tuple[bytes, bytes]:
    """The first and the last key of `length` bytes in a cell."""
    first = -(-(cell << 32) // cells)
    last = -(-((cell + 1) << 32) // cells) - 1
    return first.to_bytes(4, "big") + bytes(length - 4), last.to_bytes(4, "big") + b"\xff" * (length - 4)


def sequence_then_choice(position: Column) -> Column:
    """A composite key: position div 256 (8 bytes), then position mod 256 (1 byte), in hex."""
    return F.concat(hex_key(F.floor(position / 256).cast("bigint")), F.lower(F.lpad(F.hex(position % 256), 2, "0")))


def choice_then_sequence(position: Column) -> Column:
    return F.concat(F.lower(F.lpad(F.hex(position % 256), 2, "0")), hex_key(F.floor(position / 256).cast("bigint")))


def zipf_rank(uniform: Column, n: int, exponent: float) -> Column:
    """A rank in 1..n by the inverse of the continuous Zipf distribution, from a uniform number in [0, 1)."""
    if exponent == 0:
        return F.floor(uniform * n).cast("bigint") + 1
    if exponent == 1:
        return F.least(F.lit(n), F.floor(F.exp(uniform * F.log(F.lit(float(n + 1))))).cast("bigint"))
    power = 1 - exponent
    return F.least(F.lit(n), F.floor(F.pow(1 + uniform * (float(n + 1) ** power - 1), F.lit(1 / power))).cast("bigint"))
