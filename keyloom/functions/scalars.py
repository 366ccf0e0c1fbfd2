"""Small scalar functions of the console and the statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: Column) -> Column:
    """12 B, 1.50 KiB, 2.00 MiB, 3.00 GiB."""
    text = F.format_string("%d B", n)
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        text = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", n / float(1024**power))).otherwise(text)
    return text


def human_count(n: Column) -> Column:
    """12, 1.50 K, 2.00 M, 3.00 G."""
    text = F.format_string("%d", n)
    for power, unit in ((1, "K"), (2, "M"), (3, "G")):
        text = F.when(n >= 1000**power, F.format_string(f"%.2f {unit}", n / float(1000**power))).otherwise(text)
    return text


def percentile_rank(n: Column, percent: float) -> Column:
    """The 1-based rank of a percentile among n sorted values: min(n * p div 100, n - 1) + 1, for p of up to three decimals."""
    return F.least(F.floor(n * round(percent * 1000) / 100_000), n - 1) + 1


def bloom_bits(items: int, rate: float) -> int:
    """Bits of a bloom filter for so many items at a false-positive rate."""
    return math.ceil(-items * math.log(rate) / math.log(2) ** 2)


def share(part: Column, whole: Column) -> Column:
    """A percentage, rounded to two places."""
    return F.round(100.0 * part / whole, 2)
