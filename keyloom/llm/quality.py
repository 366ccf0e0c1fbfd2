"""Quality rules per document, and host verdicts: failure rates by host, shrunk with an empirical beta prior.

Document rules are counts inside one text, in SQL functions only. Host rules aggregate the documents' rule failures by
host (here: source) and fit a beta prior to the hosts' counts by moments: its mean is the rate of all documents, its
weight follows from how far hosts differ beyond chance. A host's rate is then the mean of its posterior: a small host is
pulled to the corpus rate, a large one keeps its own. A host is rejected when a rule fails there far more often than in
the corpus, beyond doubt: when even two standard deviations below that mean the rate is above FACTOR times the corpus
rate and above the rule's least rate. Verdicts are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, broadcast_if_small, cut, words

#: a host whose failure rate of the rule is certainly above this, and above FACTOR times the corpus rate, is rejected
HOST_LIMITS = {"base": 0.2, "symbols": 0.2, "lines": 0.2}
FACTOR = 2.0


def _covered(starts: Column) -> Column:
    """Positions within 5 of a start, from ascending window starts."""
    step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(5), x - acc["last"])).alias("n"), x.alias("last"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), step, lambda acc: acc["n"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row; a null text counts as none.

    Repeated 5-word windows are found by 64-bit hashes of their words within one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(host_col).alias("host"),
        words(F.col(text_col)).alias("ws"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.when(F.instr(text, "\n") > 0, lines).alias("ls"),
    )
    counted = base.select(
        "id", "host", "n_symbols",
        F.size("ws").alias("n"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.when(F.col("ls").isNull(), 0).otherwise(F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("ws") > 5, F.transform("ws", lambda w: F.xxhash64(w))).alias("hs"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("hs") - 4), lambda i: F.xxhash64(*(F.element_at("hs", i + j) for j in range(5))))
    hashed = counted.select("*", F.when(F.col("hs").isNotNull(), windows).alias("vs"))
    twice = hashed.select("*", F.when(F.size(F.array_distinct("vs")) < F.size("vs"), F.sort_array(F.transform("vs", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))).alias("s"))
    near = lambda e, j: (F.get("s", j - 1)["v"] == e["v"]) | (F.get("s", j + 1)["v"] == e["v"])
    found = twice.select("*", F.sort_array(F.transform(F.filter("s", lambda e, j: F.coalesce(near(e, j), F.get("s", j + 1)["v"] == e["v"], F.get("s", j - 1)["v"] == e["v"], F.lit(False))), lambda e: e["i"])).alias("starts"))
    return found.select("id", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(_covered(F.col("starts")), F.lit(0)).cast("long").alias("n_repeat_words"))


def host_rates(failures: DataFrame, rules: list[str]) -> DataFrame:
    """One row per host: n, and for each rule `rate_<rule>`, the posterior mean under a beta prior fitted to all hosts,
    `low_<rule>`, two standard deviations less, and `all_<rule>`, the rate of all documents.

    With m that rate, hosts' rates vary by m(1 - m)(r + (1 - r) / n): the share r of the variance that lies between
    hosts is what makes the weighted squares of their distances from m come out, and the prior weighs 1/r - 1 documents.
    Hosts that differ no more than chance share one rate: the prior then weighs as much as all documents.
    """
    hosts = cut(failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(r).cast("long")).alias(f"k_{r}") for r in rules)))
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2")]
    stats = hosts.agg(*sums, *(F.sum(f"k_{r}").alias(f"k_{r}") for r in rules), *(F.sum(F.col(f"k_{r}").cast("double") * F.col(f"k_{r}") / F.col("n")).alias(f"s_{r}") for r in rules)).first()
    out = hosts
    for r in rules:
        n = float(stats["n"] or 1)
        m = (stats[f"k_{r}"] or 0) / n
        between, spread = stats["hosts"] - 1.0, m * (1 - m)
        room = n - (stats["n2"] or 0) / n - between
        share = ((stats[f"s_{r}"] - n * m * m) / spread - between) / room if spread > 0 and room > 0 else 0.0
        weight = 1 / min(share, 0.5) - 1 if share > 1 / (n + 1) else n
        rate = (F.col(f"k_{r}") + F.lit(m * weight)) / (F.col("n") + F.lit(weight))
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"low_{r}", rate - 2 * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(weight + 1)))).withColumn(f"all_{r}", F.lit(m))
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: dict[str, float] = HOST_LIMITS, factor: float = FACTOR) -> DataFrame:
    """Document counts, base_failed, the host's shrunk rates, host_rejected and kept, one row per input row.

    A null host is a host of its own; a null text has no word and fails; null ids stay; repeated rows stay and count; a
    very long text is one row like others. An empty table gives an empty result. Columns besides the three are ignored, whatever their names.
    """
    counts = features(docs, id_col, text_col, host_col)
    rules = {
        "base": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars") * 3,
        "lines": 5 * F.col("n_dup_lines") > F.col("n_words"),
    }
    judged = cut(counts.select("*", *(c.alias(f"fails_{r}") for r, c in rules.items())))
    hosts = host_rates(judged.select("host", *(F.col(f"fails_{r}").alias(r) for r in rules)), list(rules))
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | ((F.col(f"low_{r}") > limits[r]) & (F.col(f"low_{r}") > factor * F.col(f"all_{r}")))
    verdicts = hosts.select(F.col("host").alias("of_host"), *(f"rate_{r}" for r in rules), rejected.alias("host_rejected"))
    joined = judged.join(broadcast_if_small(verdicts), F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    out = joined.select(F.col("id").alias(id_col), F.col("host").alias(host_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("fails_base").alias("base_failed"), *(f"rate_{r}" for r in rules), "host_rejected")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
