"""The registered queries of this package: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licenses, mixing, neighbours, packing, quality, repeats, scoring, secret_scan, simhash
from .common import broadcast_if_small, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train_outside_fold(docs))
    return found.select("doc_id", F.coalesce(language.remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id").distinct().withColumn("good", F.lit(True))
    marked = docs.select("doc_id", "text").join(broadcast_if_small(good, 1_000_000), "doc_id", "left")
    return scoring.score(marked, F.col("good"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_language": op3_language,
    "op4_repeats": op4_repeats,
    "op5_licenses": op5_licenses,
    "op6_packing": op6_packing,
    "op7_scoring": op7_scoring,
    "op8_simhash": op8_simhash,
    "op9_neighbours": op9_neighbours,
    "op10_quality": op10_quality,
}

_WS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_MIXING = f"""
WITH s AS (SELECT doc_id, source, len({_WS})::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size::DOUBLE * {mixing.MOST_EPOCHS} AS cap FROM g),
w AS (SELECT *, {list(mixing.WEIGHTS)}[(rank - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS w FROM r),
l AS (SELECT *, ((SELECT sum(source_size) FROM g)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / w, rank) AS nth FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, nth) FROM l WHERE level * w <= cap) * w) AS target FROM l),
b AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes FROM t),
d AS (SELECT s.doc_id, s.size, b.source_size, b.target, passes, budget - passes * b.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(concat_ws('|', 'mix', s.doc_id::VARCHAR, size::VARCHAR)), s.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM d"""

_NORMAL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_TEMPLATES = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in licenses.TEMPLATES.items())

_LICENSES = f"""
WITH t AS (SELECT name, {_NORMAL} AS ws FROM (VALUES {_TEMPLATES}) v(name, text)),
tl AS (SELECT name, ws, least(len(ws), 5) AS l FROM t),
tg AS (SELECT DISTINCT name, l, array_to_string(ws[i:i + l - 1], ' ') AS g FROM tl, range(1, len(ws) - l + 2) r(i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_NORMAL} AS ws FROM documents),
dg AS (SELECT rid, doc_id, l, array_to_string(ws[i:i + l - 1], ' ') AS g, min(i) AS place FROM d, (SELECT DISTINCT l FROM tl) ls, range(1, len(ws) - l + 2) r(i) GROUP BY 1, 2, 3, 4),
n AS (SELECT name, count(*) AS n FROM tg GROUP BY 1)
SELECT doc_id, name AS template, count(*)::DOUBLE / n AS containment, min(place)::BIGINT AS first_word, (max(place) + l - 1)::BIGINT AS last_word
FROM dg JOIN tg USING (l, g) JOIN n USING (name) GROUP BY rid, doc_id, name, l, n HAVING count(*) >= {licenses.LEAST} * n"""

_RULES = {"base": "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)", "symbols": "(10 * n_symbols > word_chars * 3)", "lines": "(5 * n_dup_lines > n_words)"}
_LOW = "(rate_{0} - 2 * sqrt(rate_{0} * (1 - rate_{0}) / (n + c_{0} + 1)))"

_QUALITY = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {_WS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
p AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, range(1, len(ws) - 3) r(i)),
g AS (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM p),
q AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM g WHERE n > 1),
rep AS (SELECT rid, sum(least(5, i - coalesce(prev, i - 5)))::BIGINT AS n FROM q GROUP BY rid),
f AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
h AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"count(*) FILTER ({rule})::DOUBLE AS k_{r}" for r, rule in _RULES.items())} FROM f GROUP BY 1),
m AS (SELECT sum(n) AS nn, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room, count(*) - 1 AS between_, {", ".join(f"sum(k_{r}) / sum(n) AS m_{r}, sum(k_{r} * k_{r} / n) AS s_{r}" for r in _RULES)} FROM h),
i AS (SELECT *, {", ".join(f"CASE WHEN m_{r} > 0 AND m_{r} < 1 AND room > 0 THEN ((s_{r} - nn * m_{r} * m_{r}) / (m_{r} * (1 - m_{r})) - between_) / room ELSE 0 END AS i_{r}" for r in _RULES)} FROM m),
c AS (SELECT *, {", ".join(f"CASE WHEN i_{r} > 1 / (nn + 1) THEN 1 / least(i_{r}, 0.5) - 1 ELSE nn END AS c_{r}" for r in _RULES)} FROM i),
p2 AS (SELECT *, {", ".join(f"(k_{r} + m_{r} * c_{r}) / (n + c_{r}) AS rate_{r}" for r in _RULES)} FROM h, c),
v AS (SELECT source, {" OR ".join(f"({_LOW.format(r)} > {quality.HOST_LIMITS[r]} AND {_LOW.format(r)} > {quality.FACTOR} * m_{r})" for r in _RULES)} AS rejected FROM p2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_RULES["base"]} AS base_failed, NOT {_RULES["base"]} AND NOT rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""

#: queries that SQL can express; the others are tested against brute force, round trips or held-out labels
ORACLES: dict[str, str] = {"op1_mixing": _MIXING, "op5_licenses": _LICENSES, "op10_quality": _QUALITY}
