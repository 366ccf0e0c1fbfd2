import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import scoring as S
from keyloom.llm import textvec


def brute(rows):
    """(tokens, loss under background, under target) by dictionaries; rows are (id, counted, marked, text)."""
    texts = [(i, c, c and m, re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) for i, c, m, t in rows]
    size_of = lambda some: sum(len((r[3] or "").encode()) for r in some)
    in_target = size_of([r for r in rows if r[1] and r[2]])
    folds = min(S.FOLDS, max(1, round(size_of([r for r in rows if r[1]]) / in_target))) if in_target else 1
    takes = [[bool(c) and zlib.crc32(str(i).encode()) % folds == f for i, c, _, _ in texts] for f in range(folds)] + [[bool(m) for _, _, m, _ in texts]]
    corpora = [[ws for mine, (_, _, _, ws) in zip(row, texts, strict=True) if mine] for row in takes]
    size = len({w for mine in corpora for ws in mine for w in ws})
    totals = [sum(map(len, mine)) for mine in corpora]
    single = [Counter(w for ws in mine for w in ws) for mine in corpora]
    double = [Counter(p for ws in mine for p in zip(ws, ws[1:], strict=False)) for mine in corpora]
    out = []
    for d, (_, _, _, ws) in enumerate(texts):
        means = []
        own, own2 = Counter(ws), Counter(zip(ws, ws[1:], strict=False))
        for k, row in enumerate(takes):
            scale = totals[-1] / totals[k] if totals[k] and totals[-1] else 1.0
            n = lambda w: (single[k][w] - (own[w] if row[d] else 0)) * scale  # noqa: B023, E731
            among = (totals[k] - (len(ws) if row[d] else 0)) * scale
            loss = 0.0
            for i, w in enumerate(ws):
                p = (n(w) + S.ALPHA) / (among + S.ALPHA * (size + 1))
                if i:
                    pair = (ws[i - 1], w)
                    p = ((double[k][pair] - (own2[pair] if row[d] else 0)) * scale + S.PRIOR * p) / (n(ws[i - 1]) + S.PRIOR)
                loss -= math.log(p)
            means.append(loss / max(len(ws), 1))
        used = [m for m, t in zip(means[:-1], totals, strict=False) if t] or means[:1]
        out.append((len(ws), sum(used) / len(used), means[-1]))
    return out


def same(got, want):
    assert got["n_tokens"] == want[0]
    assert got["loss_background"] == pytest.approx(want[1], abs=1e-9) and got["loss_target"] == pytest.approx(want[2], abs=1e-9)
    assert got["score"] == pytest.approx(want[1] - want[2], abs=1e-9)


def test_equals_brute_force(docs):
    rows = docs.select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F]", "u").alias("text")).filter("doc_id < 60").orderBy("doc_id").collect()
    df = docs.sparkSession.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(3)
    for marked, counted in ((F.col("doc_id") % 3 == 0, None), (F.col("doc_id") % 3 == 0, F.col("doc_id") % 4 < 3), (F.lit(None).cast("boolean"), None)):
        take = df.select("doc_id", F.coalesce(F.lit(True) if counted is None else counted, F.lit(False)), F.coalesce(marked, F.lit(False)), "text").orderBy("doc_id").collect()
        want = brute([tuple(r) for r in take])
        for block_bytes in (50_000, 4_000_000):
            got = {r["doc_id"]: r for r in S.score(df, marked, counted, block_bytes=block_bytes).collect()}
            for r, w in zip(take, want, strict=True):
                same(got[r["doc_id"]], w)


def test_no_word_is_left_out(spark):
    """Very many words of one count: all of them count, whatever their number."""
    texts = [" ".join(f"w{(i * 7 + k) % 30_000}" for k in range(3000)) for i in range(0, 8700, 435)]
    texts += texts[:3] + [" ".join(f"w{k}" for k in range(30_000))] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = brute([(i, True, i % 3 == 0, t) for i, t in enumerate(texts)])
    for r in S.score(df, F.col("doc_id") % 3 == 0, block_bytes=100_000).collect():
        same(r, want[r["doc_id"]])


def test_own_counts_do_not_help(spark):
    """A marked text of words that nothing else has is as unlike the target as an unmarked one; its copy makes it known."""
    rows = [(i, f"these are words that many have and {i} is a number") for i in range(100, 200)]
    rows += [(0, "alpha beta gamma delta"), (2, "uno dos tres cuatro"), (3, "uno dos tres cuatro"), (4, "epsilon zeta eta theta")]
    got = {r["doc_id"]: r for r in S.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 100 < 25).collect()}
    unmarked = S.score(spark.createDataFrame(rows, "doc_id long, text string"), (F.col("doc_id") % 100 < 25) & (F.col("doc_id") > 0)).filter("doc_id = 0").first()
    assert abs(got[0]["loss_target"] - unmarked["loss_target"]) < 0.1
    assert got[2]["loss_background"] < got[4]["loss_background"] - 0.3 and got[2]["loss_target"] < got[4]["loss_target"] - 0.3


def test_labels_are_told_apart(spark):
    """A text's own label does not help it, so the two kinds of bad documents are told apart by what they say."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = S.score(docs.join(labels, "doc_id", "left"), (F.col("quality") == 1) & (F.col("toxic") == 0))
    rows = got.join(labels, "doc_id").filter("n_tokens > 0").select("quality", "toxic", "score").collect()
    of = lambda q, t: [r["score"] for r in rows if (r["quality"], r["toxic"]) == (q, t)]
    better = lambda a, b: sum(x > y for x in a for y in b) / (len(a) * len(b))
    assert better(of(1, 0), of(1, 1)) > 0.6 and better(of(1, 0), of(0, 0)) > 0.9
    assert abs(np.mean(of(1, 0))) < 0.5  # models of one size: what both know costs the same


def test_odd_and_empty(odd, none):
    out = S.score(odd, F.col("source") == "s1").collect()
    assert len(out) == odd.count() and all(r["score"] == 0 for r in out if not r["n_tokens"])
    want = sorted(brute([(r["doc_id"], True, r["source"] == "s1", r["text"]) for r in odd.collect()]))
    got = sorted((r["n_tokens"], r["loss_background"], r["loss_target"]) for r in out)
    assert np.allclose(np.array(got), np.array(want))
    assert S.score(none, F.lit(True)).collect() == []


def test_hashes_of_texts_that_defeat_polynomials():
    """Thue-Morse texts and their complements have equal polynomial hashes modulo 2**64, whatever the base."""
    bits = np.zeros(1, dtype=np.uint32)
    while len(bits) < 4096:
        bits = np.concatenate([bits, 1 - bits])
    values = np.concatenate([bits + 97, 1 - bits + 97])
    h = textvec.span_hashes(values, np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] != h[1]
    again = textvec.span_hashes(np.concatenate([[5], bits + 97]), np.array([1]), np.array([4097]))
    assert again[0] == h[0]
    rng = np.random.default_rng(0)
    starts = np.arange(0, 600_000, 3)
    values = rng.integers(0, 50, 600_000).astype(np.uint32)
    h = textvec.span_hashes(values, starts, starts + 2)
    assert len(np.unique(h)) == len(np.unique(values[starts] * 50 + values[starts + 1]))
