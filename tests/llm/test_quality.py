import random
import re
from collections import Counter

from keyloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def check(df):
    rows = Q.judge(df).collect()
    want = sorted(str((r["doc_id"], *counts(r["text"]))) for r in df.select("doc_id", "text").collect())
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(str(tuple(r[n] for n in names)) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["host_rejected"])
    return rows


def test_counts(docs, odd):
    rows = check(docs)
    assert not any(r["host_rejected"] for r in rows)
    check(odd)


def test_a_bad_host_goes_and_a_small_one_is_pulled_to_the_mean(spark):
    good, bad = "ten words that are all different and make a line here", "few words"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(300)]
    rows += [(1000 + i, good, f"h{i % 20}") for i in range(2000)]
    rows += [(9000, bad, "tiny")] + [(9001, good, "tiny"), (9002, bad, None)]
    got = {r["doc_id"]: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0]["base_failed"] and got[0]["host_rejected"] and not got[0]["kept"]
    assert got[1000]["kept"] and got[9001]["rate_base"] < 0.5 and got[9001]["kept"]


def posterior(k, n, ks, ns):
    """Rate and its lower bound, by the docstring's formulas."""
    total, m = sum(ns), sum(ks) / sum(ns)
    between = len(ns) - 1
    room = total - sum(x * x for x in ns) / total - between
    share = (sum(x * (y / x - m) ** 2 for y, x in zip(ks, ns, strict=True)) / (m * (1 - m)) - between) / room if 0 < m < 1 and room > 0 else 0
    weight = 1 / min(share, 0.5) - 1 if share > 1 / (total + 1) else total
    rate = (k + m * weight) / (n + weight)
    return rate, rate - 2 * (rate * (1 - rate) / (n + weight + 1)) ** 0.5


def test_rates_by_the_formulas(spark):
    rng = random.Random(1)
    ns, rates = [1, 2, 5, 40, 300, 7], [0.5, 0.5, 0.1, 0.6, 0.05, 0.0]
    fails = [[rng.random() < p for _ in range(n)] for n, p in zip(ns, rates, strict=True)]
    rows = [(f"h{h}", f) for h, some in enumerate(fails) for f in some]
    got = {r["host"]: r for r in Q.host_rates(spark.createDataFrame(rows, "host string, bad boolean"), ["bad"]).collect()}
    ks = [sum(f) for f in fails]
    for h, (k, n) in enumerate(zip(ks, ns, strict=True)):
        want = posterior(k, n, ks, ns)
        assert abs(got[f"h{h}"]["rate_bad"] - want[0]) < 1e-9 and abs(got[f"h{h}"]["low_bad"] - want[1]) < 1e-9


def test_empty(none):
    assert Q.judge(none).collect() == []


def test_no_python_on_the_path(docs):
    plan = Q.features(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
